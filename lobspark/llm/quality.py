"""Quality rules: line-first cleaning, then a verdict on what is left (native).

Every line is judged by itself on punctuation, navigation and boilerplate. Failed
lines go; a document that loses too much of its text goes as a whole. One pass over
the text, no shuffle, no Python on the executors.

Prose that merely names a cookie or begins with "Next" stays: menu words count only as a
whole line, and phrases that prose may hold only two at a time.

Defined results: a null or blank text has no words, so it fails the base rule and is
dropped. A very long text is one row's work, linear in it but for the sorting of its
windows. Rows are judged one by one, so ties, repeated rows and further columns
(kept as they are) have no influence. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import SPACES, bind, words

#: Last characters that end a sentence, clause or quotation.
TERMINAL = [".", "!", "?", ":", ";", "…", "。", "！", "？", '"', "'", "”", "’", "»", ")", "]"]
#: Phrases of page furniture that prose does not hold; one in a short line is enough.
FURNITURE = r"\b(all rights reserved|lorem ipsum|powered by wordpress)\b"
#: Phrases that prose may hold as well; a short line needs two different ones.
SIGNALS = r"cookies|cookie policy|cookie settings|javascript|privacy policy|terms of use|terms of service|click here|sign up|sign in|log in|subscribe|newsletter|powered by"
TWO_SIGNALS = rf"(?s)\b({SIGNALS})\b.*\b(?!\1\b)({SIGNALS})\b"
#: Link rows, and menu words that are the whole line or stand before a divider.
LINK_ROW = r"(?s)(^|\s)[|»](\s|$).*\s[|»](\s|$)"
MENU_LINE = r"^(home|menu|next|previous|back to top|share|login|log in)\s*([|>»].*)?$"
SYMBOLS = r"[#*$%&|<>]"
#: A line of this many characters is prose, whatever phrases it holds.
SHORT_LINE = 200
WINDOW = 8


def line_kept(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line; blank lines pass."""
    bare = F.btrim(line, F.lit(SPACES))
    low = F.lower(bare)
    short = F.length(bare) < SHORT_LINE
    return (bare == "") | (
        F.right(bare, F.lit(1)).isin(TERMINAL)
        & ~(short & (low.rlike(LINK_ROW) | low.rlike(MENU_LINE)))
        & ~(short & (low.rlike(FURNITURE) | low.rlike(TWO_SIGNALS)))
    )


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more, the first one included."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        n = F.size(h)
        found = F.when(
            n >= window,
            F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))),
        ).otherwise(F.array().cast("array<bigint>"))
        return bind(found, covered)

    def covered(ws: Column) -> Column:
        ranked = F.sort_array(F.transform(ws, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(
            bind(bind(ranked, starts), spread)
        )

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def spread(p: Column) -> Column:
        step = lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, b: a + b)

    return bind(hashed, over).cast("long")


def assess(
    docs: DataFrame,
    *,
    min_words: int = 20,
    max_repeat_pct: int = 30,
    max_lost_pct: int = 50,
) -> DataFrame:
    """Add the measures, ``clean_text`` (kept lines), ``base_failed`` and ``kept``.

    Further columns of docs stay; those named like a measure are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    tokens = words(F.col("text"))
    step = docs.withColumns({"__words": tokens, "__lines": lines})
    step = step.withColumn("__kept", F.filter("__lines", line_kept))
    own = F.transform(
        F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.xxhash64(x)
    )
    joined = lambda c: F.length(F.array_join(c, "")).cast("long")
    step = step.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": joined("__words"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": bind(own, lambda h: F.size(h) - F.size(F.array_distinct(h))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")),
            "line_chars": joined("__lines"),
            "kept_chars": joined("__kept"),
            "clean_text": F.array_join("__kept", "\n"),
        }
    ).drop("__words", "__lines", "__kept")
    failed = (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_pct) * F.col("n_words")
    )
    lost = F.lit(100) * (F.col("line_chars") - F.col("kept_chars")) > F.lit(max_lost_pct) * F.col("line_chars")
    return step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)


def clean(docs: DataFrame, **rules) -> DataFrame:
    """Kept documents with failed lines removed; same columns as docs."""
    out = assess(docs, **rules).where("kept")
    values = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])
