"""Line dedup: content-defined chunks of lines, repeated chunks removed (native).

A rolling hash over the hashes of two neighbouring lines chooses chunk boundaries, so
they move with the text and not with its position. A line of long_words words or more is
a chunk of its own, for the same reason: what it holds decides. Chunks of several lines
(or one long line) that some earlier place already holds are removed, after their bytes
have been compared with those of the place that is kept: the least (doc_id, position).

With passage_words, runs of that many words or more that an earlier place holds go as
well, however lines and chunks divide them. Of every window of n words the least hash of
its 16-word grams is its anchor, so equal windows have equal anchors; only windows whose
anchor occurs twice are looked at, and two windows count as equal by 128 bits.

Documents travel once, keyed by (doc_id, hash), and every reader shares that exchange;
only hashes, places and repeated chunks travel by content. A side that an aggregate has
dealt by a key meets the other by a hash of that key, so that both sides of the join are
dealt anew and Spark can split a hot key.

Defined results: a null text stays null; an empty text has one empty line; chunks of
blank or single short lines are never removed; very long texts are one row's work and
everything on them is linear in their words; rows with the same id and text are one
document and keep the same chunks; a null id sorts first; further columns stay, but those
named like a result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import SPACES, bind, cut as cut_table, words

SPREAD = 31
#: Words of an anchor.
GRAM = 16


def line_hash(line: Column) -> Column:
    """32 bits of a line, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, every: int, long_words: int) -> Column:
    """array<array<string>>: the lines of text in content-defined chunks of about every lines."""
    lines = F.split(text, "\n")
    is_long = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= long_words - 1
    marks = lambda ls: F.transform(ls, lambda x: F.struct(line_hash(x).alias("h"), is_long(x).alias("long")))

    def cut(ls: Column) -> Column:
        def starts(m: Column) -> Column:
            def begins(j: Column) -> Column:
                a, b, c = F.get(m, j - 2)["h"], F.get(m, j - 1), F.get(m, j)
                roll = (F.coalesce(a, F.lit(0)) * SPREAD + b["h"]) % every
                return (j == 0) | F.coalesce((roll == 0) | b["long"] | c["long"], F.lit(False))

            return F.filter(F.sequence(F.lit(0), F.size(m) - 1), begins)

        def slices(s: Column) -> Column:
            return F.transform(
                s, lambda x, j: F.slice(ls, x + 1, F.coalesce(F.get(s, j + 1), F.size(ls)) - x)
            )

        return bind(bind(marks(ls), starts), slices)

    return bind(lines, cut)


def _eligible(chunk: Column, long_words: int) -> Column:
    solid = F.size(F.filter(chunk, lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    first = F.get(chunk, 0)
    return (solid >= 2) | (F.length(first) - F.length(F.replace(first, F.lit(" "), F.lit(""))) >= long_words - 1)


def _slid(values: Column, width: int, join) -> Column:
    """join() of the values from each place on, width of them, up to four at a time; the last places are of no use.

    Where width is no power of four, the last step overlaps, so join() has to allow that.
    """

    def with_later(offsets: list[int]):  # the inner function has one argument: a second one would be the position
        return lambda v: F.transform(v, lambda x, i: join(x, *[F.get(v, i + o) for o in offsets]))

    out, covered = values, 1
    while covered < width:
        n = min(4, -(-width // covered))
        out = bind(out, with_later([min(k * covered, width - covered) for k in range(1, n)]))
        covered = min(n * covered, width)
    return out


def _runs(text: Column, n: int) -> Column:
    """array<struct<h, a, b, g>>: windows [a, b) of n words that follow each other and have the anchor h; g, a hash of all their words."""
    reach = n - GRAM + 1
    none = F.array().cast("array<struct<h:bigint,a:int,b:int,g:bigint>>")

    def of(grams: Column) -> Column:
        last = F.size(grams) - n

        def runs(m: Column) -> Column:
            def all_of(s: Column) -> Column:
                def run(a: Column, k: Column) -> Column:
                    end = F.coalesce(F.get(s, k + 1), last + 1)
                    final = end + (n - 1 - GRAM)  # grams from a to the last one cover all words of a run that holds its anchor once
                    tiles = [F.get(grams, F.least(a + k * GRAM, final)) for k in range(-(-(n - 1 + reach) // GRAM))]
                    g = F.xxhash64(*tiles, F.get(grams, final), end - a)
                    return F.struct(F.get(m, a).alias("h"), a.alias("a"), end.alias("b"), g.alias("g"))

                return F.transform(s, run)

            return bind(F.filter(F.sequence(F.lit(0), last), lambda j: (j == 0) | (F.get(m, j) != F.get(m, j - 1))), all_of)

        return F.when(last >= 0, bind(_slid(grams, reach, F.least), runs)).otherwise(none)

    return bind(_slid(F.transform(words(text), lambda x: F.xxhash64(x)), GRAM, F.xxhash64), of)


def _spans(ranges: Column) -> Column:
    """All whole numbers in array<struct<a, b>> of [a, b)."""
    return F.flatten(F.transform(F.filter(ranges, lambda r: r["a"] < r["b"]), lambda r: F.sequence(r["a"], r["b"] - 1)))


def _merged(at: Column, n: int) -> Column:
    """array<struct<a, b>>: what [x, x + n) covers for the sorted x of at, as ranges that do not meet."""
    first = F.filter(at, lambda x, i: (i == 0) | (x > F.get(at, i - 1) + n))
    last = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + n))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), (b + n).alias("b")))


def _chunk_words(cs: Column) -> Column:
    """array<int>: the number of words before each chunk, and of all."""
    marked = F.flatten(F.transform(cs, lambda c, j: F.array_repeat(j, F.size(words(F.array_join(c, "\n"))) + 1)))

    def starts(m: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return F.concat(F.transform(first, lambda x, j: x - j), F.array(F.size(m) - F.size(cs)))

    return bind(marked, starts)


def _without(text: Column, gone: Column) -> Column:
    """text without the words whose numbers are gone; of the spaces around a run of them those that hold a line end stay."""

    def rest(p: Column) -> Column:
        ws, gaps = p["ws"], p["gaps"]
        n = F.size(ws)

        def body(a: Column, b: Column) -> Column:
            more = F.zip_with(F.slice(gaps, a + 2, b - a - 1), F.slice(ws, a + 2, b - a - 1), lambda g, w: F.concat(g, w))
            return F.when(a < b, F.concat(F.get(ws, a), F.array_join(more, ""))).otherwise("")

        def after(runs: Column):
            def one(r: Column, k: Column) -> Column:
                before, behind = F.get(gaps, r["a"]), F.get(gaps, r["b"])
                glue = F.when(F.contains(behind, F.lit("\n")), behind).otherwise(before)
                glue = F.when((r["a"] == 0) | (r["b"] == n), "").otherwise(glue)
                return F.concat(glue, body(r["b"], F.coalesce(F.get(runs, k + 1)["a"], n)))

            return one

        def joined(runs: Column) -> Column:
            first = F.concat(F.get(gaps, F.lit(0)), body(F.lit(0), F.coalesce(F.get(runs, F.lit(0))["a"], n)))
            return F.concat(first, F.array_join(F.transform(runs, after(runs)), ""), F.get(gaps, n))

        edged = lambda kept: F.concat(F.array(F.lit(-1)), kept, F.array(n))
        between = lambda e: F.filter(
            F.transform(e, lambda x, i: F.struct((x + 1).alias("a"), F.coalesce(F.get(e, i + 1), x).alias("b"))), lambda r: r["a"] < r["b"]
        )
        kept = F.array_except(F.sequence(F.lit(0), n - 1), p["gone"])
        return bind(bind(bind(kept, edged), between), joined)

    gaps = F.split(text, r"[^\x20\x09-\x0D]+")
    return bind(F.struct(words(text).alias("ws"), gaps.alias("gaps"), gone.alias("gone")), rest)


def dedup(docs: DataFrame, *, every: int = 3, long_words: int = 50, passage_words: int | None = None) -> DataFrame:
    """docs with ``clean_text``, ``n_lines``, ``n_removed_lines``, ``removed_chars``.

    n_removed_lines counts the lines of removed chunks. passage_words: take out repeated
    runs of so many words as well; None leaves it at chunks.
    """
    docs = docs.drop("clean_text", "n_lines", "n_removed_lines", "removed_chars")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    own, n = ["doc_id", "__key"], passage_words
    pieces = lambda: chunks(F.col("text"), every, long_words)
    # (doc_id, key) names a document, null ids too; hashed once more, so that no side comes dealt already
    name = F.xxhash64(*own)
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), name.alias("__name"), *[c for c in df.columns if c not in own])
    met = lambda df: (F.col("__at") == F.col("__name")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k"))
    texts = keyed.withColumn("__at", name)
    # this reads every column, so that both readers of texts ask for the same exchange
    shared = lambda df, told: df.where(F.xxhash64(*docs.columns, "__at", *told) >= F.lit(-(2**63)))

    # 1. chunks and anchors that occur in two places; the text stays at home
    full = keyed.where("text is not null")
    listed = F.filter(
        F.transform(pieces(), lambda c, j: F.struct(j.alias("pos"), F.when(_eligible(c, long_words), F.xxhash64(c)).alias("h"))),
        lambda x: x["h"].isNotNull(),
    )
    found = full.select(*own, F.explode(listed).alias("x")).select(*own, "x.*")
    twice = found.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select(F.bitwise_not("h").alias("__h"))
    both = F.bitwise_not("h") == F.col("__h")
    told = found.join(twice, both).groupBy(*own).agg(F.collect_set("pos").alias("__told"))
    told = named(told)
    if n:
        found = full.select(*own, F.explode(_runs(F.col("text"), n)).alias("x")).select(*own, "x.*")
        # a run that is longer than one gram can explain holds its anchor twice itself
        size = F.col("b") - F.col("a")
        often = F.sum(F.when(size > n - GRAM + 1, 2).otherwise(1)).alias("m")
        one = ((F.min("g") == F.max("g")) & (F.max(size) <= n - GRAM + 1)).alias("one")
        twice = found.groupBy("h").agg(often, one).where("m > 1").select(F.bitwise_not("h").alias("__h"), "one")
        runs = found.drop("g").join(twice, both).groupBy(*own).agg(F.collect_set(F.struct("a", "b", "one")).alias("__runs"))
        both_told = told.select("__id", "__k", "__told", F.lit(None).cast("array<struct<a:int,b:int,one:boolean>>").alias("__runs"))
        both_told = both_told.unionByName(named(runs).select("__id", "__k", F.lit(None).cast("array<int>").alias("__told"), "__runs"))
        told = both_told.groupBy("__id", "__k").agg(F.first("__told", True).alias("__told"), F.first("__runs", True).alias("__runs"))
        # read six times below; as a table it is planned once, and plans stay small on the driver
        told = cut_table(told.withColumn("__name", F.xxhash64("__id", "__k")), "line-dedup-told")
    seen = shared(texts.join(told, met(told)), ["__told", "__runs"] if n else ["__told"])

    # 2. chunks by their bytes and whole runs by 128 bits meet the first place of each
    # pos is a chunk's number and span null, or pos is a word's number and span the number of words
    none = F.array().cast("array<struct<pos:int,span:int,h:bigint,g:bigint,body:string,one:boolean>>")
    no_body, no_span, yes = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(True)

    def piece(pos: Column, span: Column, h: Column, g: Column, body: Column, one: Column) -> Column:
        return F.struct(pos.alias("pos"), span.alias("span"), h.alias("h"), g.alias("g"), body.alias("body"), one.alias("one"))

    def chunk_rows(cs: Column) -> Column:
        row = lambda c, j: piece(j, no_span, F.xxhash64(c), F.lit(0).cast("long"), F.array_join(c, "\n"), yes)
        return F.transform("__told", lambda j: bind(F.get(cs, j), lambda c: row(c, j)))

    def run_rows(runs: Column):
        def rows(ws: Column) -> Column:
            def row(r: Column) -> Column:
                span = r["b"] - r["a"]
                said = lambda w: piece(r["a"], span, F.xxhash64(w), F.xxhash64(span, w), no_body, r["one"])
                return bind(F.array_join(F.slice(ws, r["a"] + 1, span), " "), said)

            return F.transform(runs, row)

        return bind(words(F.col("text")), rows)

    def against_heads(seen: DataFrame) -> DataFrame:
        """seen with away: an earlier place holds the piece; a passage must not overlap that place."""
        place = F.struct("doc_id", "__key", "pos", "body")
        heads = seen.groupBy("h", "g").agg(F.min(place).alias("head"), F.count("*").alias("m")).where("m > 1")
        heads = heads.select(F.bitwise_not("h").alias("__h"), F.col("g").alias("__g"), "head")
        out = seen.join(heads, (F.bitwise_not("h") == F.col("__h")) & (F.col("g") == F.col("__g")), "left")
        at_home = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("__key") == F.col("head.__key"))
        chunk_away = ~(at_home & (F.col("pos") == F.col("head.pos"))) & (F.col("body") == F.col("head.body"))
        away = F.when(F.col("span").isNull(), chunk_away).otherwise(~at_home | (F.col("pos") >= F.col("head.pos") + (n or 0)))
        return out.withColumn("away", F.col("head").isNotNull() & F.coalesce(away, F.lit(False)))

    listed = F.when(F.col("__told").isNotNull(), bind(pieces(), chunk_rows))
    if n:
        whole = lambda r: F.struct(r["a"].alias("a"), (r["b"] + (n - 1)).alias("b"), r["one"].alias("one"))
        of_runs = F.when(F.col("__runs").isNotNull(), run_rows(F.transform("__runs", whole)))
        listed = F.concat(F.coalesce(listed, none), F.coalesce(of_runs, none))
    seen = against_heads(seen.select(*own, F.explode(listed).alias("x")).select(*own, "x.*"))
    seen = seen.where("away or not one").select(*own, F.struct("away", F.col("pos").alias("a"), (F.col("pos") + F.col("span")).alias("b")).alias("x"))
    marks = seen.groupBy(*own).agg(F.collect_set("x").alias("__marks"))

    # 3. runs whose words are new, but whose anchor others have with other words, window by window
    lost = ["__marks"]
    if n:
        fresh = lambda r: ~r["away"]
        open_ = named(marks).where(F.exists("__marks", fresh))
        rest = shared(texts.join(open_, met(open_)), ["__marks"])
        starts = _spans(F.transform(F.filter("__marks", fresh), lambda r: F.struct(r["a"].alias("a"), (r["b"] - (n - 1)).alias("b"))))
        listed = run_rows(F.transform(starts, lambda i: F.struct(i.alias("a"), (i + n).alias("b"), yes.alias("one"))))
        rest = against_heads(rest.select(*own, F.explode(listed).alias("x")).select(*own, "x.*"))
        rest = rest.where("away").groupBy(*own).agg(F.collect_set("pos").alias("__past")).select(F.col("doc_id").alias("__i"), F.col("__key").alias("__j"), "__past")
        marks = marks.join(rest, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__j")), "left").drop("__i", "__j")
        lost = ["__marks", "__past"]

    # 4. what is left of each text
    gone = named(marks)
    out = shared(texts.join(gone, met(gone), "left"), lost)
    away = lambda chunk: lambda r: r["away"] & (r["b"].isNull() if chunk else r["b"].isNotNull())
    out = out.withColumn("__gone", F.transform(F.filter("__marks", away(True)), lambda r: r["a"]))
    out = out.withColumn("__c", F.when(F.size(F.col("__gone")) > 0, pieces()))
    stay = lambda cs: F.transform(F.array_except(F.sequence(F.lit(0), F.size(cs) - 1), F.col("__gone")), lambda j: F.get(cs, j))
    out = out.withColumn("__left", F.flatten(bind(F.col("__c"), stay)))
    clean = F.when(F.col("__c").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n"))
    if n:
        runs = F.transform(F.filter("__marks", away(False)), lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b")))
        windows = bind(F.sort_array(F.coalesce("__past", F.array().cast("array<int>"))), lambda at: _merged(at, n))
        out = out.withColumn("__past", F.concat(runs, windows))
        range_of = lambda s: F.transform("__gone", lambda j: F.struct(F.get(s, j).alias("a"), F.get(s, j + 1).alias("b")))
        of_gone = F.when(F.size("__gone") > 0, _spans(bind(_chunk_words(pieces()), range_of))).otherwise(F.array().cast("array<int>"))
        words_gone = F.concat(_spans(F.col("__past")), of_gone)
        clean = F.when(F.size(F.col("__past")) > 0, _without(F.col("text"), words_gone)).otherwise(clean)
    n_lines = F.size(F.split("text", "\n"))
    out = out.withColumns(
        {
            "clean_text": clean,
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"),
            "n_removed_lines": F.when(F.col("__c").isNull(), 0).otherwise(n_lines - F.size("__left")).cast("long"),
        }
    )
    removed = F.coalesce(F.length("text") - F.length("clean_text"), F.lit(0)).cast("long")
    return out.select(*docs.columns, "clean_text", "n_lines", "n_removed_lines", removed.alias("removed_chars"))


def deduped_documents(docs: DataFrame, *, passage_words: int = 50, **options) -> DataFrame:
    """docs without repeated chunks and passages; a document that had words and lost all of them goes."""
    blank = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(SPACES)) == ""
    out = dedup(docs, passage_words=passage_words, **options)
    out = out.where(F.col("clean_text").eqNullSafe(F.col("text")) | ~blank("clean_text"))
    values = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])
