"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; runs of one role share one
header, and the pieces are concatenated by array functions. Template:

    <|start|>ROLE<|text|>TEXT<|sep|>TEXT<|end|><|start|>...

``<|sep|>`` divides the turns of a merged run, so every turn can be read back. Control
strings inside roles and texts are broken up by a backslash after their first character,
and a backslash is doubled, so none is left and unescaping is exact.

Defined results: null text and null role are empty strings; turns sort by turn (null
first), then role, then text, so ties and repeated rows keep a fixed order and all
count; a null conv_id is one conversation; further columns are not read; an empty table
gives an empty table. A conversation is one output string, so it is one row's work by
definition; everything on it is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import bind

#: The template's control strings.
START, TEXT, SEP, END = "<|start|>", "<|text|>", "<|sep|>", "<|end|>"
#: The escape character, then what control strings of common templates begin with.
ESCAPED = ["\\", "<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]


def escape(c: Column) -> Column:
    for s in ESCAPED:
        c = F.replace(c, F.lit(s), F.lit(s[:1] + "\\" + s[1:] if len(s) > 1 else s * 2))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def running_sum(values: Column) -> Column:
    """Sums of an array up to each place; a logarithmic number of passes over it."""

    def step(by: int):
        return lambda v: F.when(F.size(v) > by, F.transform(v, lambda x, i: x + F.coalesce(F.get(v, i - by), F.lit(0)))).otherwise(v)

    for k in range(24):
        values = bind(values, step(1 << k))
    return values


def format_conversations(turns: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_runs).

    loss_runs covers formatted from start to end: consecutive runs of ``chars`` code
    points from ``start`` on, ``loss`` true exactly on the (escaped) texts of the role learn.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    packed = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    convs = packed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    before = lambda j: F.get("turns", j - 1)["role"]
    after = lambda j: F.get("turns", j + 1)["role"]

    def pieces(x: Column, j: Column) -> Column:
        head = F.concat(F.lit(START), escape(x["role"]), F.lit(TEXT))
        opens = F.when(F.coalesce(before(j) == x["role"], F.lit(False)), F.lit(SEP)).otherwise(head)
        closes = F.when(F.coalesce(after(j) == x["role"], F.lit(False)), F.lit("")).otherwise(F.lit(END))
        piece = lambda c, loss: F.struct(c.alias("piece"), loss.alias("loss"))
        return F.array(
            piece(opens, F.lit(False)), piece(escape(x["text"]), x["role"] == learn), piece(closes, F.lit(False))
        )

    convs = convs.withColumn("pieces", F.flatten(F.transform("turns", pieces)))
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["piece"]).alias("chars"), p["loss"].alias("loss")))

    def runs(sizes: Column) -> Column:
        run = lambda ends: lambda p, i: F.struct((F.get(ends, i) - p["chars"]).alias("start"), p["chars"].alias("chars"), p["loss"].alias("loss"))
        return bind(running_sum(F.transform(sizes, lambda p: p["chars"])), lambda ends: F.transform(sizes, run(ends)))

    return convs.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        bind(sizes, runs).alias("loss_runs"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation, in order."""
    runs = F.filter(F.split(formatted, r"<\|end\|>"), lambda r: r != "")

    def turns_of(r: Column) -> Column:
        sides = F.split(F.substring(r, len(START) + 1, 2**31 - 1), r"<\|text\|>", 2)
        role = unescape(F.get(sides, 0))
        return F.transform(
            F.split(F.get(sides, 1), r"<\|sep\|>"),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(runs, turns_of))


def masked_text(formatted: Column, loss_runs: Column) -> Column:
    """All text under the loss mask, unescaped run by run; cut out of formatted by the runs' offsets alone."""

    def cut(wide: Column) -> Column:  # four bytes a code point, so an offset needs no scan
        piece = lambda r: F.decode(F.substring(wide, 4 * r["start"] + 1, 4 * r["chars"]), "UTF-32")
        return F.transform(F.filter(loss_runs, lambda r: r["loss"]), lambda r: unescape(piece(r)))

    return F.array_join(bind(F.encode(formatted, "UTF-32"), cut), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds: counts and digests of turns and of the text under the loss mask."""
    read = formatted.withColumn("turns", read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_runs")))
    loss = F.col("loss")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.aggregate("loss_runs", F.lit(0), lambda a, r: a + r["chars"]).cast("long").alias("mask_chars"),
    )
