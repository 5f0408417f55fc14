"""Mixing sources to target weights by Sainte-Laguë apportionment (native).

Each source gets a target number of words; equal-word blocks are apportioned among
sources by highest quotients, a source's seats are apportioned among its shards the
same way, and each shard takes its quota as a seeded, contiguous run of blocks over
its documents in seeded order (so at most two documents a shard are taken in part).

Only (source, shard) groups of a bounded number of words are sorted, so a source that
holds a third of all rows is split over many tasks. Work on one row a source or shard
is the only work done in windows over a source.

Sources are few: the targets are worked out in one task over a row a source, and a
source's quotas in one over a row a shard (most_shards at most).

Defined results: a null text has no words; a null source is a source and sorts last; very
long texts are cut at a block's edge like others; equal rows are counted, not sorted, and
interchangeable; further columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.llm.common import cut, words

#: The weights, repeated over the sources in code point order.
WEIGHTS = [1, 2, 3]


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size) to (.., source_no, target), one row a source.

    Water-filling: sources in order of limit / weight; those before the level at which
    the rest shares what is left are held at their limit, ``most`` times their size.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    picks = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("w", F.get(picks, F.col("source_no") % len(weights)))
    ranked = ranked.withColumn("limit", (F.col("source_size") * most).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "left": F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "share_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    ranked = ranked.withColumn("level", F.col("left") / F.col("share_w"))
    free = F.col("level") * F.col("w") <= F.col("limit")
    ranked = ranked.withColumn("level", F.max(F.when(free, F.col("level"))).over(every))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("w"), F.col("limit")))
    return ranked.select("source", "source_size", "source_no", target.alias("target"))


def apportion(df: DataFrame, group: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: seats of the group dealt to its rows by highest weight / (2k + 1).

    key is unique in a group and breaks ties. Only the quotients near the last seat are
    listed, about two for each row: with n rows, the quota at n seats fewer is surely
    given and the quota at n seats more surely holds every winner.
    """
    g = Window.partitionBy(*group)
    total, n = F.sum(weight).over(g), F.count(F.lit(1)).over(g)
    at = lambda s: F.when(F.col("__total") > 0, F.floor(F.col(weight) * s / F.col("__total") + 0.5)).otherwise(0)
    step = df.withColumns({"__total": total.cast("double"), "__n": n})
    step = step.withColumns(
        {
            "__low": at(F.greatest(F.col(seats) - F.col("__n"), F.lit(0))).cast("long"),
            "__high": at(F.col(seats) + F.col("__n")).cast("long"),
        }
    )
    step = step.withColumn("__open", F.col(seats) - F.sum("__low").over(g))
    tries = F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high")))
    listed = step.select(*group, key, "__open", weight, F.explode(tries).alias("__k"))
    quotient = F.col(weight) / (2 * F.col("__k") - 1)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), key, "__k"))
    won = listed.withColumn("__r", rank).where("__r <= __open").groupBy(*group, key).agg(F.count("*").alias("__won"))
    return (
        step.join(won, [*group, key], "left")
        .withColumn(out, F.col("__low") + F.coalesce(F.col("__won"), F.lit(0)))
        .drop("__total", "__n", "__low", "__high", "__open", "__won")
    )


def _overlap(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi, b) - F.greatest(lo, a))


def mix(
    docs: DataFrame,
    *,
    weights: list[int] = WEIGHTS,
    share: float = 1.0,
    most: int = 3,
    block_words: int = 16,
    shard_words: int = 65_536,
    most_shards: int = 200_000,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, ..): what the mix takes of each row.

    shard_words grows with the input beyond
    most_shards shards. The result depends on docs and seed only, not on partitions.
    """
    slim = docs.select(
        "doc_id",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
    )
    # equal rows are one row with a number of copies until they get their shares
    slim = cut(slim.groupBy("doc_id", "size", "source", "draw").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes, weights, share, most)
    one = Window.partitionBy(F.lit(0))
    goal = goal.withColumns(
        {
            "__one": F.lit(0),
            "seats": F.round(F.sum("target").over(one) / block_words).cast("long"),
            "per_shard": F.greatest(
                F.lit(shard_words), F.ceil(F.sum("source_size").over(one) / most_shards)
            ).cast("long"),
        }
    )
    goal = apportion(goal, ["__one"], "source_no", "target", "seats", "source_seats").drop("__one", "seats")
    goal = goal.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("per_shard"))))
    goal = cut(goal.drop("per_shard"), "mix-targets")
    same = slim["source"].eqNullSafe(goal["source"])
    placed = slim.join(goal, same).drop(goal["source"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("n_shards")))
    shards = placed.groupBy("source_no", "shard").agg(
        F.sum(F.col("size") * F.col("n")).alias("shard_size"), F.first("source_seats").alias("source_seats")
    )
    blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words)))
    shards = shards.withColumn("blocks", F.coalesce(blocks, F.lit(0)).cast("long"))
    shards = apportion(shards, ["source_no"], "shard", "blocks", "source_seats", "quota")
    shards = shards.where("blocks > 0").withColumn("quota", F.least("quota", F.col("blocks") * most))
    edge = lambda k: F.expr(f"({k}) * shard_size div blocks")
    shards = shards.selectExpr(
        "source_no", "shard", "shard_size", "blocks",
        "quota div blocks as times", "quota % blocks as run",
        f"pmod(xxhash64({int(seed)}, source_no, shard), blocks) as start",
    )
    shards = shards.select(
        "source_no", "shard", "times",
        edge("start").alias("a1"), edge("least(start + run, blocks)").alias("b1"),
        edge("greatest(start + run - blocks, 0)").alias("b2"),
    )
    order = Window.partitionBy("source_no", "shard").orderBy("draw", "doc_id", "size")
    own = F.col("size") * F.col("n")
    placed = placed.withColumn("lo", F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, 0)) - own)
    taken = placed.join(shards, ["source_no", "shard"], "left")
    # the copies again, each with its own words of the shard; in two steps, so that no array is long
    some = 1 << 16
    taken = taken.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / some))))
    left = F.least(F.lit(some), F.col("n") - F.col("i") * some)
    taken = taken.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)))
    taken = taken.withColumn("lo", F.col("lo") + (F.col("i") * some + F.col("j")) * F.col("size"))
    taken = taken.withColumn("hi", F.col("lo") + F.col("size"))
    # the run of blocks wraps around the shard's end: [a1, b1) and [0, b2)
    first = _overlap(F.col("lo"), F.col("hi"), F.col("a1"), F.col("b1"))
    second = _overlap(F.col("lo"), F.col("hi"), F.lit(0), F.col("b2"))
    taken = taken.withColumns(
        {
            "copies": F.coalesce("times", F.lit(0)),
            "head": F.coalesce(second, F.lit(0)),
            "run": F.coalesce(first, F.lit(0)),
            "run_from": F.coalesce(F.greatest("a1", "lo") - F.col("lo"), F.lit(0)),
        }
    )
    return taken.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies") + F.col("head") + F.col("run")).cast("long").alias("taken"),
        "draw", "copies", "head", "run", "run_from",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: whole copies, then the taken words of a document that a run's edge cuts.

    A part is its words joined by single spaces. Rows meet their shares by the 64-bit
    draw of (seed, doc_id, text); repeated rows are told apart by their rank.
    """
    draw = F.xxhash64(F.lit(options.get("seed", 7)), "doc_id", "text")
    ranked = Window.partitionBy("__draw")
    took = mix(docs, **options).withColumnRenamed("draw", "__draw")
    took = took.withColumn("__no", F.row_number().over(ranked.orderBy(F.desc("taken")))).where("taken > 0")
    whole = (F.col("head") + F.col("run") == F.col("size")).cast("int")
    some = (whole == 0) & (F.col("head") + F.col("run") > 0)
    copies = F.concat(
        F.array_repeat(F.lit(False), (F.col("copies") + whole).cast("int")),
        F.when(some, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    took = took.select("__draw", "__no", "head", "run", "run_from", copies.alias("__copies"))
    took = took.select("__draw", "__no", F.struct("head", "run", "run_from", "__copies").alias("__took"))
    rows = docs.withColumn("__draw", draw)
    rows = rows.withColumn("__no", F.row_number().over(ranked.orderBy("doc_id")))
    both = rows.join(took, ["__draw", "__no"]).withColumn("__part", F.explode("__took.__copies"))
    cut_at = lambda start, n: F.slice("__words", start.cast("int"), F.col(n).cast("int"))
    both = both.withColumn("__words", F.when(F.col("__part"), words(F.col("text"))))
    piece = F.array_join(
        F.concat(cut_at(F.lit(1), "__took.head"), cut_at(F.col("__took.run_from") + 1, "__took.run")), " "
    )
    both = both.withColumn("__text", F.when(F.col("__part"), piece).otherwise(F.col("text")))
    values = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])
