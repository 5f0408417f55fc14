"""URL filters: a temporal list join (native).

Dated list entries (add or remove of a host) become validity intervals; a capture is
blocked when its host or a parent domain has an entry that was active when the page was
fetched. An equi-join on the domain plus an interval condition is the as-of join:
intervals of one domain are disjoint, so a capture meets at most one of each domain.

Defined results: a null or unparsable url has no host and is never blocked; a null fetch
time is never inside an interval; several entries of one domain at the same time count
as one, removal winning; entries with a null domain or time are left out; repeated
captures are each judged; a very long url is one row's work; further columns stay, but those named like a result are replaced; empty tables give empty or unblocked rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without user, port and a leading www."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"^www\.", ""), F.lit(""))


def domains(h: Column) -> Column:
    """The host and its parent domains with at least two labels."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.when(
        n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))
    ).otherwise(F.array(h))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, at, action) to disjoint (domain, valid_from, valid_to, reason); valid_to is exclusive.

    action 'add' opens and 'remove' closes. Repeated adds do not split an interval.
    """
    dated = entries.where(F.col("domain").isNotNull() & F.col("at").isNotNull())
    dated = dated.groupBy("domain", "at").agg(
        F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("closes"), F.min("reason").alias("reason")
    )
    w = Window.partitionBy("domain").orderBy("at")
    dated = dated.withColumn("was", F.lag("closes").over(w)).where(
        F.col("was").isNull() | (F.col("was") != F.col("closes"))
    )
    dated = dated.withColumn("valid_to", F.lead("at").over(w)).where("closes = 0")
    return dated.select("domain", F.col("at").alias("valid_from"), "valid_to", "reason")


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with ``host``, ``blocked``, ``blocked_by`` (most specific domain), ``reason``.

    Distinct (host, time) pairs are judged, so a hot host is looked up once a fetch
    time; the verdicts then join back. Only blocked pairs travel. Keys meet as structs: a side
    that an aggregate or window has dealt by them is dealt anew, so Spark can split hot ones.
    """
    hosted = captures.drop("blocked", "blocked_by", "reason").withColumn("host", host(F.col(url)))
    pairs = hosted.where("host is not null").select("host", F.col(fetched).alias("__at")).distinct()
    looked = pairs.withColumn("domain", F.explode(domains(F.col("host"))))
    valid = intervals(entries)
    active = (
        (F.struct(looked["domain"].alias("d")) == F.struct(valid["domain"].alias("d")))
        & (F.col("__at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to")))
    )
    hits = looked.join(valid, active).select("host", "__at", valid["domain"].alias("domain"), "reason")
    found = hits.groupBy(F.col("host").alias("__host"), "__at").agg(
        F.max(F.struct(F.length("domain").alias("n"), "domain", "reason")).alias("__hit")
    )
    pair = lambda host, at: F.struct(host.alias("h"), at.alias("t"))
    out = hosted.join(found, pair(hosted["host"], hosted[fetched]) == pair(found["__host"], found["__at"]), "left")
    return out.select(
        *[hosted[c] for c in hosted.columns],
        F.col("__hit").isNotNull().alias("blocked"),
        F.col("__hit.domain").alias("blocked_by"),
        F.col("__hit.reason").alias("reason"),
    )
