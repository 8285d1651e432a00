"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm.common import settled


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("v", "m").unionAll(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
    least = both.groupBy("v").agg(F.min("m").alias("_least")).select("v", F.least("v", "_least").alias("_least"))
    up = both.where("m > v").join(least.hint("merge"), "v")
    return up.select(F.col("m").alias("v"), F.col("_least").alias("m")).where("v <> m").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m"))
    least = down.groupBy("v").agg(F.min("m").alias("_least"))
    moved = down.join(least.hint("merge"), "v").where("m <> _least").select(F.col("m").alias("v"), F.col("_least").alias("m"))
    return moved.unionAll(least.select("v", F.col("_least").alias("m"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (v, m: long ids of linked nodes) to (v, m): every node that isn't the smallest of its component, and that smallest node.

    No node's links are gathered: minima are pre-aggregated and the joins can be split by key. Each
    join merges, whatever the files' sizes let Spark expect: packed edges unpack to many times their size, and
    none go through the driver. Each round is written to the shared folder; rounds grow with the logarithm of a component's size.
    """
    now = settled(edges.where("v <> m").select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        now = settled(_small_star(_large_star(now)), "stars")
        got = _fingerprint(now)
        if got == seen:
            break
        seen = got
    return now
