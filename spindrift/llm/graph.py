"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node that a link of two longs ``a``, ``b`` names.

    Large stars hook each node's larger neighbours to its smallest one, small
    stars its smaller neighbours, until nothing moves; a path of n nodes takes
    about log n rounds. The result reads a staged table, which can be
    discarded through it. Each star is an aggregation and a join on a node, so
    a hub's many rows are pre-aggregated and its join may be split.
    """
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")
        large = staged(large, "links")  # a row for each link at most; what is there twice goes with the small stars
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        hooked = large.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        small = hooked.unionByName(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct()
        now, old = staged(small, "links"), now
        discard(old, large)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components still move after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    out.staged_at = now.staged_at
    return out


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
