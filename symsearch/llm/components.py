"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns a, b); component: the smallest id reachable.

    Alternating large-star and small-star rounds: every id points to the
    smallest among its neighbours.  The number of rounds grows with the
    logarithm of the size; each round's edges are written to the shared folder,
    never collected, and a hub's neighbours are only aggregated by min.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        # a star forest is a fixed point: no id points to two ids, and none that is pointed to points on
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = state


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each id go to the smallest one among the id and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each id, and the id, go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(others).where("a <> b").distinct()
