"""Connected components of an undirected edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import release, stash


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v.  Aggregated before it is joined, so a
    node with very many edges is summed up in each task first and its join can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    full = _with_least(down)
    moved = full.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(full.select("u", F.col("m").alias("v"))).distinct()


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` in the shared folder, and their count and sum of hashes, seen as they are written."""
    seen = Observation()
    kept = stash(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    return kept, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: long, u <> v); root is the least node of
    the component.  Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest path.  An empty table gives an empty result."""
    now, mark = _kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while mark[0]:
        before, last = now, mark
        now, mark = _kept(_small_star(_large_star(before)), "stars")
        release(before)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
