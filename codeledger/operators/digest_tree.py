"""A digest tree of a snapshot's sources, and the difference of two of them.

A source's place is the SHA-256 of its path, its leaf the digest of path, module and content.  A node
is a prefix of places in hexadecimal; its digest is that of its children in order, so at most 16 rows
meet in a node above the leaves.  The leaves' level is deep enough for the number of sources; the few
sources that share a last prefix are digested in order of their place.  The tree depends on the
sources alone, not on how they are spread; a change touches the nodes on one path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

FAN_OUT = 16


def leaves(sources: DataFrame) -> DataFrame:
    """(place, path, digest) of sources (path, module, content); each is digested where it is read."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    framed = lambda c: F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c))
    whole = F.sha2(F.concat(framed("path"), framed("module"), F.sha2(text("content"), 256)), 256)
    return sources.select(F.sha2(text("path"), 256).alias("place"), "path", whole.alias("digest"))


def depth_for(n: int) -> int:
    """Hexadecimal digits of the last level: on average at most one source shares a prefix."""
    return max(1, math.ceil(math.log(max(n, 2), FAN_OUT)))


def _joined(rows: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat(x["place"], F.lit(":"), x["digest"])), ","), 256)


def tree(leaves_: DataFrame, depth: int | None = None) -> DataFrame:
    """(level, prefix, digest, sources): a row for each node; level 0 is the root (an empty tree has it
    alone).  ``depth``: levels below it, by default as the number of leaves asks for."""
    depth = depth or depth_for(leaves_.count())
    count = F.sum("sources").cast("long").alias("sources")
    now = leaves_.withColumn("prefix", F.substring("place", 1, depth)).groupBy("prefix").agg(_joined(F.collect_list(F.struct("place", "digest"))).alias("digest"), F.count("*").alias("sources"))
    out = now = cut(now.select(F.lit(depth).alias("level"), "prefix", "digest", "sources"))
    for level in range(depth - 1, 0, -1):
        up = now.groupBy(F.substring("prefix", 1, level).alias("up")).agg(_joined(F.collect_list(F.struct(F.col("prefix").alias("place"), "digest"))).alias("digest"), count)
        now = cut(up.select(F.lit(level).alias("level"), F.col("up").alias("prefix"), "digest", "sources"))
        out = out.unionByName(now)
    root = now.agg(F.coalesce(_joined(F.collect_list(F.struct(F.col("prefix").alias("place"), "digest"))), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.sum("sources"), F.lit(0)).cast("long").alias("sources"))
    return out.unionByName(root.select(F.lit(0).alias("level"), F.lit("").alias("prefix"), "digest", "sources"))


def root_digest(nodes: DataFrame) -> str:
    return nodes.filter("level = 0").first().digest


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """(prefix): the last-level nodes of two trees of one depth that differ.  A level is looked at only
    below the nodes that differ above it, so the work follows the changes, not the sources."""
    side = lambda t, name: t.select("level", "prefix", F.col("digest").alias(name))
    depth = one.agg(F.max("level")).first()[0]
    at = one.sparkSession.createDataFrame([("",)], "prefix string")
    for level in range(0, depth + 1):
        here = [t.filter(F.col("level") == level) for t in (one, other)]
        if level:
            here = [t.withColumn("up", F.substring("prefix", 1, level - 1)).join(at.select(F.col("prefix").alias("up")), "up", "left_semi").drop("up") for t in here]
        both = side(here[0], "a").join(side(here[1], "b"), ["level", "prefix"], "full")
        at = cut(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix"))
        if at.isEmpty():
            break
    return at


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between two tables of leaves, found through their trees."""
    depth = depth_for(max(before.count(), after.count()))
    at = differing(tree(before, depth), tree(after, depth))
    near = lambda t, name: t.withColumn("prefix", F.substring("place", 1, depth)).join(at, "prefix", "left_semi").select("path", F.col("digest").alias(name))
    both = near(before, "a").join(near(after, "b"), "path", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
