"""Dependency graph: nodes, coupling, contexts, statistics, DOT text.

Edges: (source, target, confidence) with multiplicity; only resolved ones count for coupling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(modules: DataFrame, types: DataFrame, callables: DataFrame) -> DataFrame:
    """(kind, id): modules (module), types (module, name), callables (name, file, line, column)."""
    return (
        modules.select(F.lit("module").alias("kind"), F.concat(F.lit("module:"), "module").alias("id"))
        .unionByName(types.select(F.lit("type").alias("kind"), F.concat(F.lit("type:"), F.concat_ws(".", "module", "name")).alias("id")))
        .unionByName(callables.select(F.lit("callable").alias("kind"), F.concat(F.lit("callable:"), F.col("name"), F.lit("@"), F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"))).alias("id")))
    )


def module_edges(references: DataFrame) -> DataFrame:
    """Resolved references across modules, distinct with their location."""
    return references.filter(F.col("source_module") != F.col("target_module")).distinct()


def coupling(edges: DataFrame, is_test: str | None = None) -> DataFrame:
    """(id, afferent, efferent, fan_in, fan_out, callers_test, callers_production, instability):
    afferent and efferent count edges, fans count distinct neighbours.  A node with no edges has
    no row.  Every edge is read once, at both of its ends, and summed before the shuffle."""
    live = edges.filter("confidence = 'resolved'") if "confidence" in edges.columns else edges
    test = F.col(is_test) if is_test else F.lit(False)
    pairs = live.groupBy("source", "target").agg(F.count("*").alias("n"), F.max(test).alias("test"))
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("target").alias("id"), F.col("n").alias("inn"), F.lit(0).cast("long").alias("out"), F.lit(1).alias("fi"), F.lit(0).alias("fo"), F.col("test").cast("int").alias("ct")),
        F.struct(F.col("source").alias("id"), F.lit(0).cast("long").alias("inn"), F.col("n").alias("out"), F.lit(0).alias("fi"), F.lit(1).alias("fo"), F.lit(0).alias("ct")),
    )).alias("e")).select("e.*")
    per = ends.groupBy("id").agg(F.sum("inn").alias("afferent"), F.sum("out").alias("efferent"), F.sum("fi").alias("fan_in"), F.sum("fo").alias("fan_out"), F.sum("ct").alias("callers_test"))
    both = F.col("afferent") + F.col("efferent")
    return per.select("id", "afferent", "efferent", "fan_in", "fan_out", "callers_test", (F.col("fan_in") - F.col("callers_test")).alias("callers_production"), F.try_divide(F.col("efferent").cast("double"), both).alias("instability"))


def _resolved(edges: DataFrame) -> DataFrame:
    return edges.filter("confidence = 'resolved'") if "confidence" in edges.columns else edges


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, direction, neighbour): what each node depends on (upstream) and what depends on it
    (downstream), one step away, as rows: a node may have very many."""
    pairs = _resolved(edges).select("source", "target").distinct()
    up = pairs.select(F.col("source").alias("id"), F.lit("upstream").alias("direction"), F.col("target").alias("neighbour"))
    return up.unionByName(pairs.select(F.col("target").alias("id"), F.lit("downstream").alias("direction"), F.col("source").alias("neighbour")))


def context(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, callers, score): neighbours one step away, and the score
    min(100, 10 fan-in + 10 fan-out + 5 callers).  Callers are the sources of edges of the kind
    ``call`` (of all edges if they have no kind).  Sums run before the shuffle."""
    live = _resolved(edges)
    call = F.col("kind") == "call" if "kind" in live.columns else F.lit(True)
    pairs = live.groupBy("source", "target").agg(F.max(call).alias("call"))
    end = lambda c, i, o, k: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"), k.alias("c"))
    ends = pairs.select(F.explode(F.array(end("target", 1, 0, F.col("call").cast("int")), end("source", 0, 1, F.lit(0)))).alias("e")).select("e.*")
    per = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("c").alias("callers"))
    return per.withColumn("score", F.least(F.lit(100.0), (10 * F.col("fan_in") + 10 * F.col("fan_out") + 5 * F.col("callers")).cast("double")))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: edges by confidence."""
    return edges.agg(F.count("*").alias("edges"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("resolved", "ambiguous", "unresolved")])


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line): a DOT statement for each distinct edge, quotes and backslashes escaped."""
    esc = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return edges.select(F.concat(F.lit('  "'), esc("source"), F.lit('" -> "'), esc("target"), F.lit('";')).alias("line")).distinct()
