"""The driver's star schema seen as fact tables: lines are callables, orders types, customers
files, nations modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as type declarations, with an extension for every fifth and a second declaration
    for every hundredth; their fields are the residues of their lines' parts."""
    fields = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set((F.col("l_partkey") % 20).cast("string")).alias("property_names"))
    orders = t(spark, sf, "orders").join(fields, "o_orderkey", "left")
    base = orders.select(
        F.col("o_orderpriority").alias("module"), F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "class").otherwise("struct").alias("kind"),
        F.lit(False).alias("is_extension"), F.floor(F.col("o_totalprice") / 1000).alias("code_lines"), F.coalesce("property_names", F.array().cast("array<string>")).alias("property_names"),
    )
    key = F.col("name").cast("long")
    extra = base.filter(key % 5 == 0).select("module", "name", "kind", F.lit(True).alias("is_extension"), F.lit(7).cast("long").alias("code_lines"), F.array(F.lit("x")).alias("property_names"))
    twice = base.filter(key % 100 == 1)
    return base.unionByName(extra).unionByName(twice)


def functions(spark: SparkSession, sf: str) -> DataFrame:
    orders = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    lines = t(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_orderpriority").alias("module"), F.col("l_orderkey").cast("string").alias("owner"), F.when(F.col("l_returnflag") != "R", "method").otherwise("accessor").alias("kind"),
        F.col("l_quantity").cast("long").alias("code_lines"), F.col("l_linenumber").cast("long").alias("complexity"), (F.col("l_suppkey") % 14).alias("parameters"),
        F.array((F.col("l_partkey") % 20).cast("string")).alias("bare_refs"), F.array((F.col("l_suppkey") % 20).cast("string")).alias("self_refs"),
    )


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import clones

    return clones.code_lines(t(spark, sf, "documents"), "doc_id", "text")


def order_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of each order: four structural rows, one that can be missing and a dampener."""
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.countDistinct("l_partkey").alias("parts"), F.max("l_linenumber").alias("deepest"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )
    items = t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    have = F.col("n").isNotNull()
    state = F.when(have, "available").otherwise("unavailable")
    limit = lambda c, k: F.when(F.col(c).isNotNull(), F.least(F.lit(100.0), F.col(c) * 100.0 / k))
    row = lambda kind, req, st, w, s: F.struct(F.lit(kind).alias("kind"), F.lit(req).alias("requirement"), st.alias("state"), F.lit(w).alias("weight"), s.alias("normalized_score"))
    rows = F.array(
        row("swift.function-lines", "optional", state, 0.5, limit("qty", 200)),
        row("swift.method-count", "optional", state, 1.0, limit("n", 8)),
        row("swift.property-count", "optional", state, 2.0, limit("parts", 8)),
        row("git-history.change-frequency", "optional", F.when(F.col("returned") > 0, "available").otherwise("unavailable"), 1.0, F.when(F.col("returned") > 0, F.least(F.lit(100.0), F.col("returned") * 40.0))),
        row("compiler.bindings", "required", F.when(F.col("o_orderkey") % 50 == 0, "unavailable").otherwise("available"), 1.0, F.when(F.col("o_orderkey") % 50 != 0, F.lit(60.0))),
        row("coverage.lcov", "optional", F.when(F.col("o_orderkey") % 4 == 0, "measuredCoverage").otherwise("unavailable"), 1.0, F.when(F.col("o_orderkey") % 4 == 0, F.lit(50.0) + F.col("o_orderkey") % 50)),
    )
    flat = items.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("file"), F.explode(rows).alias("e"))
    return flat.select("item_id", "file", F.concat_ws(":", F.col("item_id").cast("string"), "e.kind").alias("id"), "e.*")


#: The same evidence in SQL.
EVIDENCE_SQL = """
l as (select l_orderkey, count(*) n, sum(l_quantity) qty, count(distinct l_partkey) parts, count(*) filter (l_returnflag = 'R') returned from lineitem group by 1),
i as (select o_orderkey as item_id, o_custkey as file, n, qty, parts, coalesce(returned, 0) returned from orders left join l on o_orderkey = l_orderkey),
ev as (
  select item_id, file, 'swift.function-lines' kind, 'optional' req, n is not null ok, 0.5 w, least(100.0, qty * 100.0 / 200) s from i
  union all select item_id, file, 'swift.method-count', 'optional', n is not null, 1.0, least(100.0, n * 100.0 / 8) from i
  union all select item_id, file, 'swift.property-count', 'optional', n is not null, 2.0, least(100.0, parts * 100.0 / 8) from i
  union all select item_id, file, 'git-history.change-frequency', 'optional', returned > 0, 1.0, least(100.0, returned * 40.0) from i
  union all select item_id, file, 'compiler.bindings', 'required', item_id % 50 <> 0, 1.0, 60.0 from i
  union all select item_id, file, 'coverage.lcov', 'optional', item_id % 4 = 0, 1.0, 50.0 + item_id % 50 from i),
"""
SCORE_SQL = """
agg as (select {k}, sum(case when ok and kind not like 'coverage.%' then w end) aw, sum(case when ok and kind not like 'coverage.%' then w * cast(s as double) end) ws,
  coalesce(product(case when ok and kind like 'coverage.%' then cast(s as double) / 100 end), 1) f, count(*) filter (not ok and req = 'required') miss, sum(w) cw,
  count(*) filter (ok) av, count(*) filter (not ok) un from ev group by {k}),
sc as (select *, case when miss = 0 and aw > 0 then greatest(0, ws / aw * f) end score, case when aw > 0 then ws / aw end base from agg)
"""
