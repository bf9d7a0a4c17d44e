"""Findings of the third round."""

from __future__ import annotations

import datetime
import time

import duckdb
import numpy as np
import pytest

from codeledger.llm import graph
from codeledger.operators import evidence, vector_index, vectors
from codeledger.plans import catalog


def compared(spark, sf, name):
    """Rows of a query and of its SQL over the tables in ``sf``, sorted by their text."""
    with duckdb.connect() as c:
        for f in sf.iterdir():
            c.execute(f"create view {f.stem} as select * from '{f}/*.parquet'")
        want = c.sql(f"select * from ({catalog.oracle_sql()[name]})")
        got = catalog.queries()[name](spark, str(sf)).select(*want.columns).collect()
        return sorted(map(tuple, got), key=str), sorted(want.fetchall(), key=str)


def test_files_without_commits_as_the_sql_has_them(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    day = datetime.date(1998, 12, 2)
    spark.createDataFrame([(7, 1, "F", "1-URGENT", day), (8, 1, "O", "5-LOW", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    got, want = compared(spark, tmp_path, "unavailable_history")
    assert got == want and len(got) == 8
    assert {r[0]: (r[1], r[3]) for r in got if r[0].startswith("file:2:")} == {f"file:2:git-history:{k}": ("unavailable", s) for k, s in (("change-frequency", 100.0), ("recency", 100.0), ("fix-orientation", None), ("contributor-concentration", None))}


def test_the_operator_gives_no_score_without_commits(spark):
    items = spark.createDataFrame([("file:2", None, "2", 1, 1)], "item_id string, module string, file string, line long, column long")
    commits = spark.createDataFrame([], "path string, sha long, author_token string, ts timestamp, subject string")
    rows = evidence.history_evidence(items, commits, "1999-01-01 00:00:00").select("state", "normalized_score").collect()
    assert [tuple(r) for r in rows] == [("unavailable", None)] * 4


def test_a_set_of_queries_is_compared_in_blocks_in_time(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_000, 64)).astype(np.float32)
    x[1::97] = x[0]  # equal distances
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    began = time.monotonic()
    got = {(r.query_id, r.vec_id): r.distance for r in catalog.queries()["knn_pruned_cosine"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 100
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {}
    for q in range(0, len(x), 50):
        far = 1 - unit @ unit[q]
        want |= {(q, int(k)): far[k] for k in sorted(range(len(x)), key=lambda k, far=far: (round(far[k], 12), k))[:3]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocks_of_few_rows_and_keys_of_text(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 7 * 5 * 8)
    monkeypatch.setattr(vector_index, "AT_ONCE", 3)
    rng = np.random.default_rng(6)
    x = np.concatenate([v := rng.normal(size=(150, 5)), v[:40], v[:40]])
    df = spark.createDataFrame([(f"k{k * 37 % 230}", v.tolist()) for k, v in enumerate(x)], "id string, vector array<double>")
    index = vector_index.PivotIndex.build(df, str(tmp_path / "i"), metric, pivots=9)
    asked = df.filter("id like '%3'")
    top, _ = index.nearest_to_each(asked, 4)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, vectors.nearest_to_each(df, asked, 4, metric).collect()))


def test_components_need_no_jobs_to_see_that_they_are_done(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([(1, k) for k in range(2, 9)], "u long, v long")).collect()}
    assert got == dict.fromkeys(range(1, 9), 1) and jobs() - before < 20
