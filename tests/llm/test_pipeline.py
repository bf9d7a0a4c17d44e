"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from codeledger.llm import common, registry, sql

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before


def test_stages_take_empty_tables(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        docs = out if name != "bpe_encode" else docs


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.execute(sql.ORACLES[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = [c for c in ("conv_id", "item_id", "rank", "doc_id") if c in want.columns]
    got, want = (x.sort_values(order).reset_index(drop=True) for x in (got[want.columns], want))
    assert len(got) == len(want) and (got.astype(str) == want.astype(str)).all().all()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(sql.ORACLES) <= set(registry.queries())
