"""Every operator and stage on nulls, empty and very long texts, repeated rows, ties, empty tables
and further columns with clashing names."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeledger.llm import bpe_codec, common, decontam, media, pii, quality, secrets, simhash, token_count, toxicity, url_filter

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Names that the operators themselves add or use.
CLASH = ["n_tokens", "score", "file", "digest", "term", "key", "row", "fp", "label", "y", "w", "number", "item", "tokens", "kept", "copy", "ids", "n_bytes", "host", "rule"]


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "mi", "tu", "re", "la", "é"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(31)
    texts = [None, "", " \n\t ", words(rng, 60_000), words(rng, 40), "a@b.org password=abcdefgh " + words(rng, 30), "x" * 200_000, "日本 語 " * 50]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[0], (None, texts[4], None, "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}), len(rows)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(8)] + [(4, 1, 0), (None, 1, 1), (3, None, None), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def bench(spark, odd):
    texts = [r.text for r in odd[0].filter("doc_id = 4").select("text").collect()]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, None), (4, ""), (None, texts[0])]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("number", F.lit("clash"))


def same_for_equal_texts(df, columns):
    """Rows of equal texts have equal results."""
    seen = {}
    for r in df.collect():
        assert seen.setdefault(r.text, tuple(r[c] for c in columns)) == tuple(r[c] for c in columns), r.doc_id


MAPS = {
    "op1": (lambda d: token_count.count_tokens(d, JSON, PATTERN), ["n_bytes", "n_tokens", "over_limit"]),
    "op3": (lambda d: bpe_codec.round_trip_digests(d, RANKS, PATTERN), ["n_tokens", "ids_sha256", "decoded_sha256"]),
    "op4": (lambda d: secrets.scan(d), ["__cl_found"]),
    "op7": (lambda d: quality.with_statistics(d), ["__cl_stats"]),
    "op8": (lambda d: simhash.with_fingerprints(d), [simhash.FINGERPRINT]),
}


@pytest.mark.parametrize("name", sorted(MAPS))
def test_maps_keep_every_row_and_no_column_twice(odd, name):
    docs, n = odd
    make, columns = MAPS[name]
    out = make(docs)
    assert len(set(out.columns)) == len(out.columns) and set(docs.columns) <= set(out.columns)
    assert out.count() == n
    same_for_equal_texts(out, columns)
    assert make(docs.limit(0)).count() == 0


def test_personal_data(odd):
    docs, n = odd
    out = pii.find(docs)
    assert out.count() == n and [s.kind for s in out.filter("doc_id = 5").first()["__cl_found"]][0] == "email"
    assert all(not r["__cl_found"] for r in out.collect() if r.doc_id != 5)


def test_media(odd):
    docs, n = odd
    out = media.with_media(docs)
    assert out.count() == n and out.filter("payload_sha256 is null or media_bytes <> payload_bytes + 44").count() == 0
    assert {r.n_bytes for r in out.filter("doc_id in (0, 1) or doc_id is null and n_bytes = 0").collect()} == {0}


def test_quality(odd, labels):
    docs, n = odd
    stats = quality.with_statistics(docs)
    out = quality.score(stats, quality.fit(stats, labels))
    assert out.count() == n and out.filter("score is null or score < 0 or score > 1").count() == 0
    same_for_equal_texts(out, ["score"])


def test_toxicity(odd, labels):
    docs, n = odd
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == n
    same_for_equal_texts(out, ["__cl_severity", "__cl_toxic_p"])
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns


def test_components(spark, odd):
    docs, n = odd
    rows = common.stash(simhash.with_fingerprints(docs).select("doc_id", simhash.FINGERPRINT))
    out = simhash.with_components(rows)
    assert out.count() == n
    of = {r.doc_id: r.component_id for r in out.filter("doc_id is not null").collect()}
    assert of[0] == of[1] == of[2] == 0 and of[4] == 4
    assert simhash.with_components(rows.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, 5), (None, 5)], f"doc_id long, {simhash.FINGERPRINT} long")
    assert [r.component_id for r in simhash.with_components(alone).collect()] == [None, None]
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({0, 3, 4, 5, 6, 7})


def test_decontamination(odd, bench):
    docs, n = odd
    got = [(r.doc_id, r.item_id) for r in decontam.hits(docs, bench).collect()]
    # Three rows of document 4 and one without an id hold the text; it is listed under 1 twice, 2 and null.
    assert sorted(got, key=str) == sorted([(d, i) for d in (4, 4, 4, None) for i in (1, 1, 2, None)], key=str)
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == n - 4


def test_urls(spark, labels):
    urls = [None, "", "://", "http://", "http://" + "a." * 5_000 + "net/" + "p/" * 5_000, "http://bad.io/x", "http://bad.io/x", "no", "HTTP://EXAMPLE.NET/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(5, urls[5]), (None, urls[5])], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "tokens", "verdict", "anchor", "bad", "id")})
    out = url_filter.judge(pages, labels).collect()
    assert len(out) == len(urls) + 2 and all(r.verdict in ("allow", "block") for r in out)
    at = {r.page_id: r for r in out}
    assert at[4].rule == "net/" and at[8].rule == "example.net/en/" and (at[2].host, at[2].path) == ("", "")


def test_ties_of_mined_rules_are_decided_alike(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MIN_ROWS", 2)
    rows = [(i, f"http://{'bad' if i % 2 else 'ok'}.io/{'spam' if i % 2 else 'fine'}/{i % 4 // 2}") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    first = {r.page_id: (r.verdict, r.mined_rule) for r in url_filter.judge(pages, labels).collect()}
    again = {r.page_id: (r.verdict, r.mined_rule) for r in url_filter.judge(pages.repartition(7), labels.repartition(5)).collect()}
    assert first == again and {v for i, (v, _) in first.items() if i % 2} == {"block"} and len({m for i, (_, m) in first.items() if i % 2}) == 1


def test_pipeline_stages(spark, odd, tmp_path, labels, bench):
    docs, _ = odd
    labels.select("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    bench.select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = common.stash(stage(spark, docs, str(tmp_path)))
        assert out.count() <= before, name
        if name != "bpe_encode":
            assert out.columns == docs.columns, name
            docs = out
    assert {"doc_id", "token_ids"} <= set(out.columns) and all(r.n_tokens == len(r.token_ids) for r in out.collect())
