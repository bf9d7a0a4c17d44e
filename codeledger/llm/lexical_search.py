"""Ranked lexical search: WAND in shards of documents, and their heaps merged.

1. Statistics: one narrow pass over the texts writes, for each document, its length and the
   frequencies of the terms that any query has; counts over that table are the corpus statistics.
2. Search: each task takes its shard of that table in segments of ``SEGMENT`` documents, turns each
   into postings (term, document, impact) and runs WAND for every query.  The terms are put in the
   order of their next documents; the first one at which the sum of the terms' maximum impacts
   reaches the heap's threshold is the pivot, and no document before the pivot's can enter the
   heap.  The documents from the pivot on are scored, ``WINDOW`` at once (with array operations), and
   the next pivot is looked for behind them.  A heap lives on from one segment to the next of its task.
3. The heaps of all tasks (at most k documents for each query and task) are merged.

A document is passed over only if its upper bound is below the threshold, so ties are decided by
the key alone and the result doesn't depend on the shards.  Queries go in blocks of about
``BLOCK_TERMS`` terms, each with a pass of its own; a block's terms and statistics are what goes to
the driver and to every task.

Scores are integers: those of the contract, in 64 bits (sums stay below 2^53, so array sums in
doubles are exact).

Defined results: a null text has no terms and ranks nowhere; a query without terms has no rows;
each row of the queries is a query of its own, also with an equal or null key; a document
without a key comes last among equal scores; repeated documents are ranked each; empty tables
give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe_codec import spread

TOP = 10
BLOCK_TERMS = 50_000
SEGMENT = 16_384
#: Documents that are scored at once.
WINDOW = 64
_NO_KEY = -(1 << 63)
#: Of a text's bytes: letters and digits in lower case, all that isn't ASCII as it is, the rest spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return (text or "").encode().translate(_TABLE).split()


class Statistics(NamedTuple):
    """Of all documents: how many have a term, their terms with repeats, and each term's weight."""

    documents: int
    length: int
    weight: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 10 + (90 * size * self.documents) // max(self.length, 1)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Segment:
    """Postings of some documents, by term and then by document."""

    def __init__(self, n: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.n = n
        keys = term.astype(np.int64) * n + doc
        order = np.argsort(keys, kind="stable")
        self.keys, self.doc, self.impact = keys[order], doc[order], impact[order].astype(np.float64)
        self.terms, begins = np.unique(term[order], return_index=True)
        self.most = np.maximum.reduceat(self.impact, begins) if len(begins) else np.zeros(0)

    def wand(self, terms: np.ndarray, ids: list[int], heap: list[tuple[int, int]], k: int, window: int = 0) -> int:
        """Push into ``heap`` (score, -id) what belongs to the k best; returns how many documents were scored."""
        window = window or WINDOW
        at = np.searchsorted(self.terms, terms)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == terms[here]
        most, base = self.most[at[here]], terms[here].astype(np.int64) * self.n
        if not len(base):
            return 0
        scored, pos = 0, 0
        stop = np.searchsorted(self.keys, base + self.n)
        first = np.searchsorted(self.keys, base)
        while True:
            threshold = heap[0][0] if len(heap) == k else 1
            live = np.flatnonzero(first < stop)
            if not len(live):
                return scored
            following = self.doc[first[live]]
            order = np.argsort(following, kind="stable")
            reach = np.searchsorted(most[live][order].cumsum(), threshold)
            if reach == len(order):
                return scored  # all that is left together stays below the threshold
            pivot = int(following[order[reach]])
            pos = min(pivot + window, self.n)
            begin, end = np.searchsorted(self.keys, base + pivot), np.searchsorted(self.keys, base + pos)
            which = spread(begin, end - begin)
            score = np.bincount(self.doc[which] - pivot, weights=self.impact[which], minlength=pos - pivot)
            scored += pos - pivot
            for i in np.flatnonzero(score >= threshold).tolist():
                entry = (int(score[i]), ids[pivot + i])
                if len(heap) < k:
                    heappush(heap, entry)
                elif entry > heap[0]:
                    heapreplace(heap, entry)
            first = end


def with_frequencies(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, size, terms, tfs) of each document that has a term; ``terms`` only of the vocabulary."""
    common.ship(docs.sparkSession)
    common.short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys, sizes, terms, tfs = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(t)
                if words:
                    counts = {known[w]: c for w, c in Counter(words).items() if w in known}
                    keys.append(k)
                    sizes.append(len(words))
                    terms.append(list(counts.keys()))
                    tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["key", "size", "terms", "tfs"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, size long, terms array<int>, tfs array<int>")


def heaps_of(table: DataFrame, queries: list[tuple[int, list[int]]], stats: Statistics, k: int) -> DataFrame:
    """(query, key, score): the heaps of each task over its shard of ``table``."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((queries, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, told = shared.value
        asked = [(q, np.array(sorted(t), np.int64)) for q, t in asked]
        heaps: dict[int, list[tuple[int, int]]] = {q: [] for q, _ in asked}

        def search(part: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(part).combine_chunks()
            many = whole["terms"].combine_chunks().value_lengths().to_numpy()
            term, tf = (whole[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(many)), many)
            segment = Segment(len(many), doc, term, told.impacts(term, tf, whole["size"].to_numpy()[doc]))
            ids = [_NO_KEY if i is None else -i for i in whole["key"].to_pylist()]
            for q, terms in asked:
                segment.wand(terms, ids, heaps[q], k)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SEGMENT:
                search(held)
                held = []
        if sum(b.num_rows for b in held):
            search(held)
        rows = [(q, None if i == _NO_KEY else -i, s) for q, heap in heaps.items() for s, i in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "key", "score"])

    return table.mapInArrow(run, "query long, key long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_key, rank, key, score): the k best documents of each query, equal scores by key."""
    spark = docs.sparkSession
    split = F.split(F.translate(F.col(query_text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = F.array_distinct(F.filter(split, lambda x: x != ""))
    asked = common.stash(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_key).alias("__cl_key"), own.alias("own")).filter("size(own) > 0"), "queries")
    total = asked.agg(F.sum(F.size("own"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    found = None
    for b in range(blocks):
        block = [(r["query"], r["own"]) for r in asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "own").collect()]
        names = sorted({t for _, own in block for t in own})
        number = {t: i for i, t in enumerate(names)}
        table = common.stash(with_frequencies(docs, {t.encode(): i for t, i in number.items()}, key, text), "frequencies")
        n, length = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        df = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        stats = Statistics(n, length, np.array([weight(n, df.get(i, 0)) for i in range(len(names))], np.int64))
        heaps = common.stash(heaps_of(table, [(q, [number[t] for t in own]) for q, own in block], stats, k), "heaps")
        common.release(table)
        found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        found = spark.createDataFrame([], "query long, key long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "__cl_key"), "query").select(F.col("__cl_key").alias(query_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, common.table(spark, sf_dir, "benchmark"))
