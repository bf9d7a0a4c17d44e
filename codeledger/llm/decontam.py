"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark (a word: the lower-cased letters and digits of what
   stands between white space).  One pass over all documents counts their document frequencies;
   a term's weight is its squared idf (idf on either side of a product).
2. Passages of the benchmark are windows of ``WINDOW`` words at every ``STEP`` words, as TF-IDF rows
   of norm 1.  Their matrix A is reduced by a distributed randomised SVD: tasks sum the sketch
   ``Y = A'(A G)`` for a fixed Gaussian matrix G (``OVERSAMPLE`` columns more than the rank), and the
   single-pass (Nystroem) eigendecomposition of A'A gives the ``RANK`` leading right singular vectors.
3. A second pass over all documents projects their windows (every ``STEP`` words too).  The
   candidates are the windows whose cosine with a passage is at least ``COSINE``: the inner product in
   the latent space over both full norms.  Each candidate (document, item) is verified by the
   longest common subsequence of words around the window: at least ``LCS_SURE`` of the item, or at
   least ``LCS_LIKELY`` with ``ANSWER_SHARE`` of its answer (its last ``ANSWER`` words).

Words strange to the benchmark count in a window's norm, each with the mean weight of the
benchmark's terms.  A projection is no longer than what it projects, so a window's cosine is at most
the share of its norm that benchmark terms have, times the greatest share that a passage keeps;
windows below ``COSINE`` by that bound aren't projected, which loses nothing.  Nothing else stands
between a window and the latent search.

``COSINE`` is what decides which paraphrases are found: its recall against an exhaustive search is
in the README, with that of a random basis, which finds none.

The benchmark's distinct texts are decomposed in blocks of about ``BLOCK_WORDS`` words, and the
documents are read once for ``PASS_BLOCKS`` blocks together, which bounds what the driver and a
task hold; a larger benchmark takes more passes over the documents.

Defined results: null and empty texts are clean; empty items match nothing; an item shorter
than a window is one passage; repeated rows are found again, repeated items under each id (null
ids too); an empty table or benchmark gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, STEP = 16, 8
RANK, OVERSAMPLE = 512, 128
COSINE = 0.3
LCS_SURE, LCS_LIKELY = 0.8, 0.6
ANSWER, ANSWER_SHARE = 6, 0.6
#: Words of one decomposed block (an item longer than that makes a longer one): at most 16 MB of
#: projections, and few enough passages for the rank.  Blocks that one pass over the documents looks for.
BLOCK_WORDS, PASS_BLOCKS = 8_000, 4
SEED = 42
_mark = re.compile(r"[^\w\s]|_")


_marks = "".join(filter(_mark.match, map(chr, range(256)))).encode("latin-1")
_spaced = bytes(32 if chr(i).isspace() else i for i in range(256))


def words_of(text: str) -> list[str]:
    """The lower-cased letters and digits of each stretch between white space that has some."""
    low = text.lower()
    try:  # the same by a table of bytes, which is faster
        return low.encode("latin-1").translate(_spaced, _marks).decode("latin-1").split()
    except UnicodeEncodeError:
        return _mark.sub("", low).split()


#: The number of a word that isn't in the vocabulary.
STRANGE = -1


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Benchmark:
    """A block of items: words, vocabulary and passages."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t or "") for _, t in items]
        self.vocab = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.coded = [[self.vocab[w] for w in ws] for ws in self.words]
        self.passages = [(k, p) for k, ws in enumerate(self.coded) for p in windows_of(ws)]


def windows_of(words: list) -> list[list]:
    """The passages of an item: every STEP words, and the last full one."""
    if not words:
        return []
    starts = list(range(0, max(1, len(words) - WINDOW + 1), STEP))
    if len(words) > WINDOW and (len(words) - WINDOW) % STEP:
        starts.append(len(words) - WINDOW)
    return [words[s : s + WINDOW] for s in starts]


def _coded(texts: list[str], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all texts in a row, and where each text begins."""
    split = [words_of(t) for t in texts]
    starts = np.cumsum([0, *map(len, split)])
    words = itertools.chain.from_iterable(split)
    return np.fromiter(map(vocab.get, words, itertools.repeat(STRANGE)), dtype=np.int32, count=int(starts[-1])), starts


def _steps(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each step of STEP words begins (steps never cross a text), and its text."""
    sizes = np.diff(starts)
    counts = -(-sizes // STEP)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return starts[:-1][text] + (np.arange(len(text)) - first) * STEP, text


def _gaussian(terms: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((terms, RANK + OVERSAMPLE))


def document_frequencies(docs: DataFrame, vocab: dict[str, int], text: str) -> tuple[np.ndarray, int]:
    """In how many documents each term of ``vocab`` stands, and how many documents there are.
    Summed in each task; as many rows come back as there are terms."""
    terms = len(vocab)
    common.ship(docs.sparkSession)
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(terms, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            n += len(texts)
            for t in texts:
                here = vocab.keys() & set(words_of(t))
                df[[vocab[w] for w in here]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *df[at].tolist()], pa.int64())], names=["term", "df"])

    rows = docs.select(text).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(terms, np.int64)
    n = 0
    for r in rows:
        if r.term < 0:
            n = int(r.df)
        else:
            out[r.term] = r.df
    return out, n


#: Tasks that sum up the sketch of a block; so many matrices meet in one task.
SKETCH_TASKS = 2


def fitted(bench: DataFrame, vocab: dict[str, int], weight: np.ndarray, text: str) -> np.ndarray:
    """The leading right singular vectors of the weighted passages of ``bench``, each of norm 1: tasks sum
    ``Y = A'(A G)``, and one more task decomposes the sum; the driver gets the vectors alone."""
    terms = len(vocab)
    common.ship(bench.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _gaussian(terms)
        y = np.zeros(g.shape, np.float64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for codes in windows_of([vocab[w] for w in words_of(t or "")]):
                    at, count = np.unique(codes, return_counts=True)
                    row = weight[at] * count
                    row /= max(float(np.linalg.norm(row)), 1e-12)
                    y[at] += np.outer(row, row @ g[at])
        yield pa.RecordBatch.from_arrays([pa.array([y.astype(np.float32).tobytes()], pa.binary())], names=["y"])

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = sum(np.frombuffer(p, np.float32).reshape(terms, -1).astype(np.float64) for batch in batches for p in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([singular_vectors(y).astype(np.float32).tobytes()], pa.binary())], names=["basis"])

    parts = bench.select(text).coalesce(SKETCH_TASKS).mapInArrow(run, "y binary").repartition(1)  # SKETCH_TASKS rows
    return np.frombuffer(parts.mapInArrow(decompose, "basis binary").first().basis, np.float32).reshape(terms, -1)


def singular_vectors(y: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of A from the sketch ``Y = C G`` of ``C = A'A``: the
    Nystroem approximation ``C ~ F F'`` has them as its left singular vectors."""
    g = _gaussian(len(y))
    shift = 1e-7 * max(float(np.linalg.norm(y)), 1e-12) / max(1.0, float(np.sqrt(len(y))))
    cy = y + shift * g
    core = g.T @ cy
    vals, vecs = np.linalg.eigh((core + core.T) / 2)
    keep = vals > vals.max() * 1e-9
    left, sizes, _ = np.linalg.svd(cy @ (vecs[:, keep] / np.sqrt(vals[keep])), full_matrices=False)
    return left[:, :RANK][:, sizes[:RANK] > sizes[0] * 1e-4]


class Finder:
    """Holds what a task needs: the projected items and the table of term weights."""

    def __init__(self, bench: Benchmark, weight: np.ndarray, basis: np.ndarray):
        self.bench = bench
        rank = basis.shape[1]
        #: Squared weights; the last is that of a strange word (code -1).
        self.square = np.append(weight**2, float(weight.mean()) ** 2 if len(weight) else 1.0)
        self.table = np.vstack([weight[:, None].astype(np.float32) * basis.astype(np.float32, copy=False), np.zeros((1, rank), np.float32)])
        q = np.stack([self.table[codes].sum(axis=0) for _, codes in bench.passages]) if bench.passages else np.zeros((0, rank), np.float32)
        own = np.array([self._norm(codes) for _, codes in bench.passages], dtype=np.float32).reshape(-1, 1)
        self.q = q / np.maximum(own, np.float32(1e-12))
        #: The greatest share of its norm that a passage keeps.
        self.kept = float(np.sqrt((self.q**2).sum(axis=1).max())) if len(q) else 0.0
        self.item = np.array([k for k, _ in bench.passages], dtype=np.int64)

    def _norm(self, codes: list[int]) -> float:
        """The full norm of a passage, as windows have it."""
        return float(np.sqrt(self.square[codes].sum()))

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place): windows whose latent cosine with a passage is at least COSINE."""
        begins, owner = _steps(starts)
        ends = np.append(begins[1:], len(codes))
        same = np.append(owner[1:] == owner[:-1], False)
        last = np.where(same, np.append(ends[1:], len(codes)), ends)  # a window is a step and the next of the same text
        weight = self.square[codes]
        whole = np.append(0.0, weight.cumsum())
        known = np.append(0.0, np.where(codes == STRANGE, 0.0, weight).cumsum())
        norm = whole[last] - whole[begins]
        able = np.flatnonzero((known[last] - known[begins]) * self.kept**2 >= COSINE**2 * norm * (1 - 1e-9))
        for k in range(0, len(able), 2048):
            w = able[k : k + 2048]
            grid = begins[w][:, None] + np.arange(WINDOW)[None, :]
            part = np.where(grid < last[w][:, None], codes[np.minimum(grid, len(codes) - 1)], STRANGE)
            z = self.table[part[:, 0]]
            for j in range(1, WINDOW):
                z = z + self.table[part[:, j]]
            z /= np.sqrt(np.maximum(norm[w], 1e-12)).astype(np.float32)[:, None]
            for a, b in np.argwhere(z @ self.q.T >= COSINE):
                yield int(owner[w[a]]), int(self.item[b]), int(begins[w[a]])

    def find(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text the items that it holds: (place in the block, share of the LCS)."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        codes, starts = _coded(texts, self.bench.vocab)
        if not len(codes) or not len(self.q):
            return out
        pairs: dict[tuple[int, int], list[int]] = {}
        for t, k, place in self.candidates(codes, starts):
            pairs.setdefault((t, k), []).append(place)
        for (t, k), places in pairs.items():
            share = self.verify(codes[starts[t] : starts[t + 1]], k, [p - int(starts[t]) for p in places])
            if share:
                out[t].append((k, share))
        return out

    def verify(self, codes: np.ndarray, k: int, places: list[int]) -> float:
        """The best share of item ``k`` found around ``places``, 0 if it fails the checks."""
        item = self.bench.coded[k]
        n, best = len(item), 0.0
        for p in sorted(set(places)):
            lo, hi = max(0, p - n), min(len(codes), p + n + WINDOW)
            part = codes[lo:hi].tolist()
            here = set(part)
            if sum(w in here for w in item) < LCS_LIKELY * n:
                continue  # more than the subsequence can have
            share = lcs(item, part) / n
            if share >= LCS_SURE or (share >= LCS_LIKELY and lcs(item[-ANSWER:], part) >= ANSWER_SHARE * len(item[-ANSWER:])):
                best = max(best, share)
        return best


def items_of(bench: DataFrame, item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct texts of the benchmark (number, text), and (number, item) for each of its
    rows; kept in the shared folder."""
    given = bench.select(F.col(item).alias("item"), F.col(item_text).alias("text")).dropna(subset=["text"])
    one = common.stash(given.select("text").distinct().withColumn("number", F.monotonically_increasing_id()), "benchmark-texts")
    return one, common.stash(given.join(one, "text").select("number", "item"), "benchmark-items")


def passes(docs: DataFrame, items: DataFrame, text: str = "text") -> Iterator[list[Finder]]:
    """For each pass over the documents the fitted finders of its blocks, over ``items`` (number,
    text) of the benchmark."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    split = items.withColumn("__cl_part", F.pmod(F.xxhash64("text"), F.lit(max(1, blocks))))
    for first in range(0, blocks, PASS_BLOCKS):
        rows = [split.filter(F.col("__cl_part") == k) for k in range(first, min(first + PASS_BLOCKS, blocks))]
        made = [Benchmark([(r.number, r.text) for r in part.collect()]) for part in rows]  # about BLOCK_WORDS words each
        vocab = {w: k for k, w in enumerate(sorted({w for b in made for w in b.vocab}))}
        if not vocab:
            continue
        df, n = document_frequencies(docs, vocab, text)
        found = []
        for part, block in zip(rows, made, strict=True):
            if block.vocab:
                weight = (np.log((1 + n) / (1 + df[[vocab[w] for w in block.vocab]])) + 0.05) ** 2
                found.append(Finder(block, weight, fitted(part, block.vocab, weight, "text")))
        yield found


FOUND = "__cl_items"


def with_items(docs: DataFrame, found: list[Finder], text: str = "text") -> DataFrame:
    """``docs`` with the benchmark texts that each text holds, and the best share, in FOUND."""
    kind = T.ArrayType(T.StructType([T.StructField("number", T.LongType()), T.StructField("lcs_share", T.DoubleType())]))
    held = docs.sparkSession.sparkContext.broadcast(found)  # PASS_BLOCKS blocks

    def make():
        own = held.value

        def work(texts: list[str]):
            whole: list[list[dict]] = [[] for _ in texts]
            for f in own:
                for got, more in zip(whole, f.find(texts), strict=True):
                    got.extend({"number": f.bench.ids[k], "lcs_share": share} for k, share in more)
            return (whole,)

        return work

    return common.map_texts(docs, text, make, [T.StructField(FOUND, kind)])


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item.  Each pass reads what the one before
    it kept."""
    items, _ = items_of(bench)
    kept = None
    for found in passes(docs, items, text):
        before = docs if kept is None else common.stash(kept, "decontaminated")
        kept = with_items(before, found, text).filter(F.size(FOUND) == 0).select(*docs.columns)
    return docs if kept is None else kept


def hits(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, lcs_share): every document that holds an item, under each id of the item."""
    items, ids = items_of(bench)
    rows = None
    for found in passes(docs, items, text):
        more = with_items(docs.select(key, text), found, text).select(key, F.explode(FOUND).alias("hit")).select(key, "hit.number", "hit.lcs_share")
        rows = more if rows is None else rows.unionByName(more)
    if rows is None:
        rows = docs.sparkSession.createDataFrame([], T.StructType([docs.schema[key], T.StructField("number", T.LongType()), T.StructField("lcs_share", T.DoubleType())]))
    return rows.join(ids, "number").select(key, F.col("item").alias("item_id"), "lcs_share")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, lcs_share): every document that holds an item; clean ones have no row."""
    return hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
