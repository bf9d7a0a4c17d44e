"""Quality classifier: random Fourier features of document statistics, ridge, isotonic scores.

1. Each text becomes ``len(STATS)`` statistics of its characters, words and lines.
2. ``FEATURES`` random Fourier features approximate a Gaussian kernel over the standardised
   statistics: ``sqrt(2/D) cos(W s + b)``.
3. Ridge: tasks sum ``F'F`` and ``F'y`` over all labelled rows that may be learned from, and
   the driver solves the normal equations of fixed size.
4. Isotonic calibration: labels per bin of the raw score (``BINS`` bins) are pooled to a
   non-decreasing share; the score is that share, between bins by linear interpolation.

Rows whose ``crc32(doc_id as text) mod 4`` is 2 are held out.  Only the text is an input.

Defined results: a null or empty text is scored by its statistics (all zero); repeated rows
score alike; of a doc_id that is labelled twice the larger label counts; a null doc_id is never
learned from and not held out; with no labels of both kinds every score is the mean label, 0.5
if there is none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

STATS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "exclaim", "bar", "space",
    "distinct_words", "top_word", "repeated_word", "distinct_lines", "short_lines", "symbol_words", "line_words",
)
FEATURES = 192
KERNEL_WIDTH = 3.0
RIDGE = 1e-3
BINS = 512
SEED = 42
PREDICT_AT = 0.7
#: Tasks that add up the sums of all others; so many matrices of fixed size reach the driver.
SUM_TASKS = 8
_symbols = re.compile(r"[^\w\s.,;:'\"!?()|-]")


def statistics(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [math.log1p(chars)] + [0.0] * (len(STATS) - 1)
    seen = Counter(words)
    lines = text.split("\n")
    upper = sum(map(len, re.findall(r"[A-Z]+", text))) if text.isascii() else sum(map(str.isupper, text))
    digits = sum(map(len, re.findall(r"[0-9]+", text)))
    symbols = len(_symbols.findall(text))
    twice = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(chars), math.log1p(n), (chars - n) / n, upper / chars, digits / chars, symbols / chars, text.count("!") / chars,
        text.count("|") / chars, n / chars, len(seen) / n, max(seen.values()) / n, twice / n, len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), symbols / n, math.log1p(n / len(lines)),
    ]


def with_statistics(docs: DataFrame, text: str = "text", out: str = "__cl_stats") -> DataFrame:
    return common.map_texts(docs, text, lambda: lambda texts: ([statistics(t) for t in texts],), [T.StructField(out, T.ArrayType(T.DoubleType()))])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Features:
    """Standardisation and the random Fourier map."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.standard_normal((len(STATS), FEATURES)) / KERNEL_WIDTH
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        f = np.cos(z @ self.w + self.b) * math.sqrt(2 / FEATURES)
        return np.hstack([f, np.ones((len(f), 1))])


def pooled(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of the means ``sums / weights`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, s in zip(weights, sums, strict=True):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, k2 = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += s2
            blocks[-1][2] += k2
    return np.concatenate([np.full(int(k), s / w) for w, s, k in blocks]) if blocks else np.zeros(0)


class Model:
    """A calibrated scorer; ``level`` is its score where nothing could be learned."""

    def __init__(self, level: float, features: Features | None = None, beta: np.ndarray | None = None):
        self.level, self.features, self.beta = level, features, beta
        self.at = self.share = np.zeros(0)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None or not len(self.at):
            return np.full(len(stats), self.level)
        # Rounded, since a product of matrices depends on the batch in its last bits.
        return np.round(np.clip(np.interp(self.raw(stats), self.at, self.share), 0, 1), 9)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), dtype=float).reshape(-1, len(STATS))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", column: str = "__cl_stats") -> Model:
    """Fit on all labelled rows of ``stats`` (kept in the shared folder) that aren't held out."""
    given = labels.select(F.col(key), F.col(label).cast("double").alias("__cl_y")).dropna().groupBy(key).agg(F.max("__cl_y").alias("__cl_y"))
    rows = common.stash(stats.select(key, column).filter(~held_out(F.col(key))).join(given, key).select(F.col(column).alias("s"), F.col("__cl_y").alias("y")), "quality-rows")
    of = [F.col("s")[i] for i in range(len(STATS))]
    row = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(of)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(of)]).first()
    if not row.n or row.y in (0.0, 1.0):
        return Model(0.5 if row.y is None else row.y)
    features = Features(np.array([row[f"m{i}"] for i in range(len(STATS))]), np.array([row[f"d{i}"] for i in range(len(STATS))]))
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            f, y = features(_matrix(b.column(0))), np.asarray(b.column(1).to_pylist())
            gram += f.T @ f
            right += f.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros(size * size), np.zeros(size)
        for b in batches:
            for g, r in zip(b.column(0), b.column(1), strict=True):
                gram += np.frombuffer(g.as_buffer())
                right += np.frombuffer(r.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    # Every task sums its own rows; only those sums move, and few tasks add them up.
    parts = rows.mapInArrow(sums, "gram binary, right binary").repartition(SUM_TASKS).mapInArrow(added, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(p.gram).reshape(size, size) for p in parts)
    right = sum(np.frombuffer(p.right) for p in parts)
    model = Model(row.y, features, np.linalg.solve(gram + RIDGE * row.n / size * np.eye(size) * 0.1, right))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, at = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            raw, y = model.raw(_matrix(b.column(0))), np.asarray(b.column(1).to_pylist())
            k = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            n += np.bincount(k, minlength=BINS)
            s += np.bincount(k, weights=y, minlength=BINS)
            at += np.bincount(k, weights=raw, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(s), pa.array(at)], names=["bin", "n", "s", "at"])

    bins = rows.mapInArrow(binned, "bin long, n double, s double, at double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("at").alias("at")).filter("n > 0").orderBy("bin").toPandas()
    common.release(rows)
    model.share = pooled(bins["n"].to_numpy(), bins["s"].to_numpy())
    model.at = (bins["at"] / bins["n"]).to_numpy()
    return model


def score(stats: DataFrame, model: Model, column: str = "__cl_stats", out: str = "score") -> DataFrame:
    """``stats`` with the calibrated score in ``out`` (a column of that name is replaced)."""
    at, kept = stats.columns.index(column), [k for k, c in enumerate(stats.columns) if c != out]
    names = [*(stats.columns[k] for k in kept), out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(model.scores(_matrix(b.column(at))))], names=names)

    common.ship(stats.sparkSession)
    return stats.mapInArrow(run, T.StructType([*(stats.schema.fields[k] for k in kept), T.StructField(out, T.DoubleType())]))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = common.stash(with_statistics(docs).select("doc_id", "__cl_stats"), "quality-statistics")
    model = fit(stats, common.table(spark, sf_dir, "labels"))
    return score(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
