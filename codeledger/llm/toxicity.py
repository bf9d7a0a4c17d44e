"""Toxicity: cumulative-link (proportional odds) ordinal regression over sparse text features.

``P(grade > j | x) = sigmoid(w.x - theta_j)`` with one weight vector for all thresholds
``theta_1 < ... < theta_K``; the result is the expected grade ``sum_j P(grade > j)``.  Weights and
thresholds maximise the likelihood of the grades, ``P(grade = j) = P(grade > j-1) - P(grade > j)``,
with a ridge.  The thresholds are ordered by their form: each is the one before it plus the
exponential of a free parameter.

Labels hold one bit.  Grades are made from it: 0 for documents that aren't toxic; toxic ones
get 1, 2 or 3 by thirds of the number of terms in them that the labels show to be toxic.
Features: presence of a term (lower-cased word); terms are all those whose share among toxic
documents differs from that among the others by ``MIN_Z`` standard errors.

Copies would make the words of one mislabelled text look toxic.  So rows of the sample whose
three-word shingles have the same least hashes under two hash functions (near copies mostly do)
share the weight of one row.  No row is left out, and each keeps its own label.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE_ROWS``; every document is
scored over its whole text.

Defined results: a null or empty text is scored as one without terms; repeated rows score
alike; an empty table gives an empty result; with no labels of both kinds the score is 0 for
all; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows that the model is fitted on, at most about so many (8 bytes of id each are broadcast).
SAMPLE_ROWS = 16_000
MIN_Z, MIN_DOCS = 5.0, 8
GRADES = 3
RIDGE = 0.3
#: A document is rejected where P(grade > 0) is at least this.
REJECT_AT = 0.5
WORD = r"[^\W_]+"
_word = re.compile(WORD)


def terms_of(text: str) -> set[str]:
    return set(_word.findall(text.lower()))


def copy_key(text: str) -> str:
    """The least hashes of the three-word shingles under two hash functions."""
    words = text.encode().lower().split()
    shingles = [b" ".join(w) for w in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    return f"{min(map(zlib.crc32, shingles)):x}:{min(zlib.crc32(x, 0x5EED) for x in shingles):x}"


def weighted(rows: DataFrame, text: str) -> DataFrame:
    """(text, y, w): rows (``text``, y) with one row's weight shared in each group of near copies."""
    keyed = common.stash(common.map_texts(rows.select(text, "y"), text, lambda: lambda texts: ([copy_key(t) for t in texts],), [T.StructField("copy", T.StringType())]), "toxic-sample")
    groups = keyed.groupBy("copy").agg((1 / F.count("*")).alias("w"))
    return keyed.join(F.broadcast(groups), "copy").select(text, "y", "w")  # at most SAMPLE_ROWS numbers


def sample_of(labels: DataFrame, label: str, rows: int, key: str = "doc_id") -> DataFrame:
    """(key, y): a sample of about ``rows`` labelled ids (all of them if there are fewer), the
    same on every run; of an id that is labelled twice the larger label counts."""
    clean = labels.select(F.col(key), F.col(label).cast("int").alias("y")).dropna().groupBy(key).agg(F.max("y").alias("y"))
    n = clean.count()
    share = min(1.0, rows / n) if n else 1.0
    return clean.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """A sparse matrix of zeros and ones: the columns that each row has."""

    def __init__(self, columns: list[list[int]], width: int):
        self.width, self.height = width, len(columns)
        self.row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        self.column = np.array([i for c in columns for i in c], dtype=np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.height)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=self.width)


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first one, then exponentials as distances."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def loss_and_slope(v: np.ndarray, x: Rows, grade: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the grades with a ridge, and its gradient, at ``v``: the
    weights, then the free parameters of the thresholds."""
    d = x.width
    theta, z = thresholds(v[d:]), x.times(v[:d])
    k = len(theta)
    # P(grade = g) = s(a) - s(b) = s(a) s(-b) (1 - e^(b-a)), a above the threshold below, b above the one above.
    low, high = grade > 0, grade < k
    a, b = z - theta[np.maximum(grade - 1, 0)], z - theta[np.minimum(grade, k - 1)]
    gap = np.where(low & high, a - b, 1.0)
    log_p = np.where(low, -np.logaddexp(0, -a), 0) + np.where(high, -np.logaddexp(0, b), 0) + np.where(low & high, np.log(-np.expm1(-gap)), 0)
    tail = np.where(low & high, 1 / np.expm1(gap), 0)
    da, db = weight * (np.where(low, _sigmoid(-a), 0) + tail), weight * (-np.where(high, _sigmoid(b), 0) - tail)
    slope_theta = -np.bincount(np.maximum(grade - 1, 0), weights=da, minlength=k) - np.bincount(np.minimum(grade, k - 1), weights=db, minlength=k)
    behind = slope_theta[::-1].cumsum()[::-1]  # a distance moves its own threshold and all behind it
    free = np.concatenate([behind[:1], behind[1:] * np.exp(v[d + 1 :])])
    pull = np.concatenate([np.full(d, ridge), np.full(k, 1e-3)])
    return float(-(weight * log_p).sum() + 0.5 * (pull * v * v).sum()), -np.concatenate([x.transposed_times(da + db), free]) + pull * v


def fit_ordinal(x: Rows, grade: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the greatest penalised likelihood, by L-BFGS."""
    k = int(grade.max()) if len(grade) else 0
    if k == 0:
        return np.zeros(x.width), np.zeros(0)
    weight = np.ones(len(grade)) if weight is None else weight
    above = np.clip([weight[grade > j].sum() / weight.sum() for j in range(k)], 1e-4, 1 - 1e-4)
    start = -np.log(above / (1 - above))
    v = np.concatenate([np.zeros(x.width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    now, slope = loss_and_slope(v, x, grade, weight, ridge)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, used = -slope, []
        for s, y in reversed(steps):
            used.append(s @ way / (s @ y))
            way = way - used[-1] * y
        if steps:
            way = way * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), u in zip(steps, reversed(used), strict=True):
            way = way + (u - y @ way / (s @ y)) * s
        size = 1.0 if steps else 1 / max(1.0, float(np.abs(slope).sum()))
        down = float(slope @ way)
        while size > 1e-12:
            new, new_slope = loss_and_slope(v + size * way, x, grade, weight, ridge)
            if new <= now + 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = size * way, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y)]
        gain, v, now, slope = now - new, v + s, new, new_slope
        if np.abs(slope).max() < 1e-6 or gain < 1e-10 * max(1.0, abs(now)):
            break
    return v[: x.width], thresholds(v[x.width :])


class Model:
    """Terms with their weights, and thresholds."""

    def __init__(self, weights: dict[str, float], theta: list[float]):
        self.weights, self.theta = weights, theta

    def scores(self, texts: list[str]) -> tuple[list[float], list[float]]:
        """Expected grade and P(grade > 0) of each text."""
        if not self.theta:
            return [0.0] * len(texts), [0.0] * len(texts)
        known, theta = self.weights.keys(), np.array(self.theta)
        get = self.weights.__getitem__
        z = np.array([sum(sorted(map(get, known & terms_of(t)))) for t in texts])
        p = _sigmoid(z[:, None] - theta[None, :])
        return p.sum(axis=1).tolist(), p[:, 0].tolist()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows (see SAMPLE_ROWS)."""
    sample = F.broadcast(sample_of(labels, label, SAMPLE_ROWS, key))
    rows = common.stash(weighted(docs.select(key, text).join(sample, key), text), "toxic-weighted")
    listed = common.map_texts(rows, text, lambda: lambda texts: ([list(terms_of(t)) for t in texts],), [T.StructField("terms", T.ArrayType(T.StringType()))])
    words = listed.select("y", "w", F.explode("terms").alias("term"))
    n1, n0 = (float(v or 0) for v in rows.agg(F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * (1 - F.col("y")))).first())
    if not n1 or not n0:
        return Model({}, [])
    counted = words.groupBy("term").agg(F.sum(F.col("w") * F.col("y")).alias("c1"), F.sum(F.col("w") * (1 - F.col("y"))).alias("c0")).filter(F.col("c0") + F.col("c1") >= MIN_DOCS)
    share = (F.col("c0") + F.col("c1") + 1) / (n0 + n1 + 2)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    # As many as the bounded sample has.
    chosen = counted.withColumn("z", z).filter(F.abs("z") >= MIN_Z)
    picked = {r.term: (i, r.z > 0) for i, r in enumerate(sorted(chosen.select("term", "z").collect()))}

    def make():
        def work(texts: list[str]):
            found = [{picked[w] for w in terms_of(t) if w in picked} for t in texts]
            return [sorted(i for i, _ in f) for f in found], [sum(up for _, up in f) for f in found]

        return work

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("toxic_terms", T.LongType())]
    got = common.map_texts(rows, text, make, fields).select("y", "w", "ids", "toxic_terms").collect()
    got = sorted(got, key=tuple)  # the same sums on every run
    common.release(rows)
    y, w, many = (np.array([r[c] for r in got]) for c in ("y", "w", "toxic_terms"))
    grade = np.where(y > 0, 1, 0)
    has = (y > 0) & (many > 0)
    if has.any():
        cuts = np.quantile(many[has], [(g + 1) / GRADES for g in range(GRADES - 1)])
        grade[has] = 1 + np.searchsorted(cuts, many[has], side="left")
    beta, theta = fit_ordinal(Rows([r.ids for r in got], len(picked)), grade, w)
    return Model({t: float(beta[i]) for t, (i, _) in picked.items()}, theta.tolist())


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with __cl_severity and __cl_toxic_p.  One narrow map: no shuffle."""
    fields = [T.StructField("__cl_severity", T.DoubleType()), T.StructField("__cl_toxic_p", T.DoubleType())]
    return common.map_texts(docs, text, lambda: model.scores, fields)


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that the model rejects."""
    return score(docs, fit(docs, labels, text), text).filter(F.col("__cl_toxic_p") < REJECT_AT).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.col("__cl_severity").alias("expected_severity"), F.col("__cl_toxic_p").alias("toxic_probability"), (F.col("__cl_toxic_p") >= REJECT_AT).alias("toxic")
    )
