"""An exact index of vectors that leaves out what can't be near: cells around pivots.

Each vector lies in the cell of its nearest pivot, with its distance from it.  By the triangle
inequality no vector x of a cell with pivot p is nearer to a query q than |d(q, p) - d(x, p)|, so
a cell is left out if all of that is beyond the distance of the k-th best found so far, and of
the other cells only a ring is looked at.  Files are laid out by cell and sorted by that distance:
Spark reads the folders of the cells that are left and skips row groups by the ring.  The result
is that of a scan of all vectors, ties by key included.

Cosine distance is searched on unit vectors, where it rises with the Euclidean one, and given by
the same expression as a scan.  Pivots are a stated sample of ``PIVOTS`` rows (those of the least
hashes of their keys); all rows are indexed, and no result depends on which were taken.

A set of queries is compared in blocks: the vectors of a cell lie beside the rows in blocks of
about ``BLOCK_BYTES``, queries are packed alike, and Spark joins blocks of a cell whose rings
meet.  A task multiplies two blocks, takes what a rounding error may separate from the k nearest,
and gives those the distances of :func:`vectors.distance`, added up in the same order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import policy
from ..packaging import ship
from . import vectors
from .shared import cut

PIVOTS = 64
#: Bytes of the vectors of one block, in doubles; pairs of blocks in one Arrow batch; queries that
#: a task compares with a block at once.
BLOCK_BYTES, PAIRS, AT_ONCE = 1 << 20, 4, 256
#: Rounding of distances in doubles; what is left out is beyond it.
_SLACK = 1e-9


def _unit(v: Column, metric: str) -> Column:
    wide = F.transform(v, lambda x: x.cast("double"))
    if metric != "cosine":
        return wide
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / norm)


def _matrix(column: pa.Array, metric: str | None = None) -> np.ndarray:
    """The vectors of a column as rows of doubles; for a metric, as the index places them."""
    wide = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True)) if metric == "cosine" else wide


def _placed(rows: DataFrame, vector: str, pivots: list[list[float]], metric: str) -> DataFrame:
    """``rows`` with the nearest pivot in ``cell`` and the distance from it in ``away``."""
    at, names = rows.columns.index(vector), [*rows.columns, "cell", "away"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(pivots)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(at), metric)
                cell = ((table * table).sum(axis=1) - 2 * (x @ table.T)).argmin(axis=1)
                away = np.sqrt(((x - table[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=names)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))


def _offsets(queries: DataFrame, pivots: list[list[float]], metric: str) -> DataFrame:
    """(query_id, q) with ``offs``: the distances from each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), metric)
                offs = np.stack([np.sqrt(((x - np.array(p)) ** 2).sum(axis=1)) for p in pivots], axis=1)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(offs.ravel()))], names=[*batch.schema.names, "offs"])

    ship(queries.sparkSession)
    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("offs", T.ArrayType(T.DoubleType()))]))


def _blocks(rows: DataFrame, prefix: str, low: str, high: str) -> DataFrame:
    """Rows (key, vector, cell, doubles...) of equal cells that follow one another, packed: keys in
    ascending order, vectors and the other columns as bytes, and the ring from ``low`` to ``high``."""
    kept = rows.columns[3:]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pc.array_sort_indices(t.column(0).combine_chunks()) if t.column(0).null_count == 0 else pc.sort_indices(t, sort_keys=[(t.column_names[0], "ascending")], null_placement="at_start")).combine_chunks()
        keys, vector = (pa.concat_arrays(t.column(k).chunks) for k in (0, 1))
        one = {c: t.column(c).to_numpy() for c in kept}
        ring = [float(one[low].min()), float(one[high].max())]
        made = [t.column(2)[0].as_py(), None, _matrix(vector).tobytes(), np.stack([one[c] for c in kept]).tobytes(), *ring]
        kinds = [pa.int32(), None, pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        columns = [pa.array([v], type=k) if k else pa.ListArray.from_arrays(pa.array([0, len(keys)], type=pa.int32()), keys) for v, k in zip(made, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, of, size = [], 0, None, 1
        for batch in batches:
            if not batch.num_rows:
                continue
            size = max(1, BLOCK_BYTES // (8 * max(1, len(batch.column(1)[0]))))
            cells = batch.column(2).to_numpy()
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]):
                while a < b:
                    if held and (cells[a] != of or count >= size):
                        yield block(held)
                        held, count = [], 0
                    n = min(b - a, size - count)
                    held.append(batch.slice(a, n))
                    of, count, a = cells[a], count + n, a + n
        if held:
            yield block(held)

    names = ["cell", *(f"{prefix}_{c}" for c in ("keys", "vectors", "numbers", "low", "high"))]
    kinds = [T.IntegerType(), T.ArrayType(rows.schema.fields[0].dataType), T.BinaryType(), T.BinaryType(), T.DoubleType(), T.DoubleType()]
    ship(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def _sums(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sums of products, added up one after another as an aggregate over an array does."""
    out = np.zeros(n)
    for x, y in pairs:
        out += x * y
    return out


def _nearest_in_block(x: np.ndarray, away: np.ndarray, q: np.ndarray, off: np.ndarray, bound: np.ndarray, worst: np.ndarray, limit: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``limit`` nearest rows of each query by (distance, row), of
    those in its ring and no farther than ``worst``; and how many rows each ring holds."""
    met = np.abs(off[:, None] - away) <= bound[:, None]
    xt, qt = np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)
    xx, qq = _sums(((c, c) for c in xt), len(x)), _sums(((c, c) for c in qt), len(q))
    slack = 16 * (x.shape[1] + 8) * np.finfo(np.float64).eps
    if metric == "cosine":
        score, far = -(q @ xt) / (np.sqrt(qq)[:, None] * np.sqrt(xx)), worst - 1
    else:
        score, far = qq[:, None] + xx - 2 * (q @ xt), worst * worst
        slack = slack * (qq + xx.max())
    score[~met] = np.inf
    most = np.partition(score, limit - 1, axis=1)[:, limit - 1] if len(x) > limit else np.full(len(q), np.inf)
    i, j = np.nonzero(met & (score <= (np.minimum(most, far) + slack)[:, None]))
    if metric == "cosine":
        distance = 1 - _sums(((a[j], b[i]) for a, b in zip(xt, qt, strict=True)), len(i)) / (np.sqrt(xx[j]) * np.sqrt(qq[i]))
    else:
        distance = np.sqrt(_sums(((d, d) for d in (a[j] - b[i] for a, b in zip(xt, qt, strict=True))), len(i)))
    near = distance <= worst[i]
    i, j, distance = i[near], j[near], distance[near]
    order = np.lexsort((j, distance, i))
    i, j, distance = i[order], j[order], distance[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < limit
    return i[first], j[first], distance[first], met.sum(axis=1)


def _compared(rows: DataFrame, queries: DataFrame, limit: int, metric: str) -> DataFrame:
    """(query_id, ids, distances, looked_at) of each query and block of rows that its ring meets:
    blocks of rows joined with blocks of queries (off, bound, worst), kept in the shared folder."""
    spark, names = rows.sparkSession, ["query_id", "ids", "distances", "looked_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                keys, asked = column["r_keys"][k].values, column["q_keys"][k].values
                x, q = (np.frombuffer(column[f"{c}_vectors"][k].as_py()).reshape(len(v), -1) for c, v in (("r", keys), ("q", asked)))
                away = np.frombuffer(column["r_numbers"][k].as_py())
                numbers = np.frombuffer(column["q_numbers"][k].as_py()).reshape(5, -1)[:3]
                for at in range(0, len(asked), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    i, j, distance, looked = _nearest_in_block(x, away, q[part], *numbers[:, part], limit, metric)
                    ends = pa.array(np.concatenate([[0], np.bincount(i, minlength=len(looked)).cumsum()]).astype(np.int32))
                    ids, distances = (pa.ListArray.from_arrays(ends, v) for v in (keys.take(pa.array(j)), pa.array(distance)))
                    yield pa.RecordBatch.from_arrays([asked.slice(at, AT_ONCE), ids, distances, pa.array(looked.astype(np.int64))], names=names).filter(pa.array(looked > 0))

    both = rows.join(queries, "cell").filter("r_low <= q_high and r_high >= q_low").drop("cell", "r_low", "r_high", "q_low", "q_high")
    key = lambda c: both.schema[c].dataType
    schema = T.StructType([T.StructField("query_id", key("q_keys").elementType), T.StructField("ids", key("r_keys")), T.StructField("distances", T.ArrayType(T.DoubleType())), T.StructField("looked_at", T.LongType())])
    # A pair of blocks is a row of a few MB; an Arrow batch takes few of them.
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(PAIRS))
    try:
        return cut(both.mapInArrow(run, schema))
    finally:
        spark.conf.set(size, before)


class PivotIndex:
    """An index of rows (id, vector, metadata) in the folder ``path``, for one metric.

    Corrupt rows (:func:`vectors.is_valid`) are refused when the index is built, with the least of
    their ids.  ``maximum``: a budget of the rows that a search may have as candidates after its
    filter; beyond it the search is refused, never cut."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "l2", maximum: int | None = policy.MAXIMUM_VECTOR_CANDIDATES):
        self.spark, self.path, self.metric, self.maximum = spark, path, metric, maximum
        self.pivots: list[tuple[int, list[float]]] = [(r.cell, list(r.pivot)) for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()]  # PIVOTS rows
        self.cells = spark.read.parquet(f"{path}/cells")

    @classmethod
    def build(cls, rows: DataFrame, path: str, metric: str = "l2", key: str = "id", vector: str = "vector", pivots: int = PIVOTS, maximum: int | None = policy.MAXIMUM_VECTOR_CANDIDATES) -> PivotIndex:
        spark = rows.sparkSession
        first = rows.select(F.size(vector)).first()
        bad = rows.filter(~vectors.is_valid(F.col(vector), first[0], metric)).agg(F.min(key)).first()[0] if first else None
        if bad is not None:
            raise vectors.Incomplete(f"corrupt row {bad}")
        taken = rows.select(_unit(F.col(vector), metric).alias("pivot"), F.xxhash64(key).alias("mark"), key).orderBy("mark", key).limit(pivots)  # the sample is the feature
        chosen = [(k, list(r.pivot)) for k, r in enumerate(taken.collect())]
        spark.createDataFrame(chosen, "cell int, pivot array<double>").write.mode("errorifexists").parquet(f"{path}/pivots")
        placed = _placed(rows.withColumnRenamed(key, "id").withColumnRenamed(vector, "vector"), "vector", [p for _, p in chosen], metric)
        placed = cut(placed)
        # A cell of very many vectors goes to several files: its ring is a part of the key.
        placed.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows")
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("nearest"), F.max("away").alias("farthest")).write.mode("errorifexists").parquet(f"{path}/cells")
        laid = spark.read.parquet(f"{path}/rows") if chosen else placed
        _blocks(laid.select("id", "vector", "cell", "away"), "r", "away", "away").write.mode("errorifexists").parquet(f"{path}/blocks")
        return cls(spark, path, metric, maximum)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _from_pivots(self, query: list[float]) -> dict[int, float]:
        wide = [float(x) for x in query]
        if self.metric == "cosine":
            norm = math.sqrt(sum(x * x for x in wide))
            wide = [x / norm for x in wide]
        return {k: math.dist(wide, p) for k, p in self.pivots}

    def nearest(self, query: list[float], limit: int, metadata: dict[str, str] | None = None) -> DataFrame:
        """(id, distance): the ``limit`` nearest by (distance, id)."""
        if not 1 <= limit <= policy.MAXIMUM_VECTOR_LIMIT:
            raise ValueError(f"limit must be 1 to {policy.MAXIMUM_VECTOR_LIMIT}")
        every = vectors.with_metadata(self.rows(), metadata or {})
        if self.maximum is not None and every.limit(self.maximum + 1).count() > self.maximum:
            raise vectors.Incomplete(f"more than {self.maximum} candidates")
        away = self._from_pivots(query)
        q = F.array(*[F.lit(float(x)) for x in query])
        cells = sorted(((max(0.0, away[r.cell] - r.farthest, r.nearest - away[r.cell]), r.cell, r.n) for r in self.cells.collect()), key=lambda x: (x[0], away[x[1]]))  # PIVOTS rows
        have, first = 0, []
        for _, cell, n in cells:
            if have >= limit and not metadata:
                break
            if metadata and len(first) >= 8:
                break
            first.append(cell)
            have += n
        ring = lambda rows, bound: rows.filter(F.abs(F.create_map(*[F.lit(x) for kv in away.items() for x in kv])[F.col("cell")] - F.col("away")) <= bound)
        near = every.filter(F.col("cell").isin(first)).select(vectors.distance(F.col("vector"), q, "l2" if self.metric == "l2" else "cosine").alias("d")).orderBy("d").limit(limit).agg(F.count("*"), F.max("d")).first()
        rows = every
        if near[0] == limit:
            bound = self._straight(near[1])
            rows = ring(every.filter(F.col("cell").isin([c for low, c, _ in cells if low <= bound])), bound)
        return rows.select("id", vectors.distance(F.col("vector"), q, self.metric).alias("distance")).orderBy("distance", "id").limit(limit)

    def _straight(self, distance: float) -> float:
        """The Euclidean distance of unit vectors whose distance is ``distance``, and a little more."""
        d = math.sqrt(max(0.0, 2 * distance)) if self.metric == "cosine" else distance
        return d + _SLACK + 1e-6 * d + (1e-7 if self.metric == "cosine" else 0.0)

    def nearest_to_each(self, queries: DataFrame, limit: int, key: str = "id", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
        """((query_id, id, distance), (query_id, looked_at)): the ``limit`` nearest of each query of a
        stated set, and how many rows each was compared with."""
        ship(self.spark)
        if self.pivots:
            vectors.refuse_corrupt(queries, len(self.pivots[0][1]), self.metric, key, vector)
        asked = _offsets(queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q")), [p for _, p in self.pivots], self.metric)
        asked = asked.select("query_id", "q", F.posexplode("offs").alias("cell", "off")).join(self.cells, "cell")
        low = F.greatest(F.lit(0.0), F.col("off") - F.col("farthest"), F.col("nearest") - F.col("off"))
        asked = cut(asked.select("query_id", "q", "cell", "off", low.alias("low"), "n"))
        order = Window.partitionBy("query_id").orderBy("low", "off", "cell")
        enough = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < limit
        no = F.lit(float("inf"))
        first = asked.withColumn("first", enough).filter("first").select("query_id", "q", "cell", "off", no.alias("bound"), no.alias("worst"))
        best = Window.partitionBy("query_id").orderBy("distance", "id")
        worst = self._found(self._met(first, limit), best, limit).groupBy("query_id").agg(F.max("distance").alias("worst"), F.count("*").alias("have"))
        straight = F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("worst"))) if self.metric == "cosine" else F.col("worst")
        full = F.col("have") == limit
        bound = F.when(full, straight + _SLACK + 1e-6 * straight + (1e-7 if self.metric == "cosine" else 0.0)).otherwise(no)
        left = asked.join(worst.select("query_id", bound.alias("bound"), F.when(full, F.col("worst")).otherwise(no).alias("worst")), "query_id").filter("low <= bound")
        met = self._met(left.select("query_id", "q", "cell", "off", "bound", "worst"), limit)
        return self._found(met, best, limit), met.groupBy("query_id").agg(F.sum("looked_at").alias("looked_at"))

    def _met(self, asked: DataFrame, limit: int) -> DataFrame:
        """What is found in the blocks of the cells and rings that ``asked`` names for each query."""
        ring = asked.withColumns({"ring_low": F.col("off") - F.col("bound") - _SLACK, "ring_high": F.col("off") + F.col("bound") + _SLACK})
        sorted_ = cut(ring).repartitionByRange("cell", "off").sortWithinPartitions("cell", "off")
        packed = cut(_blocks(sorted_.select("query_id", "q", "cell", "off", "bound", "worst", "ring_low", "ring_high"), "q", "ring_low", "ring_high"))
        return _compared(self.spark.read.parquet(f"{self.path}/blocks"), packed, limit, self.metric)

    @staticmethod
    def _found(met: DataFrame, best: WindowSpec, limit: int) -> DataFrame:
        each = met.select("query_id", F.explode(F.arrays_zip("ids", "distances")).alias("e")).select("query_id", F.col("e.ids").alias("id"), F.col("e.distances").alias("distance"))
        return each.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= limit).drop("rn")
