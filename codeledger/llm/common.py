"""Helpers shared by the corpus operators: shared storage, Arrow maps over texts, seeds.

Every operator reads only the columns it names, so further columns (clashing names
included) never take part.  Columns that an operator adds on the way start with ``__cl_``.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch that goes to Python; texts may be long, so batches are short.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where a session names none, a session on one machine (tests) takes a local folder; on a
    cluster that is an error, as executors wouldn't see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir isn't set; with the master {master} it must name a folder that all machines share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


_own: dict[str, SparkSession] = {}


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/codeledger-{spark.sparkContext.applicationId}"
    if path not in _own:
        _own[path] = spark
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store; where that can't be done any more, it stays."""
    with contextlib.suppress(Exception):
        context, jvm = spark.sparkContext, spark.sparkContext._jvm
        conf = context._jsc.hadoopConfiguration() if context._jsc else jvm.org.apache.hadoop.conf.Configuration()  # a stopped context has none
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


#: Shuffle files of an execution that is over go at its end when this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here,
    the rows outlive executors, and the planner knows the true size of the table.  The shuffle
    files behind it go at once; the table goes by ``release``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._codeledger_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Remove tables that ``stash`` returned and that no later result reads."""
    for t in tables:
        _delete(t.sparkSession, t._codeledger_path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may have no copy of it.  Once per context."""
    context = spark.sparkContext
    if getattr(context, "_codeledger_shipped", False):
        return
    home = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="codeledger-")) / "codeledger_package.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(made))
    context._codeledger_shipped = True


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: at most ``BATCH_ROWS`` texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], Iterable]], fields: list[T.StructField]) -> DataFrame:
    """``df`` with the columns ``fields`` added, computed from the column ``text``; a column of
    ``df`` that has the name of one of them is replaced.

    ``make`` builds the worker's function once per task; that takes a list of texts (null as
    the empty text) and returns one list for each field.  A narrow Arrow map: no shuffle.
    """
    ship(df.sparkSession)
    short_batches(df.sparkSession)
    at = df.columns.index(text)
    added = {f.name for f in fields}
    kept = [k for k, c in enumerate(df.columns) if c not in added]
    names = [*(df.columns[k] for k in kept), *(f.name for f in fields)]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            texts = [t or "" for t in batch.column(at).to_pylist()]
            made = [pa.array(c, type=k) for c, k in zip(work(texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], names=names)

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[k] for k in kept), *fields]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
