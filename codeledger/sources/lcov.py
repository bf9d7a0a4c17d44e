"""LCOV text as tables.

Line protocol ``SF:``, ``FN:line,name``, ``FNDA:hits,name``, ``DA:line,hits``, ``end_of_record``;
malformed lines are ignored.  A new ``SF`` closes the open record; what stands before any ``SF``
goes into the next record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines of a report that one task's window runs over.
STRETCH = 50_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """(report, ord, value): the numbered lines of each file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("report"), "value")
    return lines_of(whole, "report", "value")


def lines_of(reports: DataFrame, key: str, text: str) -> DataFrame:
    return reports.select(F.col(key).alias("report"), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("ord", "value"))


def records(lines: DataFrame) -> DataFrame:
    """(report, record, source_path, kind, line, name, hits): an entry each; kind is function,
    function_hits or line_hits.  Records are numbered by their SF line; entries before the first
    SF of a report join that first record; entries after an end_of_record join the next."""
    value = F.trim("value")
    starts = value.startswith("SF:")
    ends = value == "end_of_record"
    # A report is dealt out in stretches of STRETCH lines: what a stretch must know of the others is
    # one row, and inside it the windows run over its own lines only.
    part = F.floor(F.col("ord") / STRETCH).alias("__part")
    tagged = lines.withColumn("__part", part).withColumn("__sf", F.when(starts, F.col("ord"))).withColumn("__end", F.when(ends, F.col("ord")))
    marks = tagged.groupBy("report", "__part").agg(F.min("__sf").alias("__first"), F.max("__sf").alias("__last"), F.max("__end").alias("__ended"))
    over = Window.partitionBy("report").orderBy("__part")
    earlier, later = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("report").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("report", "__part", F.max("__last").over(earlier).alias("__sf_before"), F.max("__ended").over(earlier).alias("__end_before"), F.min("__first").over(later).alias("__sf_behind"))
    by = Window.partitionBy("report", "__part").orderBy("ord")
    back = Window.partitionBy("report", "__part").orderBy(F.desc("ord"))
    tagged = tagged.select("*", F.max("__sf").over(by).alias("__o"), F.max("__end").over(by).alias("__c"), F.min("__sf").over(back).alias("__n")).join(marks, ["report", "__part"])
    tagged = tagged.withColumn("__open", F.coalesce("__o", "__sf_before")).withColumn("__closed", F.coalesce("__c", "__end_before")).withColumn("__next", F.coalesce("__n", "__sf_behind"))
    inside = F.col("__open").isNotNull() & (F.col("__closed").isNull() | (F.col("__closed") < F.col("__open")))
    placed = tagged.withColumn("record", F.when(inside, F.col("__open")).otherwise(F.col("__next"))).filter(F.col("record").isNotNull())
    paths = lines.filter(starts).select("report", F.col("ord").alias("record"), F.expr("substring(trim(value), 4)").alias("source_path"))
    number = lambda p, k: F.expr(f"try_cast(nullif(regexp_extract(trim(value), '{p}', {k}), '') as bigint)")
    entry = (
        F.when(value.startswith("FNDA:"), F.struct(F.lit("function_hits").alias("kind"), F.lit(None).cast("long").alias("line"), F.expr("nullif(regexp_extract(trim(value), '^FNDA:[^,]*,(.*)$', 1), '')").alias("name"), number("^FNDA:([0-9]+),", 1).alias("hits")))
        .when(value.startswith("FN:"), F.struct(F.lit("function").alias("kind"), number("^FN:([0-9]+),", 1).alias("line"), F.expr("nullif(regexp_extract(trim(value), '^FN:[^,]*,(.*)$', 1), '')").alias("name"), F.lit(None).cast("long").alias("hits")))
        .when(value.startswith("DA:"), F.struct(F.lit("line_hits").alias("kind"), number("^DA:([0-9]+),", 1).alias("line"), F.lit(None).cast("string").alias("name"), number("^DA:[0-9]+,([0-9]+)", 1).alias("hits")))
    )
    got = placed.select("report", "record", entry.alias("e")).filter(F.col("e").isNotNull()).select("report", "record", "e.*")
    whole = (F.col("kind") == "line_hits") & F.col("line").isNotNull() & F.col("hits").isNotNull()
    whole = whole | ((F.col("kind") == "function") & F.col("line").isNotNull() & F.col("name").isNotNull()) | ((F.col("kind") == "function_hits") & F.col("hits").isNotNull() & F.col("name").isNotNull())
    return paths.join(got.filter(whole), ["report", "record"])


def render(records_: DataFrame, key: str = "source_path") -> DataFrame:
    """(key, text): LCOV text of line hits, lines in order."""
    body = records_.filter("kind = 'line_hits'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "hits"))).alias("l"))
    text = F.concat(F.lit("SF:"), F.col(key), F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("DA:"), x["line"].cast("string"), F.lit(","), x["hits"].cast("string"))), "\n"), F.lit("\nend_of_record"))
    return body.select(key, text.alias("text"))
