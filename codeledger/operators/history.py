"""Change history: commit logs, evidence of change, blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy


def parse_log(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(path, sha, author_token, ts, subject, paths): commits of ``git log`` text in the format
    ``%x1e%H%x1f%an%x1f%aI%x1f%s``, one row for each; malformed records are left out.  ``paths``:
    the names that follow the subject (``--name-only``)."""
    each = raw.select(F.col(key).alias("path"), F.explode(F.split(F.col(text), "\x1e")).alias("r"))
    parts = each.select("path", F.split("r", "\x1f").alias("p")).filter(F.size("p") >= 4)
    return parts.select(
        "path", F.trim(F.col("p")[0]).alias("sha"), F.col("p")[1].alias("author_token"), F.expr("try_cast(trim(p[2]) as timestamp)").alias("ts"),
        F.trim(F.substring_index(F.col("p")[3], "\n", 1)).alias("subject"),
        F.filter(F.slice(F.split(F.col("p")[3], "\n"), 2, 1 << 30), lambda x: x != "").alias("paths"),
    ).filter(F.col("ts").isNotNull())


def is_fix(subject: Column) -> Column:
    """Whether a subject holds one of the repair words as a whole token."""
    return F.arrays_overlap(F.split(F.lower(subject), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, policy.FIX_WORDS)))


def latest(commits: DataFrame, most: int = policy.COMMITS_PER_PATH, path: str = "path", ts: str = "ts", sha: str = "sha") -> DataFrame:
    """The latest ``most`` commits of each path, of equal times the lesser sha first."""
    order = Window.partitionBy(path).orderBy(F.col(ts).desc(), F.col(sha))
    return commits.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= most).drop("__rn")


def evidence(commits: DataFrame, reference: str, most: int = policy.COMMITS_PER_PATH, path: str = "path", ts: str = "ts", sha: str = "sha", author: str = "author_token", subject: str = "subject") -> DataFrame:
    """(path, changes, frequency, recency, fix_share, top_contributor_share) at a fixed time."""
    kept = latest(commits, most, path, ts, sha)
    authors = kept.groupBy(path, author).agg(F.count("*").alias("n"), F.count_if(is_fix(F.col(subject))).alias("fixes"), F.max(ts).alias("last"))
    per = authors.groupBy(path).agg(F.sum("n").alias("changes"), F.sum("fixes").alias("fixes"), F.max("n").alias("top"), F.max("last").alias("last"))
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / F.lit(86_400_000_000)))
    return per.select(
        path, "changes", F.least(F.lit(100.0), F.col("changes") * 20.0).alias("frequency"), F.least(F.lit(100.0), F.lit(100.0) / (1 + days / F.lit(30.0))).alias("recency"),
        (F.col("fixes") * 100.0 / F.col("changes")).alias("fix_share"), (F.col("top") * 100.0 / F.col("changes")).alias("top_contributor_share"),
    )


def parse_blame(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(source, line, revision) from ``git blame --porcelain`` text."""
    each = raw.select(F.col(key).alias("source"), F.explode(F.split(F.col(text), "\n")).alias("v"))
    head = r"^([0-9a-f]{40,64}) [0-9]+ ([0-9]+)(?: [0-9]+)?$"
    return each.filter(F.col("v").rlike(head)).select("source", F.regexp_extract("v", head, 2).cast("long").alias("line"), F.regexp_extract("v", head, 1).alias("revision"))


def aged_detections(detections: DataFrame, blame: DataFrame, head: str | Column) -> DataFrame:
    """``detections`` (source, line, ...) with outcome: committed rows whose line is older than
    ``head``; a source with any line that blame doesn't cover is unsupported as a whole."""
    newest = F.lit(head) if isinstance(head, str) else head
    both = detections.join(blame.select("source", "line", "revision"), ["source", "line"], "left")
    missing = both.groupBy("source").agg(F.count_if(F.col("revision").isNull()).alias("__missing"))
    full = both.join(missing, "source")
    return full.filter((F.col("__missing") > 0) | (F.col("revision") != newest)).withColumn("outcome", F.when(F.col("__missing") > 0, "unsupported").otherwise("committed")).drop("__missing")
