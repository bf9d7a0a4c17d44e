"""Source trees and manifests as (path, module, content)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("module", T.StringType()), T.StructField("content", T.StringType())])
#: Directories that a scan never enters, and the default module.
SKIPPED = (".build", ".git", ".swiftpm", "Build", "DerivedData", "Carthage", "Pods")
DEFAULT_MODULE = "Workspace"
MAXIMUM_FILE_BYTES = 16 * 1024 * 1024


def _read(spark: SparkSession, paths: list[str] | str, suffix: str, maximum: int) -> DataFrame:
    """(file, content) by Spark's own reader, so any store that Spark reads will do.  A file that
    is too large or isn't UTF-8 stops the job."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(paths)
    checked = F.when(F.col("length") > maximum, F.raise_error(F.format_string("%s is larger than the maximum", "path"))).otherwise(F.col("content"))
    # ANSI decode() raises on malformed UTF-8.
    return raw.select(F.col("path").alias("file"), F.decode(checked, "UTF-8").alias("content"))


def symbolic_links(root: str) -> list[str]:
    """Links below a local ``root``, as relative paths; other stores have none.  Links aren't entered."""
    if "://" in root and not root.startswith("file://"):
        return []
    base = root.removeprefix("file://").removeprefix("file:")
    found = []
    for at, folders, names in os.walk(base):
        found += [os.path.relpath(os.path.join(at, x), base) for x in (*folders, *names) if os.path.islink(os.path.join(at, x))]
    return found


def scan_directory(spark: SparkSession, root: str, suffix: str = ".swift", excludes: list[str] | None = None, maximum: int = MAXIMUM_FILE_BYTES) -> DataFrame:
    """All sources below ``root`` by relative path; skipped directories, package manifests and
    excluded prefixes (literal, on part borders) are left out before they are read; symbolic links
    aren't followed."""
    full = _read(spark, root, suffix, maximum)
    base = root.rstrip("/").split("://")[-1].lstrip("/").removeprefix("file:")
    at = F.instr("file", base)
    path = F.substring("file", at + len(base) + 1, F.length("file")) if base else F.col("file")
    out = full.filter(at > 0).select(path.alias("path"), F.lit(DEFAULT_MODULE).alias("module"), "content")
    parts = F.split("path", "/")
    out = out.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED)))).filter(F.element_at(parts, -1) != "Package.swift")
    return exclude(out, [*symbolic_links(root), *(excludes or [])])


def scan_file(spark: SparkSession, path: str, suffix: str = ".swift", maximum: int = MAXIMUM_FILE_BYTES) -> DataFrame:
    if not path.endswith(suffix):
        raise ValueError(f"{path} is no {suffix} file")
    if os.path.islink(path.removeprefix("file://").removeprefix("file:")):
        raise ValueError(f"{path} is a symbolic link")
    return _read(spark, path, suffix, maximum).select(F.element_at(F.split("file", "/"), -1).alias("path"), F.lit(DEFAULT_MODULE).alias("module"), "content")


def scan_manifest(spark: SparkSession, manifest: str, suffix: str = ".swift", maximum: int = MAXIMUM_FILE_BYTES) -> DataFrame:
    """Sources of a JSON manifest {root, sources: [{path, module}]}; an entry outside the root
    or without a module is an error."""
    text = spark.read.text(manifest, wholetext=True).first()[0]  # a manifest names files, it holds none
    data = json.loads(text)
    rows = [(s["path"], s["module"]) for s in data["sources"]]
    for path, module in rows:
        if not module or path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"manifest entry {path!r} isn't inside the root or has no module")
    listed = spark.createDataFrame(rows, "path string, module string")
    return scan_directory(spark, data["root"], suffix, maximum=maximum).drop("module").join(listed, "path").select("path", "module", "content")


def in_memory(spark: SparkSession, units: list[tuple[str, str, str]]) -> DataFrame:
    """Units (path, module, content): at least one, paths unique, path and module not empty."""
    paths = [p for p, _, _ in units]
    if not units or len(set(paths)) != len(paths) or not all(p and m for p, m, _ in units):
        raise ValueError("sources must be there, with unique paths and modules")
    return spark.createDataFrame(units, SCHEMA)


def exclude(sources: DataFrame, prefixes: list[str]) -> DataFrame:
    """Without what equals a prefix or lies below it."""
    out = sources
    for p in prefixes:
        if not p or p.startswith("/") or ".." in p.split("/"):
            raise ValueError(f"{p!r} is no relative prefix")
        out = out.filter(~((F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")))
    return out


def is_test_source(path: str = "path", module: str = "module"):
    """Whether a source is a test: by module, directory or file name."""
    return F.col(module).rlike("Tests?$") | F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.endswith("Tests")) | F.col(path).endswith("Tests.swift")


@dataclass
class WorkspaceConfiguration:
    """A workspace's settings; unknown keys are errors."""

    type_scope: str = "nominals"
    scoring: str = "none"
    thresholds: dict = field(default_factory=dict)
    minimum_duplicate_lines: int = 11
    maximum_duplicate_comparisons: int = 250_000
    maximum_file_bytes: int = MAXIMUM_FILE_BYTES
    strict_syntax: bool = False
    excludes: list = field(default_factory=list)
    preset: str = "balanced"
    aggregation: str = "file"
    top: int | None = None
    min_score: float | None = None
    min_priority: str | None = None
    reference_time: str | None = None
    max_score: float | None = None

    @classmethod
    def parse(cls, text: str) -> WorkspaceConfiguration:
        data = json.loads(text)
        unknown = sorted(set(data) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
        made = cls(**data)
        if made.aggregation not in ("none", "file", "aggregateOnly") or made.preset not in ("strict", "balanced", "lenient"):
            raise ValueError("unknown aggregation or preset")
        if made.type_scope not in ("classes", "nominals") or made.scoring not in ("none", "paper", "bounded", "corrected"):
            raise ValueError("unknown type scope or scoring mode")
        if made.minimum_duplicate_lines < 2 or (made.scoring != "none" and made.minimum_duplicate_lines != 11):
            raise ValueError("a custom clone floor needs scoring none, and at least 2 lines")
        return made
