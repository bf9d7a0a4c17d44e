"""Facts of many sources: one parse per file, one tagged row per fact, one table per kind."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nesting
from ..packaging import ship
from . import swift

#: Kind -> payload schema.
TABLES = {
    "fragments": "module string, name string, kind string, is_extension boolean, line long, column long, code_lines long, property_names array<string>, referenced_types array<string>, imported_modules array<string>, head string, begin long, end long",
    "functions": "name string, kind string, owner string, module string, line long, column long, parameters long, access_level string, code_lines long, complexity long, cognitive long, max_nesting long, bare_refs array<string>, self_refs array<string>, shadowed array<string>, head string, begin long, end long",
    "closures": "owner string, line long, column long, code_lines long, complexity long, cognitive long, max_nesting long, parameters long",
    "effects": "function string, category string, detail string, line long, column long, in_closure boolean, of_line long, of_column long",
    "risks": "category string, detail string, line long, column long, function string, of_line long, of_column long",
    "compositions": "function string, operation string, line long, column long, impure boolean, of_line long, of_column long",
    "calls": "function string, callee string, labels string, line long, column long, of_line long, of_column long",
    "detections": "rule string, line long, column long, message string, subject array<string>",
    "clumps": "kind string, display_name string, line long, column long, elements array<struct<name:string,type:string>>",
    "switches": "scope string, discriminator string, case_shape array<string>, line long, column long, conditional boolean",
    "lines": "number long, signature string",
    "diagnostics": "severity string, message string, line long, column long",
    "files": "code_lines long, top_level_vars long, valid boolean",
}


def extract(sources: DataFrame, parse: Callable[[str, str, str], swift.Facts] = swift.parse) -> DataFrame:
    """(path, module, fact, payload) of sources (path, module, content); no shuffle.  A file
    with an error has its diagnostics and an invalid ``files`` row only.  ``parse`` is the front
    end: (path, module, content) to facts."""
    ship(sources.sparkSession)
    if int(sources.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 256:
        sources.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, str, str]] = []
            for path, module, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                facts = parse(path, module, content or "")
                for kind in TABLES:
                    if kind != "files":
                        out += [(path, module, kind, json.dumps(row)) for row in getattr(facts, kind)]
                ok = not any(x["severity"] == "error" for x in facts.diagnostics)
                out.append((path, module, "files", json.dumps({"code_lines": len(facts.lines), "top_level_vars": facts.top_level_variables, "valid": ok})))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "module", "fact", "payload"])

    return sources.select("path", "module", "content").mapInArrow(run, "path string, module string, fact string, payload string")


def table(facts: DataFrame, kind: str) -> DataFrame:
    """The typed rows of one kind, with their path."""
    got = facts.filter(F.col("fact") == kind).select("path", F.col("module").alias("__m"), F.from_json("payload", TABLES[kind]).alias("p")).select("path", "__m", "p.*")
    return got.drop("__m") if "module" in got.columns else got.withColumnRenamed("__m", "module")


def diagnostics(facts: DataFrame, strict: bool = False) -> DataFrame:
    """Diagnostics by policy: unless strict, an error is a warning that the file was skipped."""
    rows = table(facts, "diagnostics")
    if strict:
        return rows
    skipped = F.col("severity") == "error"
    return rows.withColumn("message", F.when(skipped, F.concat(F.lit("File skipped (parse error): "), "message")).otherwise(F.col("message"))).withColumn("severity", F.when(skipped, "warning").otherwise(F.col("severity")))


def structural_digests(facts: DataFrame) -> DataFrame:
    """Detections with digests of the subject's tokens and of the heads of all declarations that
    enclose them, the outermost first (null where none does)."""
    det = table(facts, "detections").withColumn("at", F.shiftleft(F.col("line"), 20).bitwiseOR(F.col("column")))
    det = det.withColumn("id", F.struct("path", "rule", "line", "column"))
    inside = table(facts, "functions").select("path", "begin", "end", "head").unionByName(table(facts, "fragments").select("path", "begin", "end", "head"))
    chains = nesting.enclosing(det.select("path", "id", "at").distinct(), inside, "head")
    full = det.join(chains, "id", "left")
    rows = full.select("path", "rule", "line", "column", nesting.framed_digest(F.col("subject")).alias("subject_digest"), F.when(F.col("chain").isNotNull(), nesting.framed_digest(F.col("chain"))).alias("decl_digest"))
    return rows.distinct()
