"""Sending the package to executors that have no copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the context's Python files, once."""
    context = spark.sparkContext
    if getattr(context, "_codeledger_sent", False):
        return
    home = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="codeledger-")) / "codeledger_core.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(made))
    context._codeledger_sent = True
