"""Phases of a run with their time and the driver's peak memory."""

from __future__ import annotations

import resource
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Profile:
    """Collects phases; ``with profile.phase("graph"): ...``."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int]] = []

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter_ns() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "phase string, nanoseconds long, peak_rss_bytes long")
