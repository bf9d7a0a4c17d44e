"""Version control as tables.  The runner is pluggable; it is called on the driver, for a stated
and bounded list of paths or revisions, and what it prints is parsed by Spark.  At scale the
same tables come from a commit export that :mod:`codeledger.operators.history` reads."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import policy
from ..operators import history

Runner = Callable[[list[str]], str]
#: Paths or revisions of one call at most.
MOST = 10_000


def runner(root: str, timeout: int = 60) -> Runner:
    """Runs git below ``root``; a failure raises with what git said."""

    def run(args: list[str]) -> str:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
        if done.returncode:
            raise RuntimeError(f"git {args[0]}: {done.stderr.strip()}")
        return done.stdout

    return run


def _checked(names: list[str]) -> list[str]:
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} names; read them in blocks")
    return sorted(set(names))


def log(spark: SparkSession, run: Runner, paths: list[str]) -> DataFrame:
    """Commits of each path, one more than evidence takes (so a cut history shows)."""
    rows = [(p, run(["log", "--follow", f"--max-count={policy.COMMITS_PER_PATH + 1}", "--format=%x1e%H%x1f%an%x1f%aI%x1f%s", "--name-only", "--", p])) for p in _checked(paths)]
    return history.parse_log(spark.createDataFrame(rows, "path string, raw string"), "path", "raw")


def blame(spark: SparkSession, run: Runner, paths: list[str]) -> DataFrame:
    rows = [(p, run(["blame", "--porcelain", "HEAD", "--", p])) for p in _checked(paths)]
    return history.parse_blame(spark.createDataFrame(rows, "source string, raw string"), "source", "raw")


def snapshot(spark: SparkSession, run: Runner) -> dict[str, object]:
    """HEAD, its parents, whether the tree is clean, and renames and deletions against a single
    parent (tables; empty for a root or a merge)."""
    head, *parents = run(["rev-list", "--parents", "-n", "1", "HEAD"]).split()
    renames, deletions = [], []
    if len(parents) == 1:
        for line in run(["diff", "--name-status", "-M50%", parents[0], head]).splitlines():
            kind, *names = line.split("\t")
            if kind[0] == "R":
                renames.append((names[0], names[1], int(kind[1:])))
            elif kind == "D":
                deletions.append((names[0],))
    return {
        "head": head, "parents": parents, "clean": not run(["status", "--porcelain"]).strip(),
        "renames": spark.createDataFrame(renames, "prior string, current string, similarity int"), "deletions": spark.createDataFrame(deletions, "prior string"),
    }


def parents(spark: SparkSession, run: Runner, start: str = "HEAD") -> DataFrame:
    """(child, parent) of all revisions reachable from ``start``."""
    return bounded_parents(spark, run, start, None)["edges"]


def bounded_parents(spark: SparkSession, run: Runner, start: str, most: int | None) -> dict[str, DataFrame]:
    """edges (child, parent) of at most ``most`` revisions, and the frontier (id): parents that the
    bound left unvisited, none if the history is whole."""
    lines = [line.split() for line in run(["rev-list", "--parents", *([f"--max-count={most}"] if most is not None else []), start]).splitlines()]
    seen = {c for c, *_ in lines}
    left = sorted({p for _, *ps in lines for p in ps} - seen)
    return {"edges": spark.createDataFrame([(c, p) for c, *ps in lines for p in ps], "child string, parent string"), "frontier": spark.createDataFrame([(p,) for p in left], "id string")}


def tree(spark: SparkSession, run: Runner, revision: str, suffix: str = ".swift", module: str = "Workspace") -> DataFrame:
    """(path, module, content) of a revision."""
    names = [n for n in run(["ls-tree", "-r", "--name-only", revision]).splitlines() if n.endswith(suffix)]
    rows = [(n, module, run(["show", f"{revision}:{n}"])) for n in _checked(names)]
    return spark.createDataFrame(rows, "path string, module string, content string")
