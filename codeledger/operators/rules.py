"""Rule results: completeness grid, absence proofs, registration checks, catalogs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("committed", "parseFailed", "unsupported", "failed")


def missing_pairs(rules: DataFrame, sources: DataFrame, results: DataFrame) -> DataFrame:
    """(rule, source) pairs without a result.  The rules are few and known; every source is met
    with each of them by an array, not by a join of two tables."""
    names = [r[0] for r in rules.select("rule").distinct().orderBy("rule").limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 rules")
    grid = sources.select("source", F.explode(F.array(*map(F.lit, names))).alias("rule")) if names else sources.select("source", F.lit(None).cast("string").alias("rule")).limit(0)
    return grid.join(results.select("rule", "source"), ["rule", "source"], "left_anti").select("rule", "source")


def absence_proofs(results: DataFrame) -> DataFrame:
    """(rule, source): committed with no detections."""
    return results.filter("outcome = 'committed' and detections = 0").select("rule", "source")


def completeness(results: DataFrame) -> DataFrame:
    """(rule, complete, detections): complete if every source committed."""
    return results.groupBy("rule").agg(F.min(F.col("outcome") == "committed").alias("complete"), F.sum("detections").alias("detections"))


@dataclass(frozen=True)
class Rule:
    """What a rule is registered with; ``detect(text)`` yields (line, column, message)."""

    namespace: str
    name: str
    revision: int = 1
    severity: str = "warning"
    claims: tuple[str, ...] = field(default=())
    detect: object = None
    #: (earlier revision, claims that still hold) for semantics, and the same for configurations.
    compatible_from: tuple[tuple[int, tuple[str, ...]], ...] = ()
    configuration_from: tuple[tuple[int, tuple[str, ...]], ...] = ()

    @property
    def identity(self) -> str:
        return f"{self.namespace}.{self.name}"


def registered(rules: list[Rule]) -> dict[str, Rule]:
    """Rules by identity; no rules, an identity twice, an unknown severity, a revision below 1 or a
    malformed declaration of compatibility raise."""
    if not rules:
        raise ValueError("no rules are selected")
    out: dict[str, Rule] = {}
    for r in rules:
        if r.identity in out:
            raise ValueError(f"rule {r.identity} is registered twice")
        if r.severity not in ("info", "warning", "error") or r.revision < 1:
            raise ValueError(f"rule {r.identity} has a wrong severity or revision")
        _check_declarations(r)
        out[r.identity] = r
    return out


def _check_declarations(r: Rule) -> None:
    """Semantics: one declaration for each earlier revision.  Configurations: one for each revision
    and claim, of this revision or an earlier one whose semantics are declared for the claim too."""
    semantic = dict(r.compatible_from)
    if len(semantic) != len(r.compatible_from):
        raise ValueError(f"rule {r.identity} declares a revision twice")
    if any(revision >= r.revision for revision in semantic):
        raise ValueError(f"rule {r.identity} declares compatibility from a revision that isn't earlier")
    claims = [(revision, c) for revision, given in r.configuration_from for c in given]
    if len(set(claims)) != len(claims):
        raise ValueError(f"rule {r.identity} declares a configuration claim twice")
    for revision, claim in claims:
        if revision > r.revision or (revision != r.revision and claim not in semantic.get(revision, ())):
            raise ValueError(f"rule {r.identity} declares a configuration claim without its semantics")


#: The catalog of code smells by support.
SMELLS = {
    "supported": ("Long Function", "Long Parameter List", "Global Data", "Large Class"),
    "research": (
        "Duplicated Code", "Mutable Data", "Divergent Change", "Shotgun Surgery", "Feature Envy", "Data Clumps", "Repeated Switches", "Lazy Element", "Speculative Generality",
        "Temporary Field", "Message Chains", "Middle Man", "Insider Trading", "Alternative Classes with Different Interfaces", "Data Class", "Refused Bequest",
    ),
    "notReliablyObservable": ("Mysterious Name", "Primitive Obsession", "Loops", "Comments"),
}


def smell_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s) for s, names in SMELLS.items() for n in names], "name string, support string")
