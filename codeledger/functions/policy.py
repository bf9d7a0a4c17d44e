"""Fixed values of the scoring policy: thresholds, weights, words.  Stated here and nowhere else."""

from __future__ import annotations

# --- fixed values ---------------------------------------------------------------------------
METRICS = ("LOCC", "WMCC", "NOMC", "NOGC", "NOCC", "NOAV", "LOCF", "CCF", "NOPF", "DC")
THRESHOLDS = {"LOCC": 500, "WMCC": 200, "CCF": 20, "NOPF": 10, "DC": 10}
SCORING_MODES = ("none", "paper", "bounded", "corrected")

CALLABLE_EVIDENCE = [("cognitive-complexity", "cognitive", 15, 2.0), ("cyclomatic-complexity", "complexity", 20, 1.0), ("nesting-depth", "max_nesting", 5, 1.0), ("function-lines", "code_lines", 60, 0.5), ("parameter-count", "parameters", 6, 0.5)]
TYPE_EVIDENCE = [("type-lines", "code_lines", 500, 1.0), ("method-count", "method_count", 30, 1.0), ("property-count", "property_count", 20, 1.0), ("weighted-method-complexity", "wmcc", 200, 1.0)]
FILE_EVIDENCE = [("file-lines", "code_lines", 1000, 1.0), ("file-type-count", "type_count", 20, 0.5), ("file-callable-count", "callable_count", 80, 0.5), ("duplicate-lines", "duplicate_lines", 20, 1.0)]
MODULE_EVIDENCE = [("module-lines", "code_lines", 5000, 1.0), ("module-file-count", "file_count", 100, 0.5), ("module-type-count", "type_count", 100, 0.5), ("module-callable-count", "callable_count", 400, 0.5)]
KIND_PREFIX = "swift."

SIDE_EFFECT_WEIGHTS = {"mutation": 1.0, "inoutMutation": 1.25, "propertyWrite": 1.5, "globalOrStaticState": 2.0, "asyncEffect": 1.0, "throwingEffect": 1.0, "closureEffect": 1.25}
RISK_WEIGHTS = {
    "isolationCrossing": 1.25, "actorIsolation": 0.75, "globalActorIsolation": 1.0, "sendableConformance": 0.75, "uncheckedSendable": 2.0,
    "unstructuredTask": 1.75, "nonisolatedDeclaration": 1.5, "mutableSharedState": 2.0, "unsafeEscapeHatch": 2.0,
}
SHARED_STATE_KIND = "swift.shared-state.mutable"
RISK_KIND_PREFIX = "swift.concurrency-risk."

PRIORITIES = ("low", "medium", "high", "critical")
#: preset -> (least score of critical, high, medium)
PRIORITY_CUTS = {"strict": (75.0, 50.0, 25.0), "balanced": (85.0, 70.0, 40.0), "lenient": (92.0, 80.0, 55.0)}
PROBLEMATIC = {"strict": 40.0, "balanced": 70.0, "lenient": 85.0}
AVAILABLE_STATES = ("available", "zeroCoverage", "measuredCoverage")
DAMPENER_PREFIX = "coverage."

FIX_WORDS = ("fix", "bug", "crash", "defect", "regression", "hotfix", "repair")
COMMITS_PER_PATH = 500
MINIMUM_DUPLICATE_LINES = 11
MAXIMUM_DUPLICATE_COMPARISONS = 250_000
REPOSITORY_LIMITS = {"files": 10_000, "bytes": 256 * 1024 * 1024, "units": 50_000, "comparisons": 250_000, "detections": 10_000}
MAXIMUM_VECTOR_LIMIT = 256
MAXIMUM_VECTOR_CANDIDATES = 10_000
# --- end of fixed values --------------------------------------------------------------------
