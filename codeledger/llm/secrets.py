"""Secret scans with a trigram inverted index.

From every rule's regular expression a Boolean trigram query is derived (an OR of ANDs of
trigrams that any match must hold).  The index has a posting for each (trigram, text) of the
trigrams that the queries ask for; postings are intersected by counting, and only the
candidates are verified with the expression itself.  A rule without mandatory trigrams (a run
of hex digits has none) scans every text in full.  DataFrame functions only.

The index stands in the shared folder, so its size is known: the planner broadcasts the
candidates only below its own threshold, and shuffles beyond it.  Texts are keyed by a 64-bit
hash; two texts that share a hash only make one more candidate, which is then verified.

Base kinds are ``assign``, ``access`` and ``hex``; the method adds ``pem``, ``forge`` and
``chat`` (private key headers, source-forge tokens, chat tokens).

Defined results: a null or empty text has no secrets; repeated rows have the same; an empty
table gives an empty result; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native_spans import count_of, joined, of_kind, redacted, with_spans

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind -> expression.  ``access`` and ``hex`` hold their least lengths: a run that is too
#: short in whole has no long enough part.  ``assign`` doesn't, since a failing match uses up
#: what it covers; its value is measured afterwards.
RULES = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
_BREAK = None
_MOST = 64


def _words(seq) -> list[list[str | None]]:
    """What any match of a parsed sequence holds, as alternatives: lists of literal characters
    with a break (None) where anything may stand."""
    out: list[list[str | None]] = [[]]
    for op, arg in seq:
        if op is sre.LITERAL:
            more = [[chr(arg)]]
        elif op is sre.SUBPATTERN:
            more = _words(arg[-1])
        elif op is sre.BRANCH:
            more = [w for branch in arg[1] for w in _words(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                more = [[], *_words(inner)]
            elif least:
                more = [[*w, _BREAK, *w] if least > 1 or most != 1 else w for w in _words(inner)]
            else:
                more = [[_BREAK]]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            more = [[]]
        elif op is sre.IN and 1 < len(arg) <= 8 and all(k is sre.LITERAL for k, _ in arg):
            more = [[chr(v)] for _, v in arg]
        else:
            more = [[_BREAK]]
        if len(out) * len(more) > _MOST:
            more = [[_BREAK]]
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams; None if some match needs no trigram."""
    found = set()
    for word in _words(parser.parse(pattern)):
        runs = "".join("\0" if c is _BREAK else c for c in word).lower().split("\0")
        found.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in found:
        return None
    return sorted((q for q in found if not any(other < q for other in found)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str], text: str) -> DataFrame:
    """The index: (trigram, place), a row for each text hash that holds the trigram."""
    low = docs.select(F.xxhash64(text).alias("place"), F.lower(text).alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return low.select("place", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: dict[str, str], text: str) -> DataFrame:
    """(place, rules): the rules whose trigram query the text with this hash fulfils."""
    spark = docs.sparkSession
    terms = [(rule, k, t, len(q)) for rule, p in rules.items() for k, q in enumerate(trigram_query(p) or []) for t in sorted(q)]
    index = common.stash(postings(docs, sorted({t for _, _, t, _ in terms}), text), "trigram-index")
    asked = F.broadcast(spark.createDataFrame(terms, "rule string, branch int, trigram string, need int"))  # as many rows as the rules have trigrams
    met = index.join(asked, "trigram").groupBy("place", "rule", "branch", "need").agg(F.count("*").alias("have")).filter("have = need")
    return common.stash(met.groupBy("place").agg(F.collect_set("rule").alias("rules")), "trigram-candidates")


def scan(docs: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with __cl_found: all spans (start, rank, kind, end), sorted by start and kind."""
    rules = rules or RULES
    whole = docs.withColumn("__cl_text", common.whole_text(text))
    found = candidates(whole, rules, "__cl_text").select(F.col("place").alias("__cl_place"), F.col("rules").alias("__cl_rules"))
    held = whole.withColumn("__cl_place", F.xxhash64("__cl_text")).join(found, "__cl_place", "left")

    def on(rule: str, pattern: str) -> Column:
        if trigram_query(pattern) is None:
            return F.col("__cl_text").rlike(pattern)
        return F.coalesce(F.array_contains("__cl_rules", rule), F.lit(False))

    spans = with_spans(held, "__cl_text", {f"__cl_{k}": (p, on(k, p)) for k, p in rules.items()})
    kept = []
    for rank, kind in enumerate(rules):
        mine = F.col(f"__cl_{kind}")
        if kind == "assign":
            mine = F.filter(mine, lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= LEAST_VALUE)
        kept.append(of_kind(mine, rank, kind))
    return spans.select(*docs.columns, "__cl_text", F.array_sort(F.concat(*kept)).alias("__cl_found"))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets, and ``n_chars``
    (if there is such a column) counted anew for the texts that changed."""
    found = scan(docs, text).withColumn("__cl_out", F.when(F.size("__cl_found") > 0, F.expr(redacted("__cl_text", "__cl_found"))).otherwise(F.col(text)))
    changed = F.size("__cl_found") > 0
    cols = [
        F.col("__cl_out").alias(c) if c == text
        else F.when(changed, F.length("__cl_out").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == n_chars
        else F.col(c)
        for c in docs.columns
    ]
    return found.select(*cols)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    base = F.filter("__cl_found", lambda s: s["kind"].isin(*BASE))
    counts = [count_of("__cl_found", k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__cl_found")).alias("spans"))
