"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.

Base spans are emails, ip addresses, payment cards and phone numbers.  Each base value is a
protected entity.  A term (a run of four letters or more, lower-cased, outside of base emails) of
a document that holds the entity discloses it when

    PMI(entity; term) = log2(N * c(entity, term) / (c(entity) * c(term)))
    IC(entity)        = log2(N / c(entity))
    PMI >= ALPHA * IC

where the counts are numbers of documents over the whole corpus, whole texts each.  All places of
such a term in the documents that hold the entity are spans of kind ``term``, and are generalised
in ``sanitise``; documents without personal data are left alone.  There is no least number of
documents: what stands with a value and nowhere else in the corpus tells all about it.

Entities that stand in exactly the same documents have equal counts with every term, so they are
one class; pairs are those of a class and a term, and an entity's terms are counted in the
distinct texts that hold it, each as often as it occurs.  DataFrame functions only.  Texts are
read twice and never shuffled; the shuffles hold words and their counts.

Defined results: a null or empty text has no spans; repeated rows have the same spans, and each
counts as a document; an empty table gives an empty result; null ids are kept; further columns
are ignored; an entity that stands in every document discloses nothing and is disclosed by none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native_spans import count_of, joined, of_kind, redacted, with_spans

ALPHA = 0.9
TERM = r"[\p{L}]{4,}"
#: Kind -> expression, each equal to the plain one of the contract but of linear time and stack:
#: runs are entered at their start only, and loops over groups are possessive (a plain loop over
#: a group of varying length recurses once for each round) or of bounded length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_SMALL = r"^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Whether the digits pass the Luhn sum, counted from the right."""
    back = F.split(F.reverse(_digits(hit)), "")
    value = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.rlike(_SMALL))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _only_valid(kind: str) -> Column:
    return F.filter(f"__cl_{kind}", lambda s: _valid(kind, s["hit"]))


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with one array of spans (start, end, hit) for each kind, named ``__cl_<kind>``."""
    on = {
        "email": F.contains(F.col(text), F.lit("@")),
        "ip": F.col(text).rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": F.col(text).rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": F.contains(F.col(text), F.lit("+")),
    }
    found = with_spans(docs, text, {f"__cl_{k}": (p, on[k]) for k, p in PATTERNS.items()})
    return found.select(*docs.columns, *[_only_valid(k).alias(f"__cl_{k}") for k in KINDS])


def _entities() -> Column:
    """All base values of a row, each once; an entity is a kind and a value."""

    def of(kind: str) -> Column:
        return F.transform(f"__cl_{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s["hit"]))

    return F.array_distinct(F.concat(*map(of, KINDS)))


def facts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: ``keep``, base spans, and for those that have some the text's
    digest, the entities and the places of all terms.  Kept in the shared folder."""
    whole = docs.select(*keep, common.whole_text(text).alias("__cl_text"))
    base = with_base(whole, "__cl_text").withColumn("__cl_entities", _entities())
    some = F.size("__cl_entities") > 0
    # An email is passed over as a whole, so no part of it is a term.
    worded = with_spans(base, "__cl_text", {"__cl_words": (f"{PATTERNS['email']}|{TERM}", some)})
    words = F.transform(F.filter("__cl_words", lambda w: ~F.contains(w["hit"], F.lit("@"))), lambda w: F.struct(F.lower(w["hit"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))
    return common.stash(worded.withColumn("__cl_words", words).withColumn("__cl_key", F.when(some, F.sha2("__cl_text", 256))).drop("__cl_text"), "pii-facts")


def disclosing(docs: DataFrame, texts: DataFrame, text: str, total: int) -> DataFrame:
    """(key, term): the terms that exceed the disclosure threshold for an entity of the text.

    ``texts``: (key, copies, entities, words) of the distinct texts that hold entities."""
    held = texts.select("key", "copies", F.explode("entities").alias("entity"))
    marks = held.groupBy("entity").agg(F.sum("copies").alias("c_e"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    marks = marks.select("entity", "c_e", F.xxhash64("c_e", "a", "b").alias("class"))
    classes = held.join(marks, "entity").select("key", "copies", "class", "c_e").distinct()
    terms = texts.select("key", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    both = common.stash(classes.join(terms, "key"), "pii-joint")
    joint = both.groupBy("class", "c_e", "term").agg(F.sum("copies").alias("c_et"))
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(common.whole_text(text), F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    asked = common.stash(both.select("term").distinct(), "pii-terms")
    per_term = words.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("c_t")) if _few(asked) else words.groupBy("term").agg(F.count("*").alias("c_t"))
    pmi = F.log2(F.lit(float(total)) * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    sure = joint.join(per_term, "term").filter((F.col("c_e") < total) & (pmi >= ALPHA * F.log2(F.lit(float(total)) / F.col("c_e")) - 1e-9))
    return both.join(sure.select("class", "term"), ["class", "term"]).select("key", "term").distinct()


#: Terms up to which the planner may hold them all at once, to count no others.
FEW_TERMS = 20_000


def _few(asked: DataFrame) -> bool:
    return asked.count() <= FEW_TERMS


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with __cl_found: all spans (rank, start, kind, end) by kind and start."""
    rows = facts(docs, text, keep)
    texts = rows.filter(F.col("__cl_key").isNotNull()).groupBy(F.col("__cl_key").alias("key")).agg(F.count("*").alias("copies"), F.first("__cl_entities").alias("entities"), F.first("__cl_words").alias("words"))
    texts = common.stash(texts, "pii-texts")
    pairs = disclosing(docs, texts, text, rows.count())
    places = texts.select("key", F.explode("words").alias("w")).select("key", "w.term", "w.start", "w.end").join(pairs, ["key", "term"])
    terms = common.stash(places.groupBy(F.col("key").alias("__cl_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cl_term")), "pii-places")
    # Texts without entities have no key; a value of their own spreads them over the join's tasks.
    spread = F.coalesce("__cl_key", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    full = rows.drop("__cl_words", "__cl_entities").withColumn("__cl_key", spread).join(terms, "__cl_key", "left").withColumn("__cl_term", F.coalesce("__cl_term", F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    found = F.concat(*[of_kind(F.col(f"__cl_{k}"), i, k) for i, k in enumerate((*KINDS, "term"))])
    return full.select(*keep, F.array_sort(F.transform(found, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).alias("__cl_found"))


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text): texts with entities and disclosing terms replaced by their kind in brackets.
    The text is shuffled once, to meet its spans; rows of the same key must have equal texts."""
    spans = find(docs, text, (key,)).select(F.col(key).alias("__cl_id"), F.array_sort(F.transform("__cl_found", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("__cl_spans"))
    spans = spans.groupBy("__cl_id").agg(F.first("__cl_spans").alias("__cl_spans"))
    both = docs.join(spans, docs[key].eqNullSafe(F.col("__cl_id")), "left").withColumn("__cl_text", common.whole_text(text))
    return both.select(key, F.expr(redacted("__cl_text", "__cl_spans")).alias(text))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs)
    base = F.filter("__cl_found", lambda s: s["kind"].isin(*KINDS))
    counts = [count_of("__cl_found", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__cl_found")).alias("spans"))
