"""URL filters: explicit host and path rules first, then association rules mined from labels.

Every url becomes a set of tokens (host labels, top domains, path parts, query keys, scheme).
Spark's FP-growth mines the token sets of labelled urls with their label as one more item; rules
``tokens -> block`` are pruned by support and confidence, and by any shorter rule that holds
already.  Tokens that stand in exactly the same token sets (the labels of one host, the parts of one
path) are mined as one, which loses no rule and keeps the sets from doubling with each of them.
Rules are matched through an inverted index: a rule is posted under its rarest token,
urls meet it there, and the rest of its tokens are checked.

Labels come from ``labels`` alone, by the page's id: ``block`` if it is toxic or of quality 0.  What
the explicit rules say of a page is never learnt from.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and
has the single token ``none``; repeated rows are judged alike; with no labels no rule is mined,
and what no rule fits is allowed; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (rule, host, path, verdict): fixed values of the contract.
RULES = [
    ("net/", "net", "/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"),
    ("org/fr/", "org", "/fr/", "allow"),
]
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Labelled rows that a rule must block rightly, whatever the support share.
MIN_ROWS = 20
BLOCK = "=block"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host and path of a url column by the contract's definition."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    # Lower-casing is for A-Z only.
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def explicit(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest explicit rule that fits, and its verdict (nulls if none does)."""
    rule = verdict = None
    for name, h, p, v in sorted(RULES, key=lambda r: -len(r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(name)) if rule is None else rule.when(fits, F.lit(name))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def tokens(url: str, host: Column, path: Column) -> Column:
    """The distinct tokens of a url."""
    parts = F.filter(F.split(host, r"\."), lambda x: x != "")
    names = F.transform(parts, lambda x: F.concat(F.lit("host:"), x))
    domain = F.when(F.size(parts) >= 2, F.array(F.concat(F.lit("domain:"), F.array_join(F.slice(parts, -2, 2), "."))))
    path_parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), F.lit(r"([^&=]+)="), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(F.col(url), "://", 1)))
    whole = F.array_distinct(F.filter(F.concat(names, F.coalesce(domain, F.array().cast("array<string>")), path_parts, keys, scheme), lambda x: x.isNotNull()))
    return F.when((host == "") | F.col(url).isNull(), F.array(F.lit("none"))).otherwise(whole)


def classes_of(sets: DataFrame) -> DataFrame:
    """(token, item): ``item`` is the least of the tokens that stand in the same rows of ``sets``
    (id, tokens; distinct token sets)."""
    each = sets.select(F.explode("tokens").alias("token"), F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("g"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor("g").alias("b"))
    least = marks.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return marks.join(least, ["n", "a", "b"]).select("token", "item")


def mine(labelled: DataFrame) -> DataFrame:
    """(rule, tokens, anchor, confidence): rules ``tokens -> block`` from (tokens, bad).

    A rule's tokens are the least ones of their classes.  Support and confidence are those of all
    labelled rows."""
    spark = labelled.sparkSession
    empty = "rule long, tokens array<string>, anchor string, confidence double"
    if labelled.limit(1).count() == 0:
        return spark.createDataFrame([], empty)
    counted = common.stash(labelled.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).withColumn("id", F.monotonically_increasing_id()), "url-sets")
    items = common.stash(classes_of(counted), "url-classes")
    named = counted.select("id", F.explode("tokens").alias("token")).join(items, "token").groupBy("id").agg(F.collect_set("item").alias("items"))
    # Each set as often as it occurs, for FP-growth counts rows; with the label as one more item.
    rows = counted.join(named, "id").select("items", F.explode(F.array(F.struct(F.lit(True).alias("is"), F.col("bad").alias("times")), F.struct(F.lit(False).alias("is"), (F.col("n") - F.col("bad")).alias("times")))).alias("part"))
    rows = rows.select(F.when(F.col("part.is"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"), F.explode(F.expr("if(part.times > 0, sequence(1, part.times), cast(array() as array<bigint>))")).alias("k")).select("items")
    baskets = common.stash(rows, "url-baskets")
    found = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(baskets)
    sets = common.stash(found.freqItemsets, "url-itemsets")
    common.release(baskets, counted, items)
    alone = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    left = sets.filter(~F.array_contains("items", BLOCK)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    both = sets.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCK)).alias("tokens"), F.col("freq").alias("bad"))
    rules = left.join(both, "tokens").withColumn("confidence", F.col("bad") / F.col("n")).filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("bad") >= MIN_ROWS))
    ranked = rules.select(F.xxhash64("tokens").alias("rule"), "tokens", "confidence", F.explode("tokens").alias("token")).join(alone, "token")
    posted = common.stash(ranked.groupBy("rule").agg(F.first("tokens").alias("tokens"), F.min(F.struct("freq", "token"))["token"].alias("anchor"), F.first("confidence").alias("confidence")), "url-candidates")
    # A rule is superfluous if a rule of fewer of its tokens holds too: rules meet each other in
    # the same inverted index that urls meet them in.
    asked = posted.select(F.col("rule").alias("long"), F.col("tokens").alias("whole"), F.explode("tokens").alias("anchor"))
    beaten = asked.join(posted.select("anchor", "tokens"), "anchor").filter((F.size("tokens") < F.size("whole")) & (F.size(F.array_except("tokens", "whole")) == 0)).select(F.col("long").alias("rule")).distinct()
    rules = common.stash(posted.join(beaten, "rule", "left_anti"), "url-rules")
    common.release(sets, posted)
    return rules


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", key: str = "page_id", label_key: str = "doc_id") -> DataFrame:
    """(key, host, path, rule, verdict, mined_rule) for each row of ``pages``."""
    host, path = host_and_path("__cl_url")
    base = pages.select(F.col(key), F.col(url).cast("string").alias("__cl_url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = explicit(F.col("host"), F.col("path"))
    base = base.withColumn("rule", rule).withColumn("__cl_said", verdict).withColumn("__cl_tokens", tokens("__cl_url", F.col("host"), F.col("path")))
    marks = labels.groupBy(F.col(label_key).cast("long").alias("__cl_label")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("__cl_bad")).dropna()
    told = base.select(F.col(key).cast("long").alias("__cl_id"), F.col("__cl_tokens").alias("tokens"))
    labelled = told.join(marks, told["__cl_id"] == marks["__cl_label"]).select("tokens", F.col("__cl_bad").alias("bad"))
    rules = mine(labelled)
    # Distinct token sets meet the index once each, however many pages share them.
    sets = base.filter(F.col("rule").isNull()).select("__cl_tokens").distinct()
    met = sets.select("__cl_tokens", F.explode("__cl_tokens").alias("anchor")).join(rules.select("anchor", "tokens", "rule", "confidence"), "anchor")
    met = met.filter(F.size(F.array_except("tokens", "__cl_tokens")) == 0)
    best = met.groupBy("__cl_tokens").agg(F.max(F.struct("confidence", F.array_join("tokens", " ").alias("text")))["text"].alias("mined_rule"))
    hit = common.stash(best, "url-hits")
    full = base.join(hit, "__cl_tokens", "left")
    mined = F.when(F.col("rule").isNull(), F.col("mined_rule"))
    said = F.coalesce("__cl_said", F.when(mined.isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return full.select(key, "host", "path", "rule", said.alias("verdict"), mined.alias("mined_rule"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, common.table(spark, sf_dir, "labels"))
