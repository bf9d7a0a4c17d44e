"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints link at ``MAX_BITS`` or fewer differing bits; a component is everything reachable
over links.

Pivot distance table: for each distinct fingerprint, its Hamming distances to the 65 reference
fingerprints of ``pivots()``: zero, and 16 random patterns in each of four 16-bit blocks.  The
distance to a pattern less the distance to zero depends on the bits of that block alone, so the
coordinates of one block agree wherever the bits of the block agree.  Two differing bits leave
at least two of four blocks untouched: every linked pair agrees in the coordinates of some two
blocks, and the six pairs of blocks are the join keys.  Candidates are discarded where any
coordinate differs by more than ``MAX_BITS`` (triangle inequality), and survivors are verified.

A key that many fingerprints share (a large group of near copies) would give pairs that grow
with the square of the group.  Beyond ``BUCKET`` members its fingerprints are linked through the
vectors at distance 0 or 1 instead: two fingerprints differ in at most two bits exactly if they
share such a vector, and a vector has at most 65 of them.  No link is lost, none is capped.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link
like any other; equal texts have equal fingerprints; null ids are kept, and are no component's
id unless all its ids are null; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

MAX_BITS = 2
SHINGLE = 3
SEED = 42
BLOCKS, WIDTH, PATTERNS = 4, 16, 16
#: Members of a key up to which its pairs are compared; larger keys go another, exact way.
BUCKET = 32
FINGERPRINT = "__cl_fp"


def fingerprint(text: str) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        flat = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[s:e], SEED) for s, e in zip(itertools.chain((0,), (e + 1 for e in ends)), ends[SHINGLE - 1 :])]
    ones, step = np.zeros(64, dtype=np.int64), 1 << 15
    for k in range(0, len(hashes), step):
        part = np.array(hashes[k : k + step], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = FINGERPRINT) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in ``out`` (long).  No shuffle."""
    return common.map_texts(docs, text, lambda: lambda texts: ([fingerprint(t) for t in texts],), [T.StructField(out, T.LongType())])


def pivots() -> list[int]:
    """The reference fingerprints: zero first, then the patterns of each block."""
    rng = random.Random(SEED)
    found = [0]
    for b in range(BLOCKS):
        found += [rng.randrange(1, 1 << WIDTH) << (WIDTH * b) for _ in range(PATTERNS)]
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(nodes: DataFrame) -> DataFrame:
    """(fp, coords): the distances of each fingerprint to every pivot."""
    return nodes.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("byte") for p in pivots()]).alias("coords"))


def _block_key(block: int) -> list[Column]:
    first = 1 + block * PATTERNS
    return [F.col("coords")[first + k] - F.col("coords")[0] for k in range(PATTERNS)]


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): links whose components are those of all pairs with at most two differing bits.

    ``nodes``: distinct fingerprints in ``fp``.
    """
    spark = nodes.sparkSession
    tabled = pivot_table(nodes)
    pairs_of_blocks = list(itertools.combinations(range(BLOCKS), 2))
    keys = F.array(*[F.xxhash64(F.lit(k), *_block_key(a), *_block_key(b)) for k, (a, b) in enumerate(pairs_of_blocks)])
    keyed = tabled.select("fp", "coords", F.posexplode(keys).alias("pair", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    live = common.stash(keyed.join(shared, "key"), "pivot-keys")
    small = live.filter(F.col("members") <= BUCKET)
    a = small.select("key", F.col("fp").alias("u"), F.col("coords").alias("cu"))
    b = small.select("key", F.col("fp").alias("v"), F.col("coords").alias("cv"))
    apart = F.exists(F.zip_with("cu", "cv", lambda x, y: F.abs(x - y) > MAX_BITS), lambda x: x)
    near = (
        a.join(b, "key").filter("u < v").filter(~apart)
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
        .select("u", "v")
    )
    # Members of a large key agree in two blocks; they can only differ in the bits of the others.
    free = [[b for b in range(64) if b // WIDTH not in p] for p in pairs_of_blocks]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in bits]) for bits in free])
    around = live.filter(F.col("members") > BUCKET).select("fp", F.explode(flips[F.col("pair")]).alias("flip"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")).distinct()
    hubs = around.groupBy("hub").agg(F.min("fp").alias("u"), F.count("*").alias("members")).filter("members > 1")
    through = around.join(hubs, "hub").select("u", F.col("fp").alias("v")).filter("u <> v")
    del spark
    return near.unionByName(through).distinct()


def with_components(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` (``key`` and FINGERPRINT, kept in the shared folder) with component_id, the
    least ``key`` of the component.  Only numbers are shuffled, never texts."""
    nodes = common.stash(rows.groupBy(F.col(FINGERPRINT).alias("fp")).agg(F.min(key).alias("least")), "fingerprints")
    linked = common.stash(graph.components(links(nodes)), "components")
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.join(ids, "root").select(F.col("fp").alias("__cl_node"), "component_id")
    return rows.join(of_node, rows[FINGERPRINT] == F.col("__cl_node"), "left").drop("__cl_node")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row for each component: the one of least ``key`` (of repeated rows any
    one, nulls last).  Rows are numbered once, in the copy that is kept in the shared folder."""
    tagged = common.stash(with_fingerprints(docs, text).withColumn("__cl_row", F.monotonically_increasing_id()), "tagged")
    slim = tagged.select("__cl_row", FINGERPRINT, key)
    grouped = common.stash(with_components(slim.withColumn("__cl_order", F.struct(F.col(key).isNull(), key, "__cl_row")), "__cl_order"), "members")
    losers = common.stash(grouped.filter(F.col("component_id.__cl_row") != F.col("__cl_row")).select("__cl_row"), "losers")
    return tagged.join(losers, "__cl_row", "left_anti").select(*docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = common.stash(with_fingerprints(docs).select("doc_id", FINGERPRINT), "doc-fingerprints")
    out = with_components(rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex(FINGERPRINT), 16, "0")).alias("fingerprint"), "component_id")
