"""Media columns: content-defined payload chunks, deduplicated, stored, and rebuilt from lists.

The payload of a document (its UTF-8 text, zero bytes appended to a positive multiple of 64) is
stored as 8-bit mono PCM samples in a WAV file.  A rolling gear hash cuts the file at content
defined places; each chunk is named by its SHA-256.

1. One pass over the texts writes the ordered chunk lists: a row for each document with its
   file's digest and the digests of the chunks.  No bytes are in it.
2. A second pass gives the chunks, compressed; a shuffle on the digest (each task keeps a chunk
   once before it) leaves one row for each digest, and this chunk store is written to the shared
   folder.  Bytes are shuffled here, and of files of several chunks once more by their file.
3. The store is read back.  A chunk that is a whole file is read where it lies; the lists of
   longer files are joined to the store and gathered by file.  Length and digest of each chunk
   and each file are verified before the payload is taken from it, and the documents meet what
   was read back by a join on the file's digest.

The gear hash of a byte depends on the 32 bytes up to it only, so cuts are the same wherever
the same content stands.  Equal payloads share one file.  Chunks are compressed with a
dictionary trained on ``SAMPLE_TEXTS`` texts (short chunks hold too little to learn from); it is
part of the store, and no result depends on it.

Defined results: a null or empty text has a payload of 64 zero bytes; repeated rows and equal
texts give equal values; an empty table gives an empty result; null ids are kept; further
columns are ignored.  A chunk that doesn't match its digest stops the run with an error.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNIT = 64
LEAST, MOST = 2_048, 65_536
#: A cut where the high bits of the gear hash are all zero: 8 KB from the least size on average.
MASK_BITS = 13
_MASK = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))
SEED = 42
_RATE = 8_000


@functools.lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str) -> tuple[bytes, int]:
    """The padded payload, and the bytes of the text alone."""
    data = text.encode()
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data.ljust(size, b"\0"), len(data)


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono PCM samples."""
    le = lambda n, k: int(n).to_bytes(k, "little")
    head = b"fmt " + le(16, 4) + le(1, 2) + le(1, 2) + le(_RATE, 4) + le(_RATE, 4) + le(1, 2) + le(8, 2)
    body = b"WAVE" + head + b"data" + le(len(samples), 4) + samples
    return b"RIFF" + le(len(body), 4) + body


def samples_of(data: bytes) -> bytes:
    """The samples of a file that ``wav`` made."""
    if data[:4] != b"RIFF" or data[8:16] != b"WAVEfmt " or data[36:40] != b"data":
        raise ValueError("not a WAV file of this operator")
    size = int.from_bytes(data[40:44], "little")
    if len(data) != 44 + size:
        raise ValueError("the file's length doesn't match its header")
    return data[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: at least LEAST bytes, at most MOST (the last may be shorter)."""
    if len(data) <= LEAST:
        return [len(data)]
    # h[i] = sum over k < 32 of gear[data[i - k]] << k, in five doublings.
    h = _gear()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    places = np.flatnonzero((h & _MASK) == 0) + 1
    out, last, p = [], 0, 0
    while len(data) - last > LEAST:
        p = int(np.searchsorted(places, last + LEAST))
        end = int(places[p]) if p < len(places) else len(data)
        last = min(end, last + MOST, len(data))
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def feature(samples: bytes) -> str:
    """Length, mean, spread, zero crossings about the mean, and a histogram of 8 levels."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    mean = x.mean()
    side = x > mean
    crossings = int((side[1:] != side[:-1]).sum())
    levels = np.bincount(x >> 5, minlength=8)
    return f"n={len(x)};mean={mean:.4f};sd={x.std():.4f};zc={crossings};hist=" + ".".join(map(str, levels))


def files_of(texts: list[str | None]) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """For each text: its bytes, its file's digest and the file's chunks."""
    for t in texts:
        payload, n = payload_of(t or "")
        data = wav(payload)
        ends = cuts(data)
        yield n, hashlib.sha256(data).digest(), [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def chunk_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, file, chunks): for each document the digest of its file and the digests of
    the file's chunks in order (a file of one chunk has its own digest there).  No shuffle."""
    common.ship(docs.sparkSession)
    common.short_batches(docs.sparkSession)
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("file", T.BinaryType()), T.StructField("chunks", T.ArrayType(T.BinaryType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: tuple[list, list, list] = ([], [], [])
            for n, name, parts in files_of(b.column(1).to_pylist()):
                row = (n, name, [name] if len(parts) == 1 else [hashlib.sha256(p).digest() for p in parts])
                for column, value in zip(made, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=[key, *(f.name for f in fields)])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], *fields]))


#: Texts that the dictionary of the store is trained on, its bytes, and the compression level.
SAMPLE_TEXTS, DICTIONARY_BYTES, LEVEL = 1_000, 112_640, 6


def dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """The compression dictionary of a store; no bytes where the texts are too few for one."""
    rows = docs.select(text).filter(F.length(text) > 0).limit(SAMPLE_TEXTS).collect()
    parts = [p for _, _, parts in files_of([r[0] for r in rows]) for p in parts[:8]]
    if sum(map(len, parts)) < 10 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # texts of which nothing can be learned
        return b""


def _trained(trained: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}


#: Digests that a task remembers to have given, and bytes of one batch of chunks.
SEEN, BATCH_BYTES = 200_000, 4 << 20


def chunks_of(docs: DataFrame, text: str = "text", trained: bytes = b"") -> DataFrame:
    """(digest, whole, bytes): the chunks of all files, compressed; ``whole`` if the chunk is a
    file by itself.  Within a task a chunk comes out once, mostly."""
    common.ship(docs.sparkSession)
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, **_trained(trained))
        seen: set[bytes] = set()
        rows: list[tuple[bytes, bool, bytes]] = []
        size = 0

        def handed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.bool_(), pa.binary()), strict=True)], names=["digest", "whole", "bytes"])

        for b in batches:
            for _, name, parts in files_of(b.column(0).to_pylist()):
                for part in parts:
                    digest = name if len(parts) == 1 else hashlib.sha256(part).digest()
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        rows.append((digest, len(parts) == 1, squeeze.compress(part)))
                        size += len(rows[-1][2])
                if size > BATCH_BYTES:
                    yield handed()
                    size = 0
        yield handed()

    return docs.select(text).mapInArrow(run, "digest binary, whole boolean, bytes binary")


def store_of(chunks: DataFrame) -> DataFrame:
    """The chunk store: (digest, whole, bytes), one row for each digest."""
    return chunks.groupBy("digest").agg(F.first("whole").alias("whole"), F.first("bytes").alias("bytes"))


def _read_back(name: bytes, parts: list[tuple[bytes, bytes]], expand: zstandard.ZstdDecompressor) -> tuple:
    """(file, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    whole = []
    for digest, squeezed in parts:
        part = expand.decompress(squeezed)
        if hashlib.sha256(part).digest() != digest:
            raise ValueError("a stored chunk doesn't match its digest")
        whole.append(part)
    data = b"".join(whole)
    if hashlib.sha256(data).digest() != name:
        raise ValueError("a rebuilt file doesn't match its digest")
    got = samples_of(data)
    return name, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(data), name.hex(), feature(got)


_READ = "file binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [c.split()[0] for c in _READ.split(", ")]
_KINDS = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def rebuilt(lists: DataFrame, store: DataFrame, trained: bytes = b"") -> DataFrame:
    """What is read back of each file of ``lists`` (file, chunks) from ``store``."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(**_trained(trained))
        for b in batches:
            yield _as_batch([_read_back(d, [(d, x)], expand) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(**_trained(trained))
        for b in batches:
            for f, parts in zip(b.column(0), b.column(1), strict=True):  # one file at a time
                yield _as_batch([_read_back(f.as_py(), [(c["digest"], c["bytes"]) for c in parts.as_py()], expand)])

    one = store.filter("whole").select("digest", "bytes").mapInArrow(alone, _READ)
    longer = lists.filter(F.size("chunks") > 1).select("file", "chunks").dropDuplicates(["file"]).select("file", F.posexplode("chunks").alias("seq", "digest"))
    met = longer.join(store.filter(~F.col("whole")).select("digest", "bytes"), "digest")
    # One file's chunks: as much as the one text that they came from.
    more = met.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "bytes"))).alias("chunks"))
    return one.unionByName(more.mapInArrow(gathered, _READ))


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes) of each document with what is read back of its file."""
    lists = common.stash(chunk_lists(docs, key, text), "chunk-lists")
    trained = dictionary(docs, text)
    store = common.stash(store_of(chunks_of(docs, text, trained)), "chunk-store")
    return lists.select(key, "n_bytes", "file").join(rebuilt(lists, store, trained), "file", "left").drop("file")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_media(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
