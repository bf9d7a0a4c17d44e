"""Token ids in Arrow files of equal-length sequences with masks, and their random access.

Documents are spread by ranges of their key and sorted within each, so the files, in the order of
their numbers, hold the ids of all documents in ascending order.  Each task streams one range:

* ``part-<number>-<name>.arrow`` is an Arrow stream in the file form (its footer has the place
  of each batch).  Every batch but the last holds ``ROWS`` sequences: ``ids``, a fixed-size list
  of ``length`` unsigned integers (16 bits where the vocabulary allows it), and ``mask``, a
  fixed-size list of as many booleans, false only for the padding behind a file's last id.  There
  are no offsets and no compression, so sequence k is row k % ROWS of batch k // ROWS and is read
  from a mapped file without a copy.
* ``part-<number>-<name>.index.arrow`` has (doc_id, start, n_tokens) of each document, start
  counted from the file's first id.

A document is packed behind the one before it and may run over several sequences.  A file
counts only once its task's row of the manifest is written, so tasks that run twice or die leave
files that nothing reads; they go with the application's folder.

Texts are encoded by the ``tokenizers`` library.  They are cut before single spaces behind a
character that isn't white space, where byte-level pieces begin anyway, and each worker keeps the
ids of the words that it has met (once it has ``CACHE_WORDS``, it starts anew).  The pieces of a
word go through the library's model; words with an added token in them, through the whole of it.

Defined results: a null or empty text has the end id alone; documents without an id come first;
rows of one id are ordered by a hash of their text; repeated rows are written again; an empty
table has no files and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe_codec import splitter, spread
from .token_count import byte_alphabet

LENGTH = 2_048
#: Sequences of one batch.
ROWS = 64
CACHE_WORDS = 1_000_000
END_ID = 0


#: White space before a space.
_NOT_SINGLE = re.compile(r"\s ").search


class Places(dict):
    """Word -> its place; a word that is met for the first time gets the next one.  What stands
    behind a space is a string, what begins a text a tuple of one."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file of byte-level BPE, each distinct word encoded once."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("an added token with white space may stand across words")
        self.split = splitter(pattern)
        self.shown = dict(enumerate(byte_alphabet()))
        self.model = self.tokenizer.model
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.begin()

    def begin(self) -> None:
        self.places = Places()
        self.ids, self.ends, self.used = np.zeros(1 << 20, self.dtype), np.zeros(1 << 16, np.int64), 0

    def learn(self, special: bool) -> None:
        """Encode the words that have been met for the first time; ``special``: some may hold an added token."""
        words = [" " + w if isinstance(w, str) else w[0] for w in self.places.new]
        split = [None if special and any(s in w for s in self.special) else self.split(w) for w in words]
        pieces = list(dict.fromkeys(p for ps in split if ps is not None for p in ps))
        tokenize, shown = self.model.tokenize, self.shown
        made = {p: [t.id for t in tokenize(p.encode().decode("latin-1").translate(shown))] for p in pieces}
        each = [self.tokenizer.encode(w, add_special_tokens=False).ids if ps is None else made[ps[0]] if len(ps) == 1 else [i for p in ps for i in made[p]] for w, ps in zip(words, split, strict=True)]
        many = np.fromiter(map(len, each), np.int64, len(each))
        n, size = int(many.sum()), len(self.places)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while size > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + n] = np.fromiter(itertools.chain.from_iterable(each), self.dtype, n)
        self.ends[size - len(words) : size] = self.used + many.cumsum()
        self.used += n
        self.places.new.clear()

    @staticmethod
    def words(text: str) -> list[str]:
        """What stands between the single spaces of ``text`` that follow no white space."""
        parts = text.split(" ")
        if text[0] == " " or text[-1] == " " or _NOT_SINGLE(text):
            joined: list[str] = []
            glue = False
            for p in parts:
                if glue:
                    joined[-1] += " " + p
                else:
                    joined.append(p)
                glue = not p or p[-1].isspace()
            parts = joined
        return parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > CACHE_WORDS:
            self.begin()
        collecting = gc.isenabled()
        gc.disable()  # many small lists are made, and none in a cycle
        try:
            places = []
            place = self.places.__getitem__
            for t in texts:
                ws = self.words(t) if t else [""]
                ws[0] = (ws[0],)
                places.append(np.fromiter(map(place, ws), np.int64, len(ws)))
            if self.places.new:
                self.learn(any(s in t for s in self.special for t in texts))
        finally:
            if collecting:
                gc.enable()
        out = []
        for at in places:
            begin = np.where(at > 0, self.ends[at - 1], 0)
            out.append(self.ids[spread(begin, self.ends[at] - begin)])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> WordEncoder:
    return WordEncoder(path, pattern)


class SequenceWriter:
    """Packs ids into equal-length sequences and writes them in batches of ``rows``."""

    def __init__(self, sink, length: int, rows: int, dtype: type):
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, nullable=False), length)), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))], metadata={"length": str(length), "rows": str(rows)})
        self.out = pa.ipc.new_file(sink, self.schema)
        self.length, self.tape, self.filled, self.written = length, np.zeros(length * rows, dtype), 0, 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.tape) - self.filled)
            self.tape[self.filled : self.filled + n] = ids[at : at + n]
            self.filled, at = self.filled + n, at + n
            if self.filled == len(self.tape):
                self._flush()

    def _flush(self) -> None:
        n = -(-self.filled // self.length) * self.length
        self.tape[self.filled : n] = 0
        flat = [pa.array(self.tape[:n]), pa.array(np.arange(n) < self.filled)]
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip(flat, self.schema, strict=True)], schema=self.schema))
        self.written, self.filled = self.written + self.filled, 0

    def close(self) -> None:
        if self.filled:
            self._flush()
        self.out.close()


class SequenceFile:
    """One file of sequences; what it gives are views of the file's memory where it is local."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.file = pa.ipc.open_file(system.open_input_file(path))
        self.length, self.rows = (int(self.file.schema.metadata[k]) for k in (b"length", b"rows"))

    def _batch(self, k: int) -> pa.RecordBatch:
        return self.file.get_batch(k)

    def sequence(self, k: int) -> np.ndarray:
        """The ids of sequence ``k``, padding included."""
        at = k % self.rows
        return self._batch(k // self.rows).column(0).values.to_numpy(zero_copy_only=True)[at * self.length : (at + 1) * self.length]

    def mask(self, k: int) -> pa.BooleanArray:
        """Which ids of sequence ``k`` are a document's."""
        return self._batch(k // self.rows).column(1).values.slice(k % self.rows * self.length, self.length)

    def batches(self) -> Iterator[np.ndarray]:
        """The ids of each batch in a row, without padding."""
        for k in range(self.file.num_record_batches):
            batch = self._batch(k)
            yield batch.column(0).values.to_numpy(zero_copy_only=True)[: batch.column(1).values.true_count]

    def documents(self, counts: list[int]) -> Iterator[list[np.ndarray]]:
        """The stretches of ids of each document, given how many it has."""
        left = iter(self.batches())
        now = np.zeros(0, np.uint16)
        for n in counts:
            parts = []
            while n > len(now):
                parts.append(now)
                n -= len(now)
                if (now := next(left, None)) is None:
                    raise ValueError("the index has more ids than the file")
            parts.append(now[:n])
            now = now[n:]
            yield parts


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder or file of the shared store; local files are mapped."""
    system, path = pa.fs.FileSystem.from_uri(uri)
    return (pa.fs.LocalFileSystem(use_mmap=True) if isinstance(system, pa.fs.LocalFileSystem) else system), path


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_sequences(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, rows: int = ROWS, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns their manifest (number, file, documents, tokens), a written table."""
    spark = docs.sparkSession
    common.ship(spark)
    common.short_batches(spark)
    folder = f"{common.own_dir(spark)}/sequences-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                own = encoder(path, pattern)
                number = TaskContext.get().partitionId()
                system, at = file_system(folder)
                system.create_dir(at, recursive=True)
                name = f"part-{number:06d}-{uuid.uuid4().hex}"
                sinks = [system.open_output_stream(f"{at}/{name}{end}.arrow") for end in ("", ".index")]
                writer, index, start, documents = SequenceWriter(sinks[0], length, rows, own.dtype), pa.ipc.new_file(sinks[1], _INDEX), 0, 0
            made = own.encode([t or "" for t in batch.column(1).to_pylist()])
            counts = np.array([len(x) + 1 for x in made], np.int64)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(start + counts.cumsum() - counts), pa.array(counts)], schema=_INDEX))
            start, documents = start + int(counts.sum()), documents + len(made)
            end = np.array([end_id], own.dtype)
            for ids in made:
                writer.add(ids)
                writer.add(end)
        if writer is not None:
            for x in (writer, index, *sinks):
                x.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "file": [f"{folder}/{name}"], "documents": [documents], "tokens": [start]}, schema=pa.schema([("number", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    keyed = docs.select(F.col(key).cast("long").alias("key"), common.whole_text(text).alias("text"))
    keyed = keyed.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["key", "mark", "row"]  # a key of very many rows is spread too
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return common.stash(spread.mapInArrow(run, "number long, file string, documents long, tokens long"), "sequence-files")


def read_documents(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files; start
    counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before, tokens in zip(*(batch.column(c).to_pylist() for c in ("file", "before", "tokens")), strict=True):
                data = SequenceFile(f"{name}.arrow")
                system, at = file_system(f"{name}.index.arrow")
                index = pa.ipc.open_file(system.open_input_file(at))
                listed = [index.get_batch(k) for k in range(index.num_record_batches)]
                counts = [n for b in listed for n in b.column(2).to_pylist()]
                if sum(counts) != tokens or sum(map(len, data.batches())) != tokens:
                    raise ValueError(f"{name} doesn't hold the ids that its manifest has")
                stretches = data.documents(counts)
                for b in listed:
                    sums = []
                    for _, parts in zip(range(b.num_rows), stretches, strict=False):
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.astype("<u4"), crc)
                        sums.append(crc)
                    start = pa.array(b.column(1).to_numpy() + before)
                    yield pa.RecordBatch.from_arrays([b.column(0), start, b.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file: the sums over all of them are a small window.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("number", "file", "tokens", before.alias("before"))
    return files.repartition(tasks or manifest.sparkSession.sparkContext.defaultParallelism * 3, "number").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(write_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
