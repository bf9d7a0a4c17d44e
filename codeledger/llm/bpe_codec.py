"""Byte-level BPE encoding and decoding by merge replay over the corpus.

1. One pass over all documents counts the distinct pieces of the corpus (counted in each task
   first).  Pieces that are a token as a whole have that token's id, as the library has it.
2. The pieces that the corpus repeats most, at most ``HOT_PIECES`` by a threshold on their
   counts, are replayed once for the whole corpus: all pieces of a partition are laid out on
   one tape, an inverted index maps each rank to the positions where its token pair stands,
   and the ranks are replayed in order, each at all its places at once; only the touched
   neighbours are looked up anew.  The encoded pieces are a table in the shared folder.
3. A second pass encodes the documents.  Tasks hold the table of step 2 and replay the other,
   rare pieces in blocks of ``BLOCK_CHARS`` characters of the corpus, with the same index.

Pieces never influence one another, so a piece has the same ids wherever it is replayed: the
bound on step 2 decides what is replayed once, never a result.

Where a merge makes a pair of *lower* rank than the one being replayed, the rest of that piece
waits until the lower pair is done, so the result is exactly that of greedy merging.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are
encoded again; an empty table gives an empty result; columns of ``docs`` that have the name of
an added column are replaced by it, all others are kept.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pieces replayed once for the corpus, at most; about 20 MB in the driver and in a worker.
HOT_PIECES = 150_000
#: Encoded pieces that a worker remembers besides; when it is full, it starts anew.
CACHE_PIECES = 200_000
#: Characters of the texts of one block of the replay (a longer text is a block of its own).
BLOCK_CHARS = 6_000_000
#: Distinct pieces that a task counts before it hands them on.
COUNT_PIECES = 200_000
_SHIFT = 20
_NONE = np.int32(2**31 - 1)


def splitter(pattern: str):
    """``text -> pieces``.  Texts of Latin-1 characters only go through the standard library's
    expressions, which are faster; the classes of the pattern are spelled out for them."""
    general = regex.compile(pattern).findall
    chars = [chr(i) for i in range(256)]
    spelled = {c: "".join(f"\\x{ord(x):02x}" for x in chars if regex.match(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    inside = lambda found: "[" + re.sub(r"\\p\{[LN]\}|\\s", lambda m: spelled[m[0]], found[0][1:-1]) + "]"
    narrow = re.sub(r"\[[^\]]*\]", inside, pattern)
    narrow = re.sub(r"\\p\{[LN]\}|\\s", lambda m: f"[{spelled[m[0]]}]", narrow).replace(r"\S", f"[^{spelled[chr(92) + 's']}]")
    if re.search(r"\\[pPX]", narrow):  # a class that isn't spelled out
        return general
    latin = re.compile(narrow).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text)

    return split


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each stretch, one stretch behind the other."""
    ends = many.cumsum(dtype=np.int64)
    return np.repeat(first - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)


class MergeReplay:
    """Encodes and decodes with the ranks of one file."""

    def __init__(self, path: str, pattern: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token = {r: t for t, r in self.rank.items()}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        rank, found = self.rank.get, {}
        for whole, r in self.rank.items():
            for cut in range(1, len(whole)):
                if (a := rank(whole[:cut])) is not None and (b := rank(whole[cut:])) is not None:
                    found[a << _SHIFT | b] = r
        #: Every token pair that merges, sorted, and the token it makes.
        self.pair_keys = np.array(sorted(found), np.int64)
        self.pair_made = np.array([found[k] for k in self.pair_keys.tolist()], np.int32)
        self.split = splitter(pattern)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of tokens side by side, _NONE where they don't merge (or one is -1)."""
        asked = (a.astype(np.int64) << _SHIFT) | b
        asked[(a < 0) | (b < 0)] = -1
        at = self.pair_keys.searchsorted(asked)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == asked, self.pair_made[at], _NONE)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has, by one replay over all of them."""
        rank = self.rank.get
        whole = np.array([rank(p, -1) for p in pieces], np.int32)
        counts = (whole >= 0).astype(np.int64)
        todo = np.array([n for n in np.flatnonzero(whole < 0).tolist() if pieces[n]], np.int64)
        if not len(todo):
            return whole[whole >= 0], counts
        tape, last = self._replayed(b"".join([pieces[n] for n in todo.tolist()]), np.array([len(pieces[n]) for n in todo.tolist()]))
        alive = np.flatnonzero(tape >= 0)
        ends = np.searchsorted(alive, last, side="right")
        counts[todo] = np.diff(ends, prepend=0)
        ids = np.empty(int(counts.sum()), np.int32)
        begins = counts.cumsum() - counts
        ids[begins[whole >= 0]] = whole[whole >= 0]
        ids[spread(begins[todo], counts[todo])] = tape[alive]
        return ids, counts

    def listed(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        ids, counts = self.replay(pieces)
        return [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])] if pieces else []

    def _replayed(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tape after all merges (-1 where a symbol went into its left neighbour), and the
        position of each piece's last byte.  Slot n of every array stands for "no neighbour"."""
        n = len(data)
        last = sizes.cumsum() - 1
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        tape = np.append(self.byte_id[np.frombuffer(data, np.uint8)], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[last], before[last - sizes + 1] = n, n
        here = np.append(self.merged(tape[:n], tape[after[:n]]), _NONE)  # rank of the pair that begins at each place
        order = np.argsort(here[:n], kind="stable")
        order = order[: np.searchsorted(here[order], _NONE)]
        ranks, begins = np.unique(here[order], return_index=True)
        first = dict(zip(ranks.tolist(), np.split(order, begins[1:]), strict=True)) if len(ranks) else {}
        later: dict[int, list[int]] = {}
        heap = list(first)
        heapify(heap)

        def post(places: np.ndarray, of: np.ndarray) -> None:
            for i, r in zip(places.tolist(), of.tolist(), strict=True):
                if (known := later.get(r)) is not None:
                    known.append(i)
                else:
                    later[r] = [i]
                    if r not in first:
                        heappush(heap, r)

        while heap:
            r = heappop(heap)
            old, new = first.pop(r, None), later.pop(r, None)
            if new:
                every = np.array(new) if old is None else np.concatenate([old, new])
                every.sort()
            else:
                every = old
            every = every[here[every] == r]
            if not len(every):
                continue
            if len(every) > 1:
                every = every[np.append(True, every[1:] != every[:-1])]
            pos, near = every, after[every]
            chained = near[:-1] == pos[1:]
            if chained.any():  # of places that overlap, every second one, from the left
                start = np.append(True, ~chained)
                step = np.arange(len(pos))
                pos = pos[(step - np.maximum.accumulate(np.where(start, step, 0))) % 2 == 0]
                near = after[pos]
            far, left = after[near], before[pos]
            m = len(pos)
            made = self.merged(np.concatenate([np.full(m, r, np.int32), tape[left]]), np.concatenate([tape[far], np.full(m, r, np.int32)]))
            lower = (made[:m] < r) | (made[m:] < r)
            touching = np.append(False, far[:-1] == pos[1:])  # the place before has just been merged too
            twin = _NONE
            if touching.any():
                twin = self.merged(np.array([r], np.int32), np.array([r], np.int32))[0]
                lower |= touching & (twin < r)
            if lower.any():
                # In pieces where a lower pair would arise, only the first place is merged now.
                held = np.isin(word[pos], word[pos[lower]])
                keep = ~held | np.append(True, word[pos[1:]] != word[pos[:-1]])
                rest = every[np.isin(word[every], word[pos[lower]])]
                rest = rest[~np.isin(rest, pos[keep])]
                pos, near, far, left = pos[keep], near[keep], far[keep], left[keep]
                post(rest, np.full(len(rest), r))
            tape[pos], tape[near], here[near] = r, -1, _NONE
            after[pos], before[far] = far, pos
            touched = np.concatenate([pos, left[left < n]])
            fresh = self.merged(tape[touched], tape[after[touched]])
            here[touched] = fresh
            some = fresh < _NONE
            post(touched[some], fresh[some])
        return tape[:n], last

    def encode(self, text: str) -> list[int]:
        return self.replay([p.encode() for p in self.split(text)])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(path, pattern)


#: Encoded pieces: the pieces, their ids in a row, how many each has.
Encoded = tuple[list[str], np.ndarray, np.ndarray]


class Memory(dict):
    """Piece -> its place among the encoded pieces: their ids in one row, and for each its ids as
    text and the bytes decoded from them.  A piece that is met for the first time gets the next
    place, and its ids with the block's other new pieces by ``settle``."""

    def __init__(self, own: MergeReplay, hot: Encoded):
        super().__init__()
        self.own, self.hot = own, hot
        self.new: list[str] = []
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.text: list[bytes] = []
        self.back: list[bytes] = []
        self.ids, self.many = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.update(zip(self.hot[0], range(len(self.hot[0])), strict=True))
        self.add(self.hot[1], self.hot[2])

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        flat, at = ids.tolist(), 0
        for n in counts.tolist():
            mine = flat[at : at + n]
            self.text.append(" ".join(map(str, mine)).encode())
            self.back.append(self.own.decode(mine))
            at += n
        self.ids, self.many = np.concatenate([self.ids, ids]), np.concatenate([self.many, counts.astype(np.int32)])
        self.first = self.many.cumsum(dtype=np.int64) - self.many

    def settle(self) -> None:
        if self.new:
            self.add(*self.own.replay([p.encode() for p in self.new]))
            self.new = []

    def trim(self) -> None:
        """Forget all but the corpus-wide table, once there is too much else."""
        if len(self) > len(self.hot[0]) + CACHE_PIECES:
            self.begin()

    def digests(self, places: np.ndarray) -> tuple[int, str, str]:
        at = places.tolist()
        ids = hashlib.sha256(b" ".join(map(self.text.__getitem__, at))).hexdigest()
        return int(self.many[places].sum()), ids, hashlib.sha256(b"".join(map(self.back.__getitem__, at))).hexdigest()

    def all_ids(self, places: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.first[places], self.many[places])]


def piece_counts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(piece, n): how often each piece that isn't a token as a whole stands in the corpus."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = codec(path, pattern), Counter()

        def handed() -> pa.RecordBatch:
            rows = [(p, c) for p, c in seen.items() if p.encode() not in own.rank]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["piece", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(own.split(t or ""))
                if len(seen) > COUNT_PIECES:
                    yield handed()
        yield handed()

    return docs.select(text).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def replayed(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """(piece, ids) for each row of ``pieces``, by one replay over each partition."""
    common.ship(pieces.sparkSession)
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition of the corpus-wide table: HOT_PIECES rows in all partitions together.
        rows = [p for b in batches for p in b.column(0).to_pylist()]
        ids = codec(path, pattern).listed([p.encode() for p in rows])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["piece", "ids"])

    return pieces.select("piece").mapInArrow(run, schema)


def corpus_table(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(piece, ids): the most frequent pieces of the corpus, HOT_PIECES at most, encoded once
    and kept in the shared folder.  All pieces of a count are in or out."""
    counted = common.stash(piece_counts(docs, path, pattern, text).filter("n > 1"), "bpe-counts")
    # How many pieces there are for each size of the count: as many rows as a number has bits.
    sizes = counted.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("pieces")).orderBy(F.desc("size")).collect()
    least, total = None, 0
    for row in sizes:
        total += row.pieces
        if total > HOT_PIECES:
            break
        least = row.size
    hot = counted.filter(F.floor(F.log2("n") * 8) >= (least if least is not None else 1 << 30))
    table = common.stash(replayed(hot, path, pattern), "bpe-pieces")
    common.release(counted)
    return table


def _coded(docs: DataFrame, path: str, pattern: str, text: str, digests: bool, ids: str | None) -> DataFrame:
    """``docs`` with the digests of every text, and its ids in the column ``ids`` if that is named."""
    spark = docs.sparkSession
    common.ship(spark)
    common.short_batches(spark)
    table = corpus_table(docs, path, pattern, text)
    rows = table.collect()  # HOT_PIECES rows at most
    hot = spark.sparkContext.broadcast(([r.piece for r in rows], np.array([i for r in rows for i in r.ids], np.int32), np.array([len(r.ids) for r in rows], np.int32)))
    common.release(table)
    fields = [*(_DIGESTS if digests else ()), *([T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else ())]
    added = {f.name for f in fields}
    kept = [c for c in docs.columns if c not in added]
    source = docs.select(*kept, docs[text].alias("__cl_text"))
    names = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(codec(path, pattern), hot.value)
        block: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        chars = 0

        def done() -> Iterator[pa.RecordBatch]:
            memory.settle()
            for batch, coded in block:
                made = []
                if digests:
                    told = [memory.digests(places) for places in coded]
                    made += [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                if ids:
                    ends = np.cumsum([0, *(int(memory.many[places].sum()) for places in coded)])
                    values = memory.all_ids(np.concatenate(coded)) if coded else np.zeros(0, np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)
            block.clear()
            memory.trim()

        split, place = memory.own.split, memory.__getitem__
        for batch in batches:
            coded = []
            for t in batch.column(len(kept)).to_pylist():
                pieces = split(t or "")
                coded.append(np.fromiter(map(place, pieces), np.int32, len(pieces)))
                chars += len(t or "")
            block.append((batch, coded))
            if chars >= BLOCK_CHARS:
                yield from done()
                chars = 0
        yield from done()

    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *fields]))


def encode_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of every text in ``out`` (array<int>)."""
    return _coded(docs, path, pattern, text, False, out)


def decode_ids(rows: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for, as binary (null ids: no bytes)."""
    common.ship(rows.sparkSession)
    at, kept = rows.columns.index(ids), [c for c in rows.columns if c != out]
    places = [rows.columns.index(c) for c in kept]
    names = [*kept, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            made = pa.array([own.decode(x or []) for x in b.column(at).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(p) for p in places), made], names=names)

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField(out, T.BinaryType())]))


_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def round_trip_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and the ids themselves in the
    column ``ids`` if that is named."""
    return _coded(docs, path, pattern, text, True, ids)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip_digests(docs, path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
