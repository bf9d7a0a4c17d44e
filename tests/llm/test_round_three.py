"""Lexical search, token files and the repair of conversations against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeledger.llm import conversations, lexical_search, token_files

JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string"


# --- ranked lexical search -----------------------------------------------------------------


def ranked(docs, items, k=10):
    """Every document scored for every item."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, ws) for i, ws in own if ws]
    n, length = len(own), sum(len(ws) for _, ws in own)
    df = Counter(w for _, ws in own for w in set(ws))
    out = []
    for item, text in items:
        rows = []
        for i, ws in own:
            m, tf = 10 + 90 * len(ws) * n // length, Counter(ws)
            score = sum(lexical_search.weight(n, df[t]) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*enumerate(texts), (7, texts[3]), (None, texts[3]), (n, None), (n + 1, ""), (n + 2, "!? .."), (n + 3, "W1 w1,É日w2"), (n + 4, "w1 " * 20_000)]


@pytest.mark.parametrize("segment", [7, 16_384])
def test_search_equals_a_full_ranking(spark, monkeypatch, segment):
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)
    rng = random.Random(3)
    docs = corpus(rng, 150)
    items = [(k, " ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 25)))) for k in range(12)] + [(3, "w1 w2"), (None, "é日w2 w1"), (90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 w1")]
    clash = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("key", "size", "terms", "tfs", "score", "rank", "item_id", "query")}).repartition(3)
    got = lexical_search.search(clash, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)
    assert lexical_search.search(clash.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical_search.search(clash, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_wand_passes_over_documents_and_loses_none():
    rng = np.random.default_rng(1)
    n = 20_000
    parts = [(t, np.flatnonzero(rng.random(n) < share)) for t, share in enumerate([0.5, 0.3, 0.02, 0.001])]
    doc, term = np.concatenate([d for _, d in parts]), np.concatenate([np.full(len(d), t) for t, d in parts])
    impact = np.array([10, 30, 500, 9_000])[term] + rng.integers(0, 9, len(term))
    segment, heap = lexical_search.Segment(n, doc, term, impact), []
    scored = segment.wand(np.arange(5), list(range(0, -n, -1)), heap, 10)
    whole = np.bincount(doc, weights=impact, minlength=n)
    want = sorted(((int(s), -i) for i, s in enumerate(whole)), reverse=True)[:10]
    assert sorted(heap, reverse=True) == want and scored < n / 2


def test_any_order_of_shards_gives_the_same_ties(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(60)] + [(i, "other text") for i in range(60, 80)], DOCS)
    item = spark.createDataFrame([(1, "here words")], "item_id long, text string")
    for parts in (1, 9):
        got = lexical_search.search(docs.repartition(parts, F.rand(parts)), item)
        assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(10))


# --- token files ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_words_are_encoded_as_texts_are(tokenizer, monkeypatch):
    own = token_files.WordEncoder(JSON, PATTERN)
    rng = random.Random(5)
    bits = ["a", "b ", " ", "  ", "\n", "\t", "1", "don't", " ", "é", "<|endoftext|>", ". ", "\x1c", "\x85", "日", "'s", "　", " the", "hello"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(1_500)] + ["x" * 5_000, " " * 300, ""]
    for size in (10**9, 50):
        monkeypatch.setattr(token_files, "CACHE_WORDS", size)
        for k in range(0, len(texts), 100):
            for t, ids in zip(texts[k : k + 100], own.encode(texts[k : k + 100]), strict=True):
                assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def brute_files(docs, tokenizer):
    start, out = 0, []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize(("length", "rows"), [(8, 2), (2_048, 64)])
def test_files_give_every_document_back(spark, tokenizer, length, rows):
    rng = random.Random(7)
    texts = [" ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(40))) for _ in range(80)] + [None, "", " ", "a" * 30_000, "日本 語 " * 400]
    docs = [*enumerate(texts)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("start", "n_tokens", "key", "mark", "row", "number", "file")}).repartition(5)
    manifest = token_files.write_sequences(df, JSON, PATTERN, length=length, rows=rows)
    got = token_files.read_documents(manifest)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == brute_files(sorted(docs), tokenizer)
    assert token_files.read_documents(token_files.write_sequences(df.limit(0), JSON, PATTERN)).count() == 0


def test_sequences_are_views_of_equal_length_with_masks(spark, tokenizer):
    docs = spark.createDataFrame([(k, f"some words {k} " * (k + 1)) for k in range(30)], DOCS)
    manifest = token_files.write_sequences(docs, JSON, PATTERN, length=16, rows=4).orderBy("number").collect()
    tape = []
    for m in manifest:
        file = token_files.SequenceFile(f"{m.file}.arrow")
        n = -(-m.tokens // 16)
        for k in rng_order(n):
            assert len(file.sequence(k)) == len(file.mask(k)) == 16 and not file.sequence(k).flags.owndata
            assert file.mask(k).true_count == min(16, m.tokens - 16 * k)
        tape += [i for k in range(n) for i, on in zip(file.sequence(k).tolist(), file.mask(k).to_pylist(), strict=True) if on]
    assert tape == [i for k in range(30) for i in [*tokenizer.encode(f"some words {k} " * (k + 1), add_special_tokens=False).ids, 0]]


def rng_order(n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    return order


def test_odd_keys_of_documents(spark, tokenizer):
    rows = [(None, "b"), (None, "b"), (4, "x y"), (4, "x y"), (4, None), (2, "z")]
    got = token_files.read_documents(token_files.write_sequences(spark.createDataFrame(rows, DOCS), JSON, PATTERN)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 2, 4, 4, 4] and sorted(r.n_tokens for r in got) == [1, 2, 2, 2, 3, 3]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(6)]


# --- conversations -------------------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """The cheapest edits by trying all, shortest paths over (row, state), whole audits compared."""
    best = {(0, ""): (0, "", [])}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for state in ("", "s", "u", "a"):
                if (i, state) in best:
                    cost, audit, out = best[i, state]
                    for r in "ua":
                        if r in after[state] and (new := (cost + 5, audit + "I", [*out, f"{name[r]}:"])) < best.get((i, r), (10**9,)):
                            best[i, r] = new
        if i == len(rows):
            break
        role, text, must, late = rows[i]
        for state in ("", "s", "u", "a"):
            if (i, state) not in best:
                continue
            cost, audit, out = best[i, state]
            options = [(state, (cost + 2, audit + "D", out))]
            if not must:
                for r, to in after[state].items():
                    if role[:1] == r:
                        options.append((to, (cost + late, audit + "K", [*out, f"{role}:{text}"])))
                    elif r in name:
                        options.append((to, (cost + late + 1, audit + "R", [*out, f"{name[r]}:{text}"])))
            for to, new in options:
                if new < best.get((i + 1, to), (10**9,)):
                    best[i + 1, to] = new
    return min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, counts = set(), [], Counter()
    for _, role, text in rows:
        last = text.strip(SPACES)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), 5 * (fault == "truncated")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = cheapest(marked)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [] if h == 0 else [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


ROWS = "conv_id long, turn long, role string, text string"


def conversations_of(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "usher", "", None])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, rng.choice(["Yes.", "No", "What? ", " \n", "", None, "same.", "same.", f"text {t}!", "\x1f", "é"])))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (500, None, None, None), (501, 2, "user", "one."), (501, 2, "user", "one.")]


@pytest.mark.parametrize("block", [3, 128])
def test_repair_equals_trying_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    rows = conversations_of(rng, 120)
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("key", "pos", "gone", "seen", "rows", "best", "cost", "audit", "blank")}).repartition(4)
    got = conversations.repair(conversations.damage(df))
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashlib.sha256("\n".join(r.repaired).encode()).hexdigest()) for r in got.collect()}
    left = brute_damage(rows)
    assert found.keys() == {r[0] for r in rows}
    for c in found:
        assert found[c] == brute_repair([r[1:] for r in left if r[0] == c]), c
    assert {c for f in found.values() for c in f[6]} == {"K", "R", "D"}  # at these costs an insert is never the cheapest
    whole = {r.conv_id: (r.cost, r.audit) for r in conversations.repair(df).collect()}  # without damage
    blank = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert all(whole[c] == brute_repair([r[1:] for r in blank if r[0] == c])[5:7] for c in whole)
    assert conversations.repair(df.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{t}" + rng.choice([".", ""])) for t in range(3_000)]
    got = conversations.repair(spark.createDataFrame(rows, ROWS)).first()
    assert (got.cost, got.audit) == brute_repair([r[1:] for r in rows])[5:7]
