"""The corpus operators against brute force, on small tables with nulls, ties and long texts."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from tokenizers import Tokenizer

from codeledger.llm import bpe_codec, decontam, graph, media, native_spans, pii, quality, secrets, simhash, token_count, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", None, None, "x", "y") for i, t in enumerate(texts)], DOCS)


ODD = [
    None, "", " ", "a", "Hello world", "Hello world", "don't stop   now\n\n\n x", "日本語 text ñandú", "a" * 3000, "<|endoftext|>mid<|endoftext|> end",
    " " * 500 + "x", "0123456789" * 50, "é" * 700, "tab\tand\x0bvt\x0cff\r\nend", "aaa bbb ccc ddd " * 200,
]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(token_count.count_tokens(frame(spark, ODD).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
    for i, t in enumerate(ODD):
        assert got[i].n_tokens == len(tok.encode(t or "", add_special_tokens=False).ids), t
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 1024)
    clash = token_count.count_tokens(frame(spark, ODD), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert clash.columns.count("n_tokens") == 1 and by_id(clash)[4].n_tokens == got[4].n_tokens
    assert token_count.count_tokens(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library_and_returns_the_bytes(spark, encoding):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = frame(spark, ODD).select("doc_id", "text")
    got = by_id(bpe_codec.round_trip_digests(docs, path, public_tokenizers.PATTERN))
    for i, t in enumerate(ODD):
        ids = encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe_codec.decode_ids(bpe_codec.encode_ids(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}


def test_replay_on_random_bytes(encoding):
    codec = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabcdethe  .é\n1") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["".join(chr(rng.choice((rng.randrange(9, 600), rng.randrange(97, 123), 32))) for _ in range(rng.randrange(80))) for _ in range(300)]
    for t in texts:
        assert codec.split(t) == regex.findall(public_tokenizers.PATTERN, t)
        assert codec.encode(t) == encoding.encode_ordinary(t)
    pieces = [p for t in texts for p in codec.split(t)]  # all on one tape
    pieces += ["", " the", "", "a"]
    assert codec.listed([p.encode() for p in pieces]) == [encoding.encode_ordinary(p) for p in pieces]
    assert codec.listed([]) == [] and codec.listed([b"", b""]) == [[], []]


def test_codec_with_a_corpus_table_and_small_blocks(spark, encoding, monkeypatch):
    monkeypatch.setattr(bpe_codec, "HOT_PIECES", 40)
    rng = random.Random(12)
    texts = [text_of(rng, rng.randrange(40)) for _ in range(60)] * 2 + [None, ""]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = frame(spark, texts)
    table = bpe_codec.corpus_table(docs, path, public_tokenizers.PATTERN).collect()
    assert 0 < len(table) <= 40 and all(r.ids == encoding.encode_ordinary(r.piece) for r in table)
    got = bpe_codec.round_trip_digests(docs, path, public_tokenizers.PATTERN, ids="ids")
    assert sorted(got.columns) == sorted([*docs.columns, "ids_sha256", "decoded_sha256", "ids"])  # n_tokens is replaced
    for r in got.collect():
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
    empty = docs.limit(0)
    assert bpe_codec.round_trip_digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_codec_memory_starts_anew_when_full(encoding, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_PIECES", 5)
    own = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    hot = encoding.encode_ordinary(" hot")
    memory = bpe_codec.Memory(own, ([" hot"], np.array(hot, np.int32), np.array([len(hot)])))
    for t in ["one two three four five six", "one seven hot", "two two", ""] * 2:
        places = np.array([memory[p] for p in own.split(t)], np.int32)
        memory.settle()
        assert memory.all_ids(places).tolist() == encoding.encode_ordinary(t)
        assert memory.digests(places)[2] == hashlib.sha256(t.encode()).hexdigest()
        memory.trim()


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_fingerprints(spark):
    got = by_id(simhash.with_fingerprints(frame(spark, ODD)))
    for i, t in enumerate(ODD):
        assert got[i][simhash.FINGERPRINT] % (1 << 64) == brute_fingerprint(t)


@pytest.mark.parametrize("bucket", [32, 2])
def test_components_by_pivots_and_by_shared_neighbours(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.append(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    expected = brute_components(dict(enumerate(prints)))
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], f"doc_id long, {simhash.FINGERPRINT} long")
    assert {r.doc_id: r.component_id for r in simhash.with_components(rows).collect()} == expected


def test_components_of_a_long_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "u long, v long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    copy = "one two three four five six seven"
    docs = frame(spark, [None, copy, copy.upper(), "", "something else entirely here now", copy])
    got = simhash.first_of_each(docs.unionByName(docs))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 4]


def text_of(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "mi", "tu", "re", "la"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.mark.parametrize("words", [20_000, 30])
def test_contaminated_documents_are_found(spark, monkeypatch, words):
    rng = random.Random(5)
    items = [text_of(rng, n) for n in (30, 45, 60, 12, 30)]
    para = items[0].split()
    for k in range(3, 30, 9):
        para[k] = "changed"
    docs = [text_of(rng, 200) for _ in range(20)]
    docs[3] = f"{text_of(rng, 80)} {items[1].upper()} {text_of(rng, 50)}"
    docs[7] = items[2]
    docs[9] = f"{text_of(rng, 33)}. {' '.join(para)}, {text_of(rng, 33)}"
    docs[11] = f"{items[3]} {text_of(rng, 300)} {items[4]}"
    docs += [None, ""]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (20, items[1]), (None, items[2])], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 2)
    got = {(r.doc_id, r.item_id) for r in decontam.hits(frame(spark, docs), bench).collect()}
    assert got == {(3, 1), (3, 20), (7, 2), (7, None), (9, 0), (11, 3), (11, 4)}
    kept = decontam.drop_contaminated(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns and kept.count() == len(docs) - 4
    assert decontam.drop_contaminated(frame(spark, docs), bench.limit(0)).count() == len(docs)
    assert decontam.drop_contaminated(frame(spark, docs).limit(0), bench).count() == 0
    assert decontam.hits(frame(spark, docs).limit(0), bench).count() == decontam.hits(frame(spark, docs), bench.limit(0)).count() == 0


def test_paraphrases_are_found_by_the_latent_search(spark):
    """Planted paraphrases that pass the checks by themselves, against an exhaustive search; the
    singular vectors decide: with a random basis of the same rank next to none is found."""
    rng = random.Random(11)
    items = [text_of(rng, n) for n in (15, 20, 27, 38, 48, 59)]
    docs = [text_of(rng, 120) for _ in range(60)]
    numbered, _ = decontam.items_of(spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    ((f,),) = decontam.passes(frame(spark, docs), numbered)
    planted = []
    for trial in range(1200):
        k, rate, at = rng.randrange(len(items)), rng.choice((0.25, 0.3, 0.35, 0.4)), rng.randrange(121)
        words = [w if rng.random() >= rate else rng.choice((f"zq{trial}", text_of(rng, 1))) for w in f.bench.words[k]]
        host = rng.choice(docs).split()
        # What is planted passes by itself, not with chance words of the host.
        codes, _ = decontam._coded([" ".join(words)], f.bench.vocab)
        if f.verify(codes, k, [0]):
            planted.append((" ".join([*host[:at], *words, *host[at:]]), k))
    assert len(planted) > 500
    found = lambda finder: sum(k in dict(got) for (_, k), got in zip(planted, finder.find([t for t, _ in planted]), strict=True)) / len(planted)
    assert found(f) >= 0.98


def test_the_singular_vectors_decide():
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    bench = decontam.Benchmark([(k, " ".join(word() for _ in range(40))) for k in range(40)])
    weight = np.full(len(bench.vocab), 25.0)
    a = np.zeros((len(bench.passages), len(bench.vocab)))
    for r, (_, codes) in enumerate(bench.passages):
        at, count = np.unique(codes, return_counts=True)
        a[r, at] = count / np.linalg.norm(count)
    fitted = decontam.singular_vectors(a.T @ (a @ decontam._gaussian(len(bench.vocab))))
    judge, texts, items = decontam.Finder(bench, weight, fitted), [], []
    for k in [*range(40)] * 3:
        ws = [w if rng.random() > 0.3 else word() for w in bench.words[k]]
        if judge.verify(decontam._coded([" ".join(ws)], bench.vocab)[0], k, [0]):
            texts.append(" ".join([*(word() for _ in range(rng.randrange(60))), *ws, *(word() for _ in range(30))]))
            items.append(k)
    assert len(items) > 60
    recall = lambda basis: sum(k in dict(got) for k, got in zip(items, decontam.Finder(bench, weight, basis).find(texts), strict=True)) / len(items)
    chance, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(bench.vocab), 160)))
    assert recall(fitted[:, :160]) >= 0.9 and recall(chance) <= 0.2


def test_a_very_long_text_that_repeats_an_item(spark):
    rng = random.Random(19)
    item = text_of(rng, 59)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = " ".join([item] * 4_000)
    got = decontam.hits(frame(spark, [text, text_of(rng, 50)]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 1)]


def test_words_of_a_text():
    rng = random.Random(13)
    for top in (256, 700):
        for _ in range(300):
            t = "".join(chr(rng.choice((rng.randrange(top), 32, rng.randrange(65, 123)))) for _ in range(60))
            assert decontam.words_of(t) == [w for w in ("".join(re.findall(r"[^\W_]+", x)) for x in t.lower().split()) if w]


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(a, b) == table[-1][-1]


def test_native_spans_of_very_many_matches(spark):
    text = "x1" * 700 + "é22 " * 5
    df = spark.createDataFrame([(text,), ("",), ("none",)], "t string")
    got = native_spans.with_spans(df, "t", {"s": ("[0-9]+", native_spans.F.lit(True))}).collect()
    assert [(s.start, s.end, s.hit) for s in got[0].s] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert got[1].s == got[2].s == []


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


SECRETS = [
    None, "", "Password = 'hunter22'", "password=token:abcdefgh", "api_key:abcdef apikey = \"abc\" TOKEN=xyzxyz", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "AKIAAKIA" + "Z" * 16,
    "é" * 5 + "secret=0123456789abcdef0123456789abcdef", "deadbeef" * 3 + "g" + "deadbeef" * 2, "passwd:  =abcdef", "tokens = 5; token='a.b-c/d+e='", "secret=abcdefg " * 400,
]


def test_secrets_equal_brute_force(spark):
    got = by_id(secrets.scan(frame(spark, SECRETS)))
    for i, t in enumerate(SECRETS):
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[i]["__cl_found"] if s.kind in secrets.BASE) == brute_secrets(t), t
    kept = by_id(secrets.redact(frame(spark, [*SECRETS, "clean"])))
    assert kept[2].text == "[assign]'" and kept[13].text == "clean" and kept[0].text is None
    assert kept[13].n_chars is None and kept[2].n_chars == 9
    assert secrets.scan(frame(spark, SECRETS).limit(0)).count() == 0


def test_trigram_queries_hold_for_matches():
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("ab(cd|ef)?") is None
    assert {frozenset({"abc", "bcd"}), frozenset({"abe", "bef"})} == set(secrets.trigram_query("ab(cd|ef)"))
    assert secrets.trigram_query("colou?r") == sorted([frozenset({"col", "olo", "lor"}), frozenset({"col", "olo", "lou", "our"})], key=sorted)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    t, out = t or "", []
    out += [(0, m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), "card", m.end()))
    out += [(3, m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for _, a, k, b in sorted(out))


PII = [
    None, "", "mail a.b+c@d-e.co.uk.", "a@b.c_x@d.e", "a@b x@y.z", "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "x4111111111111111 5", "+44 (0)20 7946 0958 and +1-2", "+123456789012345678", "a" * 20000 + "@", "1 " * 4000, "é +49 30 123456 é", "5500 0000 0000 0004, 5500000000000004-1",
]


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(7)
    texts = PII + ["".join(rng.choice("0123456789.-+ @ab(") for _ in range(200)) for _ in range(60)]
    got = by_id(pii.find(frame(spark, texts)))
    for i, t in enumerate(texts):
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[i]["__cl_found"] if s.kind in pii.KINDS) == brute_pii(t), t
    assert pii.find(frame(spark, texts).limit(0)).count() == 0


def brute_terms(texts):
    """(text number, start, end) of the disclosing terms, entity by entity."""
    n, word = len(texts), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[^\W\d_]{4,}")
    entities = [{f"{k}:{t[int(a):int(b)]}" for k, a, b in (x.split(":") for x in brute_pii(t).split(",") if x)} for t in texts]
    places = [[(m.start(), m.end(), m[0].lower()) for m in word.finditer(t) if "@" not in m[0]] for t in texts]
    whole = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for t in texts]
    out = set()
    for e in set().union(*entities):
        rows = [i for i in range(n) if e in entities[i]]
        if len(rows) == n:
            continue
        for w in {w for i in rows for _, _, w in places[i]}:
            joint, alone = sum(any(x[2] == w for x in places[i]) for i in rows), sum(w in ws for ws in whole)
            if alone and math.log2(n * joint / (len(rows) * alone)) >= pii.ALPHA * math.log2(n / len(rows)) - 1e-9:
                out |= {(i, a, b) for i in rows for a, b, x in places[i] if x == w}
    return out


def test_terms_that_disclose_an_entity(spark):
    texts = [f"the manager Brunhilde writes from b@x.org about topic{i % 7}" for i in range(6)] + [f"the manager other{i} writes about topic" for i in range(30)]
    got = by_id(pii.find(frame(spark, texts)))
    terms = {texts[0][s.start : s.end] for s in got[0]["__cl_found"] if s.kind == "term"}
    assert terms == {"Brunhilde", "from"}  # in no document without that entity
    assert not got[20]["__cl_found"]
    clean = by_id(pii.sanitise(frame(spark, texts)))
    assert clean[0].text == "the manager [term] writes [term] [email] about topic0" and clean[20].text == texts[20]
    far = by_id(pii.find(frame(spark, ["Brunhilde says " + "filler " * 60 + "b@x.org", *["says filler text"] * 9])))
    assert [(s.kind, s.start) for s in far[0]["__cl_found"]] == [("email", 435), ("term", 0)]  # far from the value, and in one document


@pytest.mark.parametrize("few", [0, 20_000])
def test_terms_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW_TERMS", few)
    rng = random.Random(21)
    pool = [text_of(rng, 1) + "aaaa" for _ in range(40)]
    texts = []
    for i in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(4, 14))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["a@b.org", "fred@mail.example.com", "10.1.2.3", "+49 30 123456789", f"u{i}@one.net"])
            words.append(f"rare{'xyzuvw'[i % 6]}word")
        texts.append(" ".join(words))
    texts += texts[:9] + ["", "éabcd@x.org Wörd_x@y.zz a@b.coméxyz"]
    got = by_id(pii.find(frame(spark, texts)))
    assert {(i, s.start, s.end) for i in got for s in got[i]["__cl_found"] if s.kind == "term"} == brute_terms(texts) != set()


def test_personal_data_of_very_long_texts(spark):
    labels, many = "x@" + "a." * 100_000 + "a", "1.2.3.4 " * 60_000
    got = by_id(pii.find(frame(spark, [labels, many, None, "plain"])))
    assert [(s.kind, s.start, s.end) for s in got[0]["__cl_found"]] == [("email", 0, len(labels))]
    assert len(got[1]["__cl_found"]) == 60_000 and got[1]["__cl_found"][-1].end == len(many) - 1
    assert not got[2]["__cl_found"] and not got[3]["__cl_found"]


def test_urls(spark):
    urls = [
        None, "", "no-scheme", "http://A.NET/x", "https://m.example.net/en/5?q=1", "https://example.net/de", "http://example.com/de/1#x", "http://notexample.com/de/1", "ftp://www.org/fr/", "http://org/fr", "http://x.org?/fr/", "http://ÀÉ.net",
        "http://bad.io/p1", "http://bad.io/p2",
    ]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, None if i % 2 else 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(12)] == [
        (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"),
        ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert (got[0].host, got[0].path, got[3].host, got[3].path, got[4].path) == ("", "", "a.net", "/x", "/en/5")
    assert url_filter.judge(pages.limit(0), labels.limit(0)).count() == 0


def test_mined_url_rules(spark):
    rows = [(i, f"http://{'farm' if i % 3 == 0 else 'site'}.io/p{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 1 if i % 3 == 0 else 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i, _ in rows if i % 3 == 0}


def test_mined_rules_equal_counted_ones(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MIN_ROWS", 5)
    monkeypatch.setattr(url_filter, "MIN_SUPPORT", 0.02)
    rng = random.Random(15)
    rows = []
    for _ in range(250):
        tokens = {t for t in "abcdef" if rng.random() < 0.4} | {"z"}
        if "a" in tokens:
            tokens |= {"a1", "a2"}  # always together: one class
        rows.append((sorted(tokens), rng.random() < (0.9 if {"a", "b"} <= tokens else 0.8 if "f" in tokens else 0.1)))
    got = url_filter.mine(spark.createDataFrame(rows * 2, "tokens array<string>, bad boolean")).collect()
    seen = [({t for t in tokens if t not in ("a1", "a2")}, bad) for tokens, bad in rows * 2]
    held = {}
    for size in range(1, 8):
        for c in itertools.combinations("abcdefz", size):
            hits = [bad for tokens, bad in seen if set(c) <= tokens]
            if sum(hits) >= max(5, math.ceil(0.02 * len(seen))) and sum(hits) >= 0.6 * len(hits) and not any(set(s) < set(c) for s in held):
                held[c] = sum(hits) / len(hits)
    assert {tuple(r.tokens): pytest.approx(r.confidence) for r in got} == held and len(held) > 1
    assert all(r.anchor in r.tokens for r in got)
    assert url_filter.mine(spark.createDataFrame([], "tokens array<string>, bad boolean")).count() == 0


def test_media_round_trip(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ijkl\n") for _ in range(150_000))
    texts = [None, "", "x" * 63, "x" * 64, "é" * 40, long, long, long + " tail", "z" * 200_000]
    got = by_id(media.with_media(frame(spark, texts)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(padded)).hexdigest() and r.media_bytes == len(media.wav(padded))
        assert r.feature == brute_feature(padded)
    lists = [bytes(d) for r in media.chunk_lists(frame(spark, texts[5:8])).collect() for d in r.chunks]
    assert len(set(lists)) < len(lists) / 1.5  # a changed tail shares the other chunks
    store = media.store_of(media.chunks_of(frame(spark, [*texts, *texts]))).collect()
    assert len(store) == len({bytes(r.digest) for r in store})
    assert media.with_media(frame(spark, texts).limit(0)).count() == 0


def brute_feature(samples):
    mean = sum(samples) / len(samples)
    side = [x > mean for x in samples]
    spread = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
    levels = [sum(1 for x in samples if x // 32 == k) for k in range(8)]
    return f"n={len(samples)};mean={mean:.4f};sd={spread:.4f};zc={sum(a != b for a, b in zip(side, side[1:]))};hist=" + ".".join(map(str, levels))


def test_media_with_a_trained_dictionary(spark):
    rng = random.Random(14)
    texts = [text_of(rng, rng.randrange(200, 900)) for _ in range(300)] + [text_of(rng, 9000)]
    docs = frame(spark, [*texts, *texts[:50]])
    trained = media.dictionary(docs)
    assert len(trained) > 1000 and media.dictionary(docs.limit(0)) == b"" and media.dictionary(frame(spark, ["x"] * 2000)) == b""
    plain, small = (sum(len(r.bytes) for r in media.chunks_of(docs, trained=t).collect()) for t in (b"", trained))
    assert small < plain
    got = by_id(media.with_media(docs))
    assert all(got[i].payload_sha256 == hashlib.sha256(media.payload_of(t)[0]).hexdigest() for i, t in enumerate(texts))


def test_a_damaged_chunk_stops_the_run(spark):
    docs = frame(spark, ["some text"])
    store = media.store_of(media.chunks_of(docs)).withColumn("digest", media.F.unhex(media.F.lit("00" * 32)))
    with pytest.raises(Exception, match="doesn't match its digest"):
        media.rebuilt(media.chunk_lists(docs), store).collect()


def test_cuts_move_with_the_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 300_000, dtype=np.uint8).tobytes()
    a, b = ({hashlib.sha256(d[s:e]).digest() for s, e in zip([0, *media.cuts(d)], media.cuts(d), strict=False)} for d in (data, b"some more" + data))
    assert len(a & b) >= 0.9 * len(a) - 2
    for d in (data, b"", b"x" * 5000):
        ends = media.cuts(d)
        assert ends[-1] == len(d) and all(y - x <= media.MOST for x, y in zip([0, *ends], ends, strict=False))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        good = i % 4 != 0
        t = text_of(rng, rng.randrange(20, 90))
        rows.append(t if good else t.upper().replace(" ", "!! "))
    docs = frame(spark, [*rows, None, ""])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    stats = quality.with_statistics(docs)
    got = by_id(quality.score(stats, quality.fit(stats, labels)).withColumn("held", quality.held_out(quality.F.col("doc_id"))))
    for i in range(602):
        assert got[i].held == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
    held = [i for i in range(600) if got[i].held]
    assert sum((got[i]["score"] >= 0.7) == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    level = quality.fit(stats, labels.limit(0))
    assert level.level == 0.5 and quality.score(stats.limit(0), level).count() == 0


def test_ridge_is_that_of_all_rows(spark):
    rng = random.Random(16)
    docs = frame(spark, [text_of(rng, rng.randrange(5, 60)) for _ in range(200)]).repartition(7)
    labels = spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality.with_statistics(docs).cache()
    model = quality.fit(stats, labels)
    rows = [(r["__cl_stats"], r.doc_id % 3 % 2) for r in stats.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    f = quality.Features(s.mean(axis=0), s.std(axis=0))(s)
    size = quality.FEATURES + 1
    gram = f.T @ f + quality.RIDGE * len(y) / size * 0.1 * np.eye(size)
    assert model.raw(s) == pytest.approx(f @ np.linalg.solve(gram, f.T @ y), abs=1e-6)
    assert (np.diff(model.share) >= 0).all()


def test_pooled_is_the_best_non_decreasing_fit():
    rng = random.Random(17)
    for _ in range(50):
        n = rng.randrange(1, 6)
        w = np.array([float(rng.randrange(1, 4)) for _ in range(n)])
        mean = np.array([rng.randrange(5) / 4 for _ in range(n)])
        got = quality.pooled(w, w * mean)
        loss = lambda fit: (w * (np.array(fit) - mean) ** 2).sum()
        levels = sorted({float((w[a:b] * mean[a:b]).sum() / w[a:b].sum()) for a in range(n) for b in range(a + 1, n + 1)})
        best = min(loss(c) for c in itertools.combinations_with_replacement(levels, n))  # block means are enough
        assert (np.diff(got) >= -1e-12).all() and loss(got) == pytest.approx(best)


def test_pooled_is_the_isotonic_fit():
    assert quality.pooled(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1])).tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1])


def test_toxicity(spark):
    rng = random.Random(8)
    texts, toxic = [], []
    for i in range(500):
        words = text_of(rng, 60).split()
        bad = i % 5 == 0
        for _ in range(rng.randrange(1, 6) if bad else 0):
            words[rng.randrange(60)] = rng.choice(["Idiot", "moron,", "SCUM"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, None, toxic[i]) for i in range(300)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert all((got[i]["__cl_toxic_p"] >= 0.5) == bool(toxic[i]) for i in range(500))
    assert all(0 <= got[i]["__cl_severity"] <= toxicity.GRADES for i in range(502)) and got[500]["__cl_toxic_p"] < 0.5
    assert toxicity.drop_toxic(docs, labels).count() == 402
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == 502
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_severity_rises_with_the_grade():
    x = toxicity.Rows([[], [0], [0, 1], [0, 1, 2]] * 40, 3)
    w, theta = toxicity.fit_ordinal(x, np.array([0, 1, 2, 3] * 40))
    assert (w > 0).all() and list(theta) == sorted(theta)


def brute_likelihood(v, rows, grade, weight, ridge):
    """Grade by grade, as the model is defined."""
    d = 1 + max(i for r in rows for i in r)
    theta = [v[d]]
    for f in v[d + 1 :]:
        theta.append(theta[-1] + math.exp(f))
    above = lambda z, j: 1.0 if j < 0 else 0.0 if j >= len(theta) else 1 / (1 + math.exp(theta[j] - z))
    out = 0.5 * (sum(ridge * x * x for x in v[:d]) + sum(1e-3 * x * x for x in v[d:]))
    for r, g, w in zip(rows, grade, weight, strict=True):
        z = sum(v[i] for i in r)
        out -= w * math.log(above(z, g - 1) - above(z, g))
    return out


def test_ordinal_fit_maximises_the_cumulative_link_likelihood():
    rng = random.Random(9)
    rows = [sorted(rng.sample(range(5), rng.randrange(5))) for _ in range(200)] + [[4]]
    grade = [min(3, max(0, round(len([i for i in r if i < 3]) + rng.gauss(0, 1)))) for r in rows]
    weight = [rng.choice((1.0, 0.5, 0.25)) for _ in rows]
    x, g, w = toxicity.Rows(rows, 5), np.array(grade), np.array(weight)
    point = np.array([rng.gauss(0, 1) for _ in range(8)])
    value, slope = toxicity.loss_and_slope(point, x, g, w, 0.3)
    assert value == pytest.approx(brute_likelihood(point, rows, grade, weight, 0.3))
    for i in range(8):
        step = np.eye(8)[i] * 1e-5
        assert slope[i] == pytest.approx((brute_likelihood(point + step, rows, grade, weight, 0.3) - brute_likelihood(point - step, rows, grade, weight, 0.3)) / 2e-5, abs=1e-4)
    beta, theta = toxicity.fit_ordinal(x, g, w, 0.3)
    best = np.concatenate([beta, theta[:1], np.log(np.diff(theta))])
    least = brute_likelihood(best, rows, grade, weight, 0.3)
    for _ in range(300):  # no point near it or far from it is better
        other = best + np.array([rng.gauss(0, 1) for _ in range(8)]) * rng.choice((1e-3, 1e-2, 0.1, 1))
        assert brute_likelihood(other, rows, grade, weight, 0.3) >= least - 1e-9


def test_copies_share_one_weight(spark):
    rng = random.Random(10)
    a, b = text_of(rng, 40), text_of(rng, 40)
    rows = spark.createDataFrame([(a, 1), (a, 0), (a.upper(), 0), (b, 1), ("", 0), (None, 0)], "text string, y int")
    got = toxicity.weighted(rows, "text").collect()
    assert sorted((r.w, r.y) for r in got) == [(1 / 3, 0), (1 / 3, 0), (1 / 3, 1), (0.5, 0), (0.5, 0), (1.0, 1)]
