"""Vector codes, byte-pair encoding and lexical search against their plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echofold.llm import bpe, codes, lexical, queries
from echofold.sources.staging import stage

from .test_operators import ODD, any_docs, docs, empty, odd, texts_of  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id bigint, embedding array<float>, label int, code string, v int, upper double, part int, _label int"


# ---- vector codes

def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """(error, code) of each vector in the given order, and the codebooks, by full scans in Python's integers."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = [nearest(p, v[p])[1] for v in cut]
            for i in set(got):
                own = [v[p] for v, g in zip(cut, got, strict=True) if g == i]
                books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    return [(sum(d for d, _ in f), "".join(f"{i:02x}" for _, i in f)) for f in found], books


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, 0.5, 2, 3) for i, v, label in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("kind", ["normal", "ties", "repeats", "few"])
def test_codes_against_full_scans(spark, kind):
    rng = np.random.default_rng(3)
    n = 20 if kind == "few" else 400
    x = rng.standard_normal((n, 32)).astype(np.float32)
    if kind == "ties":
        x = rng.integers(-2, 3, (n, 32)).astype(np.float32) / 256
    if kind == "repeats":
        x[n // 3 :] = x[5]
    rows = [(i, v.tolist(), None if i % 3 == 0 else i % 4) for i, v in enumerate(x)]
    coded, entries = codes.compress(made(spark, rows))
    expected, books = plain_codes(x.tolist())
    assert entries.tolist() == books
    got = sorted(codes.with_label_error(coded).collect(), key=lambda r: r.vec_id)
    assert [(r.error, r.code) for r in got] == expected
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got)
    assert codes.told(entries) == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_bounds_spare_scans_and_lose_none(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((64, 64)) * 4
    x = (centres[rng.integers(0, 64, 3000)] + rng.standard_normal((3000, 64)) * 0.05).astype(np.float32)
    x[:64] = centres
    coded, _ = codes.compress(made(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]))
    expected, _ = plain_codes(x.tolist())
    got = sorted(coded.collect(), key=lambda r: r.vec_id)
    assert [(r.error, r.code) for r in got] == expected
    assert sum(r.n_scans for r in got) < 0.1 * 16 * len(got)


def test_codes_of_odd_vectors(spark):
    good = [float(i) / 7 for i in range(32)]
    rows = [(5, good, 1), (5, good, 1), (None, good[::-1], None), (2, None, 1), (3, [None, *good[1:]], 1), (4, [math.nan, *good[1:]], 2), (6, [math.inf, *good[1:]], 2), (1, [-x for x in good], None)]
    out = codes.with_label_error(codes.compress(made(spark, rows))[0]).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == [(False, 1), (False, 5), (False, 5), (True, 0)]
    assert {r.error for r in out} == {0}
    nothing, entries = codes.compress(made(spark, rows[3:5]))
    assert codes.with_label_error(nothing).count() == 0 and not entries.size
    for wrong in ([1.0] * 31, [1.0] * 16, [1e9] * 32):
        with pytest.raises(Exception, match="vectors must have"):
            codes.compress(made(spark, [*rows, (0, wrong, 1)]))[0].collect()


def test_label_errors_by_a_shuffle(spark, monkeypatch):
    rows = [(i, [float(i * j % 7) for j in range(16)], None if i % 3 else i) for i in range(90)]
    coded, _ = codes.compress(made(spark, rows))
    once = sorted(map(tuple, codes.with_label_error(coded).collect()))
    monkeypatch.setattr(codes, "LABELS", 0)
    assert sorted(map(tuple, codes.with_label_error(coded).collect())) == once


# ---- byte-pair encoding

SPECIAL = ["<|endoftext|>", "a<|startoftext|>b<|endoftext|>c", "<|EndOfText|>", "<|endoftext|", "É́ é<|endoftext|>́x", "ΑΣ ΣΑΣ ἈΣ", "İI ı ß ẞ ǅ", "　a b\xa0c​d", "a\x00b \x1cc\x85d e", "12345 ①½Ⅷ 𝟙", "don't WON'T it's'll 'S", "👩‍👩‍👧 🇩🇪 ☕️", "́̈ ́", "한국어 조선말 각", "!!!???...", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def expected_codes(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_as_the_library(any_docs):
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for d, t in texts_of(any_docs):
        ids, text = expected_codes(t, tokenizer)
        expected[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(any_docs, PATH).collect())) == expected


def test_bpe_of_special_strings_and_scripts(spark):
    tokenizer = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate([*SPECIAL, " ".join(SPECIAL), "\n".join(SPECIAL)])), "doc_id int, text string")
    encoded = bpe.encode(df, PATH)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    for r in df.collect():
        assert (ids[r.doc_id], texts[r.doc_id]) == expected_codes(r.text, tokenizer), r.text


def test_bpe_of_random_words():
    own, tokenizer = bpe.codec(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(6)
    for letters in ("ab", "etaoin shrdlu", "aeé ñ日本'!?.1234Σς"):
        for n in (1, 2, 3, 17, 400, 5000):
            text = "".join(rng.choice(list(letters), n))
            assert (own.encode(text.encode()).tolist(), own.decode(own.encode(text.encode()))) == expected_codes(text, tokenizer)


def test_bpe_of_very_long_texts(monkeypatch):
    own, tokenizer = bpe.codec(PATH), Tokenizer.from_file(PATH)
    text = "".join(np.random.default_rng(7).choice(list("abcdefgh \n"), 200_000)) + "x" * 100_000 + " tail"
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    for size in (1 << 22, 1000, 7):
        monkeypatch.setattr(bpe.pieces, "__defaults__", (size,))
        assert own.encode(text.encode()).tolist() == expected


def test_bpe_forgets_words(monkeypatch):
    own = bpe.Codec(PATH)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    text = b"one two three four five six seven one two three"
    assert own.encode(text).tolist() == Tokenizer.from_file(PATH).encode(text.decode(), add_special_tokens=False).ids
    assert len(own.words) <= 3 and len(own.parts) <= 3


# ---- lexical search

TERM = re.compile(lexical.TERM)


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k=10):
    """Scores of all documents for each item, straight from the contract."""
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, tokens = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n) // tokens
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if null else d, -s] += 1
    return out


@pytest.mark.parametrize("shard_bytes", [1, 2000, 1 << 25])
def test_search_against_all_scores(any_docs, spark, sf_dir, shard_bytes):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    more = [(1000, None), (1001, ""), (1002, "..."), (1003, "LOREM ipsum a"), (1003, "one SIX x"), (None, "und und UND"), (1004, "日本語 a.b@c.de 10.0.0.1")]
    items = items.unionByName(spark.createDataFrame(more, "item_id bigint, text string"))
    index = stage(lexical.build_index(any_docs, shard_bytes))
    expected = plain_search(texts_of(any_docs), [(r.item_id, r.text) for r in items.collect()])
    assert Counter(map(tuple, lexical.search(index, items).collect())) == expected


def test_search_in_blocks_and_by_names(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"alpha beta w{i % 7} w{i % 3} " * (i % 5 + 1), 1) for i in range(60)], "doc_id string, text string, n int").repartition(3)
    items = spark.createDataFrame([(f"i{i}", f"w{i} alpha w{i + 1} beta", 2) for i in range(6)], "item_id string, text string, score int")
    index = stage(lexical.build_index(docs, 500))
    once = sorted(map(tuple, lexical.search(index, items, 4).collect()))
    assert len(once) == 24
    monkeypatch.setattr(lexical, "ITEM_BYTES", 20)
    assert sorted(map(tuple, lexical.search(index, items, 4).collect())) == once
    assert lexical.search(index, items.limit(0)).count() == 0
    assert lexical.search(stage(lexical.build_index(docs.limit(0))), items).count() == 0


def test_merge_is_exact_and_ties_go_by_document():
    rng = np.random.default_rng(8)
    for trial in range(200):
        n, lists = 60, []
        for _ in range(int(rng.integers(1, 9))):
            own = np.flatnonzero(rng.random(n) < rng.random())
            lists.append((own.tolist(), rng.integers(0, 4 if trial % 2 else 1000, len(own)).tolist()))
        scores = Counter()
        for own, adds in lists:
            for d, a in zip(own, adds, strict=True):
                scores[d] += a
        best = sorted(((s, d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))
        for k in (1, 3, 100):
            assert lexical.merge(lists, k) == best[:k]


def test_postings_round_trip():
    rng = np.random.default_rng(9)
    for values in (np.array([], np.int64), np.array([0, 127, 128, 16383, 16384, 2**40, 2**62]), rng.integers(0, 300, 1000)):
        data, ends = lexical.pack(values)
        assert lexical.unpack(data).tolist() == values.tolist() and (not len(ends) or ends[-1] == len(data))


def test_terms_of_very_long_texts(monkeypatch):
    text = ("Abc-dé1 " * 5000 + "y" * 3000).encode()
    whole = plain_terms(text.decode())
    for size in (10, 1000, 1 << 22):
        monkeypatch.setattr(lexical, "PIECE", size)
        assert [t.decode() for some in lexical.terms(text) for t in some] == whole


def test_queries_are_registered():
    assert {"op11_hamerly_codes", "op12_bpe_queue", "op13_heap_merge_search"} <= set(queries.QUERIES)
