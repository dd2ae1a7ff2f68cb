"""Each text operator against its plain version, on the smallest tables and on odd rows."""

import base64
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echofold.llm import decontam, fertility, langid, lines, packing, pii, quality, queries, ring, simhash, substring
from echofold.llm.common import WordIds
from echofold.llm.components import components

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int, rid string, kind string, spans string"
VOCABULARIES = [public_tokenizers.path(v) for v in queries.VOCABULARIES]
LONG = "lorem ipsum dolor sit amet consectetur " * 9
ODD = [
    None, "", " \n\t ", "a", "..!!", "x" * 30_000, "Und " * 300, LONG, LONG, LONG + "tail", "head " + LONG, "ß" * 250, "É" * 99 + "ñ" * 300,
    "one two three four five six\none two three four five six\nshort\n", "mail a.b@c.de, a@b.c_d@e.f +1 (743) 555-3824 4111 1111 1111 1111 10.0.0.1 256.1.1.1 0000001.2.3.4 +12 1",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1", "<|endoftext|> <|ENDOFTEXT|> it's I'LL é  nbsp em \x1c fs \x85 nel", "+1.2.3-4()5 6 7 8 9 0  ", "@@a@b@c.d.e..f x@y.z.", "日本語 テキスト です。" * 40,
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [(i, t, "en" if i % 2 else None, None, None, 0.5, 1, "r", "k", "s") for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "s", 1, 0.1, 2, "r", "k", "s")] * 2 + [(None, None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module", params=["docs", "odd", "empty"])
def any_docs(request):
    return request.getfixturevalue(request.param)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_substring_dedup(any_docs):
    given = texts_of(any_docs)
    expected = [(d, *x) for (d, _), x in zip(given, brute.removed_spans([t for _, t in given]), strict=True)]
    found = [(r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in substring.dedup(any_docs).collect()]
    assert Counter(found) == Counter(expected)


def test_substring_dedup_of_repetitive_bytes(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("ab"), 900))
    texts = [base, base[:450] + "c" + base[450:], base[100:320], "x" + base[101:301], base[101:300], "ab" * 300, "ab" * 101, "b" + "ab" * 120, *["".join(rng.choice(list("ab"), 700)) for _ in range(4)], base[300:700] * 2]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in substring.dedup(df).collect()}
    assert found == dict(enumerate(brute.removed_spans(texts)))


def test_anchors_in_stretches(monkeypatch):
    text = ("".join(np.random.default_rng(2).choice(list("abc "), 5000)) + "ab" * 900).encode()
    whole = substring.anchors(text)
    for n in (1, 97, 1000):
        monkeypatch.setattr(substring, "STRETCH", n)
        assert all(np.array_equal(a, b) for a, b in zip(whole, substring.anchors(text), strict=True))


def test_anchors_of_several_texts_are_their_own():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abc "), n)).encode() for n in (0, 199, 700, 0, 0, 200, 201, 5000, 1, 300, 0)]
    texts += [texts[2], texts[2][100:], b"ab" * 300]
    for own in (texts, texts[:2], texts[3:6], []):
        row, *found = substring.anchors_of(own)
        alone = [substring.anchors(t) for t in own]
        assert row.tolist() == [i for i, a in enumerate(alone) for _ in a[0]]
        for k, x in enumerate(found):
            assert x.tolist() == [y for a in alone for y in a[k].tolist()]


@pytest.mark.parametrize("part", [400, 900, 1 << 20])
def test_stretches_around_anchors(monkeypatch, part):
    monkeypatch.setattr(substring, "PART", part)
    rng = np.random.default_rng(part)
    texts = [rng.bytes(n) for n in (200, 9000, 700, 5000)]
    at = [[{"x": int(x), "o": 0} for x in rng.integers(0, len(t) - 31, n)] for t, n in zip(texts, (1, 40, 2, 3), strict=True)]
    kind = pa.list_(pa.struct([("x", pa.int32()), ("o", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts), pa.array(at, kind)], ["rid", "text", "anchors"])
    for t, r in zip(texts, next(substring._segments(iter([batch]))).to_pylist(), strict=True):
        own = []
        for x in sorted(a["x"] for a in r["anchors"]):
            lo, hi = max(0, x - 168), min(len(t), x + 200)
            if own and lo <= own[-1][1] and hi - own[-1][0] <= part:
                own[-1][1] = hi
            else:
                own.append([lo, hi])
        assert r["size"] == len(t) and r["parts"] == [{"at": lo, "bytes": t[lo:hi]} for lo, hi in own]


def test_substring_dedup_hashes_and_does_not_sort(docs, monkeypatch):
    plans, stage = [], substring.stage
    monkeypatch.setattr(substring, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stage(df))[1])
    plans.append(substring.dedup(docs)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and "ShuffledHashJoin" in plans[-1]
    assert not any(re.search("SortAggregate|SortMergeJoin", p) for p in plans)


def test_packing(any_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack_documents(any_docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    sequences = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == brute.crc(r.ids) and len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048 and (end == 2048 or end.bit_count() == 1)
    expected = Counter()
    for d, t in texts_of(any_docs):
        expected[d, tuple(brute.tokens(tokenizer, t))] += 1
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for (d, ids), times in expected.items():
        pieces = sorted((s, x) for s, x, n in by_doc[d] if n == len(ids) and list(ids[s : s + len(x)]) == x)
        covered = Counter(i for s, x in pieces for i in range(s, s + len(x)))
        assert all(covered[i] >= times for i in range(len(ids)))
    assert sum(r.length for r in out) == sum(len(ids) * n for (_, ids), n in expected.items())


def test_packing_looks_a_word_up_once_a_stretch():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counted.asked += 1
            return super().__getitem__(k)

    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    words.ids = Counted()
    texts = [" \tWord, it's\x0b(other) \xe9t\xe9... <|endoftext|>\x1cx\r\n", "", "a much used LINE of words! " * 500] * 60
    found = [t.tolist() for t in words.encode([t.encode() for t in texts])]
    assert found == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert Counted.asked < 2_000  # of 180,000 words


def test_fill_is_closest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = dict(Counter(rng.integers(1, 40, rng.integers(1, 9)).tolist()))
        target = int(rng.integers(0, 90))
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        taken = packing.fill(counts, target)
        assert all(k <= counts[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= target)


@pytest.mark.parametrize("shingle", [4, 5])
def test_simhash(any_docs, shingle):
    given = texts_of(any_docs)
    fps = [brute.fingerprint(t, shingle) for _, t in given]
    ids = [10**9 if d is None else d for d, _ in given]
    expected = Counter(zip(ids, fps, brute.near_components(ids, fps, 4), strict=True))
    out = simhash.near_duplicates(any_docs, shingle, 4).collect()
    assert Counter((10**9 if r.doc_id is None else r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == expected


@pytest.mark.parametrize("radius,bucket", [(2, 50_000), (4, 50_000), (7, 50_000), (2, 30), (4, 30)])
def test_trie_join_finds_all_links(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # small: nearly all buckets are dealt out again
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds[:30].tolist():
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 9), replace=False):
                s ^= 1 << int(b)
            fps.add(s)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    roots = components(simhash.links(df, radius, len(fps)))
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in roots.collect()}
    groups = brute.near_components(fps, fps, radius)
    pairs = defaultdict(set)
    for f, g in zip(fps, groups, strict=True):
        pairs[g].add(f)
    for members in pairs.values():
        assert len({found.get(f, f) for f in members}) == 1
    assert len({found.get(f, f) for f in fps}) == len(pairs)


def test_near_copies(any_docs):
    rows = any_docs.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text")
    out = {r.doc_id: r.component_id for r in simhash.near_copies(rows).collect()}
    sets = {d: brute.shingle_set(t, 5) for d, t in texts_of(rows)}
    assert out.keys() == sets.keys()
    coarse = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 5, 4).collect()}
    assert all(out[d] == out[c] for d, c in coarse.items())
    heads = [d for d in out if out[d] == d]
    assert not [(a, b) for a in heads for b in heads if a < b and brute.jaccard(sets[a], sets[b]) >= 0.8]
    for d, c in out.items():  # whoever goes is close to another text of its group
        if d != c:
            assert any(coarse[d] == coarse[e] or brute.jaccard(sets[d], sets[e]) >= 0.8 for e in out if e != d and out[e] == c)


def test_near_copies_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(120):
        own = list(words)
        own[int(rng.integers(0, 300))] = f"x{i}"
        rows.append((i, " ".join(own)))
    shared = words[:150]
    rows += [(200 + i, " ".join(shared + [f"y{j}" for j in rng.integers(0, 5000, 150)])) for i in range(40)]
    out = simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r.component_id for r in out if r.doc_id < 200} == {0}
    assert all(r.component_id == r.doc_id for r in out if r.doc_id >= 200)


def test_near_copies_of_stars_in_any_order(spark):
    rng = np.random.default_rng(21)
    texts = []
    for g in range(12):
        words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        texts.append(" ".join(words))
        for i in range(8):  # near 0.84 to the first text, 0.71 to each other
            own = list(words)
            for place in rng.choice(np.arange(5, 295, 6), 5, replace=False):
                own[place] = f"x{g}.{i}.{place}"
            texts.append(" ".join(own))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    out = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    sets, fps = [brute.shingle_set(t, 5) for t in texts], [brute.fingerprint(t, 5) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if brute.jaccard(sets[a], sets[b]) >= 0.8 or (fps[a] ^ fps[b]).bit_count() <= 4:
                group = [min(group[a], group[b]) if x in (group[a], group[b]) else x for x in group]
    assert len(set(group)) == 12
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(group))


def test_rare_shingles_pair_all_that_resemble(spark):
    rng = np.random.default_rng(11)
    passage = list(range(1000, 1085))
    sets = [set(passage + rng.integers(10**6, 10**9, 15).tolist()) for _ in range(60)]  # near 0.74 to each other
    for n in (1, 2, 5, 20, 60, 200):
        base = rng.integers(0, 900, n).tolist()
        for _ in range(12):
            own = set(base[int(rng.integers(0, n // 4 + 1)) :] + rng.integers(0, 10**6, int(rng.integers(0, n // 4 + 1))).tolist())
            sets.append(own | {7})
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "doc_id bigint, hashes array<bigint>")
    found = {tuple(r) for r in simhash.sharing_rare(df, 0.8).collect()}
    alike = {(b, a) for a in range(len(sets)) for b in range(a + 1, len(sets)) if brute.jaccard(sets[a], sets[b]) >= 0.8}
    assert alike and alike <= found
    assert not [1 for a, b in found if a < 60 and b < 60]
    assert simhash.sharing_rare(df.limit(0), 0.8).count() == 0


def test_pii_base(any_docs):
    expected = Counter((d, brute.told(brute.base_spans(t))) for d, t in texts_of(any_docs))
    found = pii.find(any_docs).select("doc_id", pii.told("base").alias("b"))
    assert Counter(rows_of(found)) == expected


def test_pii_discovers_by_context(spark, tmp_path):
    texts = [f"please call me at +1 (743) 555-38{i:02d} today friend" for i in range(12)] + ["please call me at 743-555-3899 today friend", "order number 743-555-3899x1 shipped", "at 17 12345 boxes"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = {r.doc_id: [(s.start, s["end"], s.value) for s in r.spans] for r in pii.find(docs).collect()}
    assert out[12] == [(18, 30, "743-555-3899")] and out[13] == [] and out[14] == []
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[12] == "please call me at [PHONE] today friend" and masked[14] == texts[14]


def test_pii_discovers_over_several_hops(spark, tmp_path):
    def number(hop, i):
        return f"743-555-{hop}{i:03d}"

    texts = [f"please call me at +1 (743) 555-38{i:02d} today friend" for i in range(12)] + [f"please call me at {number(0, i)} today friend" for i in range(3)]
    texts += [f"the desk line is {number(0, i)} sir" for i in range(3)] + [f"the desk line is {number(1, 0)} sir"]  # no base span in this context
    for hop in range(2, 7):  # each context holds three numbers of the one before and one more that no other holds
        old = [number(hop - 1, 0), *(number(0, i) for i in range(2))]
        texts += [f"c{'abcdefgh'[hop]} says {v} ok" for v in [*old, number(hop, 0)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    found = {s.value for r in pii.find(spark.read.parquet(str(tmp_path / "d"))).collect() for s in r.spans}
    assert {number(hop, 0) for hop in range(7)} <= found


def test_pii_finds_secrets_by_context(spark, tmp_path):
    rng = np.random.default_rng(2)

    def code(n):
        return "".join(rng.choice(list("0123456789abcdef"), n))

    texts = [f'the deploy token = "{code(40)}" of {w}' for w in "ab cd ef gh ij kl mn op".split()] + ['my own token = "x7kq92mz" here', f"the part {code(40)} is in stock", "a token of thanks 2024abcd", f"number token = {'9' * 16} no"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    out = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find(spark.read.parquet(str(tmp_path / "d")), "text").collect()}
    assert all(len(out[i]) == 1 and out[i][0][0] == pii.SECRET for i in range(8)) and out[8] == [(pii.SECRET, "x7kq92mz")]
    assert out[9] == out[10] == out[11] == []
    masked = {r.doc_id: r.text for r in pii.mask(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert masked[8] == 'my own token = "[SECRET]" here' and masked[9] == texts[9]


def plain_discovery(texts):
    """The rounds of scoring in plain loops over one table of (pattern, value) pairs."""
    def plain(x):
        return re.sub("[0-9]", "0", re.sub("[\"'`()<>,;]", "", x.lower()))

    def contexts(t, s, e):
        before, after = plain(t[max(0, s - 48) : s]), plain(t[e : e + 24])
        two, one, right = re.search(r"(\S+\s+\S+)\s*$", before, re.A), re.search(r"(\S+)\s*$", before, re.A), re.match(r"\s*(\S+)", after, re.A)
        return ([f"L {two[1]}"] if two else []) + ([f"B {one[1]} _ {right[1]}"] if one and right else [])

    def fits(k, v):
        n = sum(c in "0123456789" for c in v)
        flat = re.fullmatch(r"[0-9().+-]+", v)
        return bool([re.fullmatch("[^@]+@[^@]+", v), re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v), flat and 12 <= n <= 19, flat and 7 <= n <= 15, re.fullmatch("[A-Za-z0-9+/_=.~-]{8,}", v) and re.search("[A-Za-z]", v) and n][k])

    found, known, free = defaultdict(set), set(), []
    for i, t in enumerate(texts):
        base = brute.base_spans(t)
        for s, k, e, v in base:
            known.add((v, k))
            for c in contexts(t, s, e):
                found[c].add(v)
        for m in re.finditer("[^\\s,;:\"'()<>]+", t, re.A):
            v = m[0].lstrip(pii._SIGNS)
            s = m.end() - len(v)
            v = v.rstrip(pii._SIGNS)
            n = sum(c in "0123456789" for c in v)
            if not ("@" in v or n >= 4 or n and re.search("[A-Za-z]", v) and len(v) >= 8) or any(a < s + len(v) and s < b for a, _, b, _ in base):
                continue
            free.append((i, s, v, contexts(t, s, s + len(v))))
            for c in free[-1][3]:
                found[c].add(v)
            if re.fullmatch("[A-Za-z0-9+/_=-]{20,}", v) and re.match("(?:[^0-9]*[0-9]+[^0-9A-Za-z]*[A-Za-z]){4}", v):
                known.add((v, pii.SECRET))
    while True:
        sure = {(c, k) for c, vs in found.items() for k in range(5) if (n := sum((v, k) in known for v in vs)) >= pii.SUPPORT and n >= pii.CONFIDENCE * len(vs)}
        grown = known | {(v, k) for c, k in sure for v in found[c] if fits(k, v)}
        if grown == known:
            break
        known = grown
    out = defaultdict(list)
    for i, s, v, cs in free:
        if kinds := [k for c, k in sure if c in cs and fits(k, v)]:
            out[i].append((s, min(kinds), s + len(v)))
    return out


def test_pii_discovery_is_that_of_plain_loops(spark, docs, tmp_path):
    texts = [t or "" for _, t in texts_of(docs)] + [f"please call me at +1 (743) 555-38{i:02d} today friend" for i in range(9)] + ["please call me at 743-555-3899 today friend"] * 2
    texts += [f"reach u{i} by mail@host{i}.org now" for i in range(5)] + ["reach u9 by mail@host now", "server 10.0.0.1 up", "server 10.0.0.2 up", "server 10.0.0.3 up", "server 910.0.0.7 up"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    want = plain_discovery(texts)
    assert sum(map(len, want.values())) > 3
    for r in pii.find(spark.read.parquet(str(tmp_path / "d"))).collect():
        base = [(s, k, e) for s, k, e, _ in brute.base_spans(texts[r.doc_id])]
        assert sorted(base + want[r.doc_id]) == sorted((s.start, s.kind, s["end"]) for s in r.spans), texts[r.doc_id][:200]


def test_pii_of_very_long_tokens(spark, tmp_path):
    n = 1_000_000
    k = n // 10
    texts = ["a" + "=" * n + "b12345", "." * n + "9999" + "!" * n, "7" * k, "1 " * (k // 4), "98765 x " * (k // 8), "+1" + "-" * k, "a@" * (k // 2), "ab1" * k]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    began = time.time()
    assert pii.find(spark.read.parquet(str(tmp_path / "d"))).count() == len(texts)
    assert time.time() - began < 90


def test_pii_mask_keeps_columns(any_docs):
    out = pii.mask(any_docs)
    assert out.columns == any_docs.columns
    for r in out.collect():
        assert not any(k in ("email",) for k in brute.told(brute.base_spans(r.text)).split(":"))
    assert out.count() == any_docs.count()


def test_fertility_counts(any_docs):
    out = fertility.verdicts(any_docs, VOCABULARIES).collect()
    expected = Counter()
    for d, t in texts_of(any_docs):
        n = brute.base_counts(t)
        expected[d, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == expected
    assert not any(r.kept and r.base_failed for r in out)


def plain_encoders():
    """How each vocabulary of op6 tells a word's tokens and which of them are bytes, word by word."""
    piece = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[0])
    with open(VOCABULARIES[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sequences = {b: a for a, b in ranks.items()}
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def in_bytes(w):
        found = coder.encode_ordinary(" " + w[:512]) + [x for i in range(512, len(w), 512) for x in coder.encode_ordinary(w[i : i + 512])]
        return [(x, len(sequences[x]) == 1 and sequences[x] >= b"\x80") for x in found]

    return [lambda w: [(x, piece.is_byte(x)) for x in piece.encode(w)], in_bytes]


def test_fertility_verdicts_are_those_of_plain_loops(any_docs):
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in any_docs.select("doc_id", "lang", "text").collect()]
    expected = Counter(brute.fertility_verdicts(rows, plain_encoders()))
    assert Counter((r.doc_id, r.kept) for r in fertility.verdicts(any_docs, VOCABULARIES).collect()) == expected


def test_fertility_of_a_very_long_word(spark, tmp_path):
    began = time.time()
    fertility_of(spark, tmp_path / "d", [(1, "en", "x" * 1_000_000), (2, "en", "é#" * 400_000)])
    assert time.time() - began < 60


def prose(docs, rng, n):
    """Texts of 100 to 125 words drawn from those of the table's English ones."""
    words = sorted({w for r in docs.where("lang = 'en'").collect() for w in (r.text or "").split() if w.isascii() and w.isalpha()})[:800]
    return [" ".join(rng.choice(words, int(rng.integers(100, 125)))) for _ in range(n)]


def fertility_of(spark, tmp_path, texts):
    spark.createDataFrame(texts, "doc_id bigint, lang string, text string").write.parquet(str(tmp_path))
    out = fertility.verdicts(spark.read.parquet(str(tmp_path)), VOCABULARIES).collect()
    return {r.doc_id: (r.base_failed, r.band_failed, r.kept) for r in out}


def test_fertility_judges_thin_groups(spark, docs, tmp_path):
    rng = np.random.default_rng(4)
    texts = [(i, "en", t) for i, t in enumerate(prose(docs, rng, 80))]

    def junk(n):
        return " ".join("".join(rng.choice(list("qxzjkvw#%"), 7)) for _ in range(n))

    texts += [(100, "en", junk(900)), (101, "rare", junk(110)), (102, "rare", texts[5][2] + " end")]
    out = fertility_of(spark, tmp_path / "d", texts)
    assert out[100] == out[101] == (False, True, False)
    assert out[102] == (False, False, True) and sum(out[i][2] for i in range(80)) > 70


def test_fertility_bands_count_copies_once(spark, docs, tmp_path):
    rng = np.random.default_rng(6)
    texts = [(i, "en", t) for i, t in enumerate(prose(docs, rng, 80))]
    texts += [(80 + i, "en", " ".join(rng.choice(texts[0][2].split()[:40], 110))) for i in range(8)]  # of few words, so of low entropy
    alone = fertility_of(spark, tmp_path / "a", texts)
    assert sum(alone[i][2] for i in range(80)) > 70
    copies = [(1000 + i, "en", texts[80][2]) for i in range(300)]
    both = fertility_of(spark, tmp_path / "b", texts + copies)
    assert {d: v for d, v in both.items() if d < 1000} == alone
    assert {both[d] for d, _, _ in copies} == {alone[80]}


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_ring(any_docs, shards):
    out = ring.assign(any_docs, shards=shards, virtual=16).collect()
    expected = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts_of(any_docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == expected
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_ring_against_plain_places(spark, monkeypatch):
    monkeypatch.setattr(ring, "CELL", 30)
    rows = [(i if i % 3 else 7, "t" * (i % 5)) for i in range(900)]  # a key on a third of the rows
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = ring.assign(docs, shards=5, virtual=4).collect()
    nodes = ring.ring(5, 4)
    place = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    own = {d: next((s for p, s in nodes if p >= h), nodes[0][1]) for d, h in place.items()}
    assert all(r.ring_shard == own[r.doc_id] for r in out)
    wanted = Counter(own[d] for d, _ in rows)
    stay = Counter(r.shard for r in out if r.shard == r.ring_shard)
    assert all(stay[s] == min(wanted[s], 180) for s in range(5))  # a shard serves its own keys first, up to its quota
    assert {s: sorted(r.slot for r in out if r.shard == s) for s in range(5)} == {s: list(range(180)) for s in range(5)}


def test_ring_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(ring, "CELL", 30)
    rows = [(i if i % 3 else 7, "t" * (i % 5 if i % 3 else 2)) for i in range(900)]  # a third are copies of one row
    docs = spark.createDataFrame([*rows, *[(None, None)] * 70], "doc_id bigint, text string")
    found = [Counter(tuple(r) for r in ring.assign(d, shards=7, virtual=5).collect()) for d in (docs.repartition(5), docs.orderBy(F.desc("doc_id")).coalesce(1), docs.repartition(3, "text"))]
    assert found[0] == found[1] == found[2]
    assert sum(found[0].values()) == 970


def test_ring_overflow_against_a_plain_ring(spark):
    rows = [(i if i % 3 else 7, "t" * (i % 5)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    nodes = ring.ring(6, 8)
    named = docs.select("doc_id", (F.length("text") + 16).cast("long").alias("size"), F.crc32("text").alias("crc"))
    told = named.select("doc_id", "size", "crc", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.xxhash64("doc_id", "size", "crc").alias("spread")).collect()
    arcs = {}
    for r in told:
        arcs.setdefault(next((i for i, (p, _) in enumerate(nodes) if p >= r.h), 0), []).append((r.spread, r.doc_id, r.size, r.crc))
    room, wanted, waiting = [150] * 6, Counter(), []

    def put(key, shard):
        room[shard] -= 1
        wanted[(*key, shard)] += 1

    for arc in sorted(arcs):
        for key in sorted(arcs[arc]):
            if room[nodes[arc][1]]:
                put(key[1:], nodes[arc][1])
            else:
                waiting.append((arc, key[1:]))
    assert len(waiting) > 100
    for arc, key in waiting:  # clockwise, node by node, to the first shard with room
        at = arc
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        put(key, nodes[at][1])
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in ring.assign(docs, shards=6, virtual=8).collect()) == wanted


def test_ring_moves_little(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r.doc_id: r.shard for r in ring.assign(docs, shards=n).collect()} for n in (10, 11))
    assert sum(a[d] != b[d] for d in a) < 0.35 * len(a)


def test_ring_is_native(docs):
    plan = ring.assign(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs, items).collect()}
    expected = {}
    for d, t in texts_of(docs):
        for i, x in ((r.item_id, r.text) for r in items.collect()):
            if set(brute.plain_words(x)) & set(brute.plain_words(t)) and (s := brute.leaks(t, x)) >= 0.8:
                expected[d, i] = s
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert decontam.clean(docs, items).count() == docs.count() - len({d for d, _ in found})


def test_decontamination_does_not_depend_on_the_radius(spark, tmp_path):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, n))) for i, n in enumerate([1, 3, 9, 9, 13, 40, 80])]
    texts = []
    for i, t in items:
        for _ in range(12):
            w = t.split()
            for at in rng.integers(0, len(w), int(rng.integers(0, 2 + len(w) // 30))):
                w[at] = f"x{rng.integers(0, 99)}"
            texts.append(" ".join([f"y{x}" for x in rng.integers(0, 99, int(rng.integers(0, 30)))] + w + [f"z{x}" for x in rng.integers(0, 99, int(rng.integers(0, 30)))]))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df, given = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if brute.leaks(t, x) >= 0.8}
    for radius in (1, 7):
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, given, radius=radius).collect()} == want
    assert {r.doc_id for r in decontam.clean(df, given).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_with_a_common_passage(spark, tmp_path):
    """All texts and items hold a passage of 44 words; ids are text. Few pairs meet, and all matches are found."""
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(44)]
    items = [(f"i{i}", " ".join(passage + [f"i{i}w{j}" for j in range(16)])) for i in range(60)]
    texts = [" ".join([*(f"t{d}a{j}" for j in range(int(rng.integers(0, 20)))), *(items[d % 60][1].split() if d < 90 else passage), *(f"t{d}z{j}" for j in range(20))]) for d in range(240)]
    spark.createDataFrame([(f"d{d}", t) for d, t in enumerate(texts)], "doc_id string, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df, given = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id string, text string")
    want = {(f"d{d}", i) for d, t in enumerate(texts) for i, x in items if set(brute.plain_words(t)) & set(brute.plain_words(x)[44:]) and brute.leaks(t, x) >= 0.8}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, given).collect()} == want and len(want) == 90
    known = decontam.item_shingles(given, 5)
    own = known.select("iid", "k", "m", F.explode("hashes").alias("h")).groupBy("iid", "k", "m", "h").agg(F.count("*").alias("c"))
    found = decontam.windows(df.select(F.monotonically_increasing_id().alias("rid"), "text"), known, 0.8)
    near = found.select("rid", "k", "m", F.explode(F.array_distinct("hashes")).alias("h"))
    assert decontam.meeting(own, near, 0.8).count() < 20 * len(want)


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "A"), (4, LONG.upper()), (4, "one two, three! four five six")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, items).collect()}
    assert {(3, 3), (7, 4), (8, 4), (9, 4), (10, 4), (13, 4)} <= found
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.clean(odd, items).columns == odd.columns


def test_line_dedup(any_docs):
    seen, expected = set(), []
    order = sorted(lines.numbered(any_docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.rid))
    for r in order:
        kept, gone, at, t = [], [], 0, r.text or ""
        for piece in re.split(r"([^.!?\n]*[.!?\n])", t)[1::2] + [re.split(r"([^.!?\n]*[.!?\n])", t)[-1]]:
            w = brute.SPLIT.findall(re.sub(r"[.!?\n]$", "", piece))
            key = " ".join(w).lower()
            if len(w) >= 14 and key in seen:
                gone.append((at, at + len(piece)))
            else:
                kept.append(piece)
            if len(w) >= 14:
                seen.add(key)
            at += len(piece)
        expected.append((r.doc_id, tuple(gone), "".join(kept)))
    found = [(r.doc_id, tuple((s.lo, s.hi) for s in r.removed), r.kept or "") for r in lines.dedup(any_docs).collect()]
    assert Counter(found) == Counter(expected)


def test_line_dedup_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op9_line_dedup"])
    got = queries.QUERIES["op9_line_dedup"](spark, sf_dir)
    assert Counter(want.select(", ".join(got.columns)).fetchall()) == Counter(rows_of(got))


def test_quality(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = queries.QUERIES["op1_bradley_terry_quality"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.9
    assert all(0 <= r.score <= 1 for r in out)


def test_quality_is_that_of_plain_preferences(spark, docs, sf_dir):
    """The weights of a plain Newton fit over the same pairs give nearly the same scores."""
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    found = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labelled)).collect()}
    x = {d: quality.features((t or "").encode(), WordIds()) for d, t in texts_of(docs)}
    order = [r.doc_id for r in docs.join(labelled, "doc_id", "left_semi").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    label = {r.doc_id: r.label for r in labelled.collect()}
    good, bad = ([x[d] for d in order if label[d] == v] for v in (1, 0))
    n = 3 * max(len(good), len(bad))
    pairs = [(i % 2, i % len(good), (i * 7919 + i // len(good)) % len(bad)) for i in range(n)]
    w = brute.preference_weights(good, bad, pairs, 1e-3)
    cut = np.quantile([v @ w for v in good + bad], len(bad) / len(order))
    plain = {d: 1 / (1 + np.exp(-np.clip(v @ w - cut, -500, 500))) for d, v in x.items()}
    assert np.mean([abs(plain[d] - found[d]) for d in found]) < 0.05
    assert np.mean([(plain[d] >= 0.5) == (found[d] >= 0.5) for d in found]) >= 0.97


def test_quality_of_a_repeated_document(spark):
    """A labelled doc_id on any number of rows leaves the sample bounded."""
    rows = [(7, f"word {i} " * 20) for i in range(300)] + [(i, "#%$ " * i) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labelled = spark.createDataFrame([(7, 1), *((i, 0) for i in range(100, 140))], "doc_id bigint, label int")
    a, b = (quality.fit(docs, labelled, bound=100) for _ in range(2))
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut
    out = {(r.doc_id, r.score >= 0.5) for r in quality.score(docs, a).collect()}
    assert (7, True) in out and len([1 for d, up in out if d != 7 and up]) < 5


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """The cut lies where a plain quantile of all rows' scores does, also where labels are too many to broadcast."""
    rows = [(i, ("A plain sentence number %d, with words. " if i % 3 else "x#%d $$ ") % i * (1 + i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labelled = spark.createDataFrame([(i, int(i % 3 > 0 or i % 30 == 0)) for i in range(300)], "doc_id bigint, label int")
    a = quality.fit(docs, labelled)
    monkeypatch.setattr(quality, "LABELS", 10)
    b = quality.fit(docs, labelled)
    assert np.allclose(a.weights, b.weights, atol=1e-5) and abs(a.cut - b.cut) < 1e-4
    raw = [quality.features(t.encode(), WordIds()) @ a.weights for _, t in rows]
    assert abs(np.quantile(raw, 90 / 300) - a.cut) < 1e-5
    assert not hasattr(quality, "MAX_TRAIN") and quality.sample(labelled).count() == 300


def test_quality_without_pairs(odd, empty):
    labelled = odd.select("doc_id", F.lit(1).alias("label"))
    model = quality.fit(odd, labelled)
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, labelled)).count() == 0
    assert quality.accepted(odd, model).columns == odd.columns


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.QUERIES["op10_language_bitmask"](spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.9


@pytest.mark.parametrize("piece", [langid.PIECE, 50])
def test_language_is_that_of_plain_sets(spark, docs, monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    labelled = [(t, lang) for d, t, lang in rows if lang is not None and d % 3]
    model = langid.fit(spark.createDataFrame(labelled, "text string, lang string"))
    for d, t, _ in rows:
        lang, score = langid.decide(model, (t or "").encode())
        plain = brute.language_scores(labelled, t)
        if plain is None:
            assert (lang, score) == ("und", 0.0)
            continue
        assert abs(score - plain[lang]) < 0.05 and plain[lang] >= max(plain.values()) - 0.05


def test_language_members_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "MEMBERS", 4000)
    model = langid.fit(docs.select("text", "lang"))
    assert 2 < len(model.languages) and len(model.slots) <= 1 << 15
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.9


def test_language_odd(odd, empty):
    model = langid.fit(odd.select("text", "lang"))
    out = langid.predict(odd, model).collect()
    assert {r.lang_pred for r in out if r.doc_id in (0, 1, 2, 4, 15, 17)} == {"und"}
    assert {r.score for r in out if r.lang_pred == "und"} == {0.0} and all(0 <= r.score <= 1 for r in out)
    none = langid.fit(empty.select("text", "lang"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_bloom_lanes_beyond_64_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"l{i:02d}", (letters[i % 26] + letters[i // 26] + "q ") * 30) for i in range(70)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(df)
    assert model.slots.shape[1] == 2
    out = langid.predict(df.select(F.col("lang").alias("doc_id"), "text"), model).collect()
    assert all(r.doc_id == r.lang_pred for r in out)


def test_decontamination_looks_at_a_batch_of_texts_at_once(spark, monkeypatch):
    """Shingles over the end of a text are none of it, and a batch's texts are hashed together, not one by one."""
    item = [f"w{i}" for i in range(40)]
    texts = ["x " * 30 + " ".join(item[:20]), " ".join(item[20:]) + " y" * 30, "", " ".join(item), "... --- ...", " ".join(item[:3]), " ".join(item[3:]), None, "Z " + " ".join(f"{w.upper()}_!" for w in item) + " z"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid bigint, text string").coalesce(1)
    known = decontam.stage(decontam.item_shingles(spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string"), 5))
    assert {r.rid for r in decontam.windows(df, known, 0.8).collect()} == {3, 6, 8}

    class Frame:  # the step itself, on one batch
        sparkSession = spark

        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, _):
            return run

    calls, plain = [], decontam.shingles
    run = decontam.windows(Frame(), known, 0.8)
    monkeypatch.setattr(decontam, "shingles", lambda w, k: calls.append(len(w)) or plain(w, k))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["rid", "text"])
    assert {r["rid"] for b in run(iter([batch])) for r in b.to_pylist()} == {3, 6, 8} and len(calls) == 1


def test_words_without_signs_hash_the_same_whatever_their_bytes():
    words = ["Abc", "a_B-c!", "\u00c4bc", "\u00e4bc,", "...", "x\u2019s", "\u0130i", "9.5%"]
    found = decontam.Words()
    w, ends = found.joined([" ".join(words).encode(), b""])
    plain = [x for x in (decontam._SIGNS.sub("", x.lower()) for x in words) if x]
    assert w.tolist() == [xxhash.xxh3_64_intdigest(x) | 1 for x in plain] and ends.tolist() == [len(plain)] * 2
