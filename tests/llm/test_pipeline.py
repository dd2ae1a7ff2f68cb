"""The pipeline's stages, one after another, against what each must do to its own input."""

import public_tokenizers

import corpus_pipeline as cp
from echofold.llm import decontam, packing, simhash
from echofold.llm.common import stage

from . import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, function in cp.STAGES:
        before = docs
        docs = stage(function(spark, before, sf_dir))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        kept.append((name, before, docs))
    by = {n: (a, b) for n, a, b in kept}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    a, b = by["quality classifier"]
    left = {r.doc_id for r in b.collect()}
    right = [(d in left) == bool(q) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.9
    a, b = by["near-duplicates"]
    rows = a.collect()
    left = {r.doc_id: brute.shingle_set(r.text, 5) for r in b.collect()}
    for r in rows:
        if r.doc_id not in left:
            own = brute.shingle_set(r.text, 5)
            assert any(brute.jaccard(own, brute.shingle_set(x.text, 5)) >= 0.8 or (brute.fingerprint(r.text, 5) ^ brute.fingerprint(x.text, 5)).bit_count() <= 4 for x in rows if x.doc_id != r.doc_id)
    assert not [1 for x in left for y in left if x < y and brute.jaccard(left[x], left[y]) >= 0.8]
    assert simhash.near_duplicates(b, 5, 4).where("doc_id <> component_id").count() == 0
    a, b = by["benchmark decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.contaminated(b, items).count() == 0 and b.count() < a.count()
    a, b = by["personal data"]
    assert a.count() == b.count()
    clean = {r.doc_id: r.text for r in a.collect()}
    for r in b.collect():
        assert not brute.base_spans(r.text)
        if not brute.base_spans(clean[r.doc_id]):
            assert r.text == clean[r.doc_id]
    a, b = by["packing"]
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect()}


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0


def test_words_kept_are_bounded_and_frequent_ones_stay_known():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, learnt = packing.WordTokens(path, 100_000), []
    tokenize = words.tokenize
    words.tokenize = lambda ws: (learnt.extend(ws), tokenize(ws))
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [b"often " + " ".join(f"{(500 * i + j) * 7919:09d}".translate(letters) for j in range(500)).encode() for i in range(1000)]
    ids = list(words.encode(texts))
    assert len(words.ids) + len(words.past) < 400_000  # of 500,001 words
    assert learnt.count(b"often") == 1
    for i in (0, 500, 999):
        assert ids[i].tolist() == words.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids
