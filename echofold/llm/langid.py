"""Language identification with n-gram filters that hold one bit per language.

Training counts byte 4-grams of lower-case letters by language over all labelled texts;
an n-gram is a member of each language in which it is frequent enough, a floor that also
bounds the size of a model. Members go into a bit-sliced Bloom filter: a slot is a word
with a bit per language, and the AND of an n-gram's slots gives all languages that
contain it at once. A text's languages are scored by the share of its n-grams that they
contain, less the filter's false positives; the largest share decides.

Defined results: a null text or one without a letter is `und` with score 0; so is every
text if no labelled text was given. Ties go to the language first in sorted order. Null
languages are not learnt. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, mix64, raw, small_batches, stage

N = 4
#: An n-gram belongs to a language if it is at least this share of its n-grams
#: (with more than MEMBERS * FLOOR languages a larger one, in proportion to them), ...
FLOOR = 2e-6
#: ... and at least this part of the share it has in the language where it is most frequent.
RELATIVE = 0.05
HASHES = 3
#: The most n-grams of all languages together, which bounds what comes to the driver and is broadcast.
MEMBERS = 10_000_000
#: Bytes whose n-grams are counted at a time.
PIECE = 1 << 20

#: Bytes that count as letters stay, all others become spaces.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def words(text: bytes) -> bytes:
    """The text's words of lower-case letters, each with a space behind."""
    return b"".join(w + b" " for w in text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split())


def spaced(words: bytes) -> bytes:
    """The words with a space before as well, N bytes at least."""
    return (b" " + words).ljust(N)


def grams(t: bytes) -> np.ndarray:
    """Codes of the byte n-grams of spaced words."""
    b = np.frombuffer(t, np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.r_[a[0], b[0]], return_inverse=True)
    return code, np.bincount(at, np.r_[a[1], b[1]], len(code)).astype(np.int64)


def counted(t: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the n-grams and how often each occurs, piece by piece, so that long texts need little more room than short ones."""
    out = np.unique(grams(t[: PIECE + N - 1]), return_counts=True)
    for i in range(PIECE, len(t) - N + 1, PIECE):
        out = merged(out, np.unique(grams(t[i : i + PIECE + N - 1]), return_counts=True))
    return out


def joined(texts: Iterable[bytes]) -> Iterator[bytes]:
    """The spaced words of the texts, short texts joined to strings of about a piece."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(words(t))
        size += len(held[-1])
        if size >= PIECE:
            yield spaced(b"".join(held))
            held, size = [], 0
    if size:
        yield spaced(b"".join(held))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    slots: np.ndarray  # (size, words of 64 languages)
    false_rate: np.ndarray


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all labelled texts; each task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, (code, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for b in small_batches(batches):
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(column(b, "lang").to_pylist(), raw(b), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                for t in joined(texts):
                    held[lang] = merged(held[lang], counted(t)) if lang in held else counted(t)
            if sum(len(c) for c, _ in held.values()) > 2_000_000:
                yield from give()
        yield from give()

    rows = labelled.where("lang is not null").select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> Model:
    """The filter of all languages in labelled (text, lang), with MEMBERS n-grams at most."""
    counts = stage(count_grams(labelled))
    totals = stage(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    floor = max(FLOOR, totals.count() / MEMBERS)
    share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= floor)
    most = F.max("share").over(Window.partitionBy("gram"))
    kept = share.withColumn("most", most).where(F.col("share") >= RELATIVE * F.col("most")).select("lang", "gram").toPandas()
    languages = sorted(kept["lang"].unique())
    largest = int(kept.groupby("lang").size().max()) if languages else 1
    size = 1 << max(10, int(16 * largest - 1).bit_length())
    slots = np.zeros((size, (len(languages) + 63) // 64), np.uint64)
    fill = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        codes = kept["gram"].to_numpy(np.uint32)[(kept["lang"] == lang).to_numpy()]
        for at in slots_of(codes, size):
            slots[at, i // 64] |= np.uint64(1 << i % 64)
        fill[i] = np.mean(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))
    return Model(languages, slots, fill**HASHES)


def slots_of(codes: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix64(codes.astype(np.uint64) + np.uint64(1))
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


def decide(model: Model, text: bytes) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return "und", 0.0
    code, n = counted(spaced(words(text)))
    a, *rest = slots_of(code, len(model.slots))
    masks = model.slots[a]
    for b in rest:
        masks &= model.slots[b]
    hits = np.array([n[(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)].sum() for i in range(len(model.languages))])
    share = np.clip((hits / n.sum() - model.false_rate) / (1 - model.false_rate), 0, 1)
    best = int(np.argmax(share))
    return model.languages[best], float(share[best])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 * members of the largest language bytes a word of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [decide(shared.value, t) for t in raw(b)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
