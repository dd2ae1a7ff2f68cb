"""Benchmark decontamination by SimHash over item-sized windows.

Every text is cut into windows of as many word shingles as an item has. One pass over the
texts keeps the windows that share enough shingles with the items as a whole to reach the
similarity (by a bit filter of bounded size; that loses no match) and fingerprints them.
Windows and items are then joined on the blocks of their fingerprints' bits, one more than
the radius, so that all pairs within the radius meet. Such candidates are verified exactly,
by the weighted Jaccard similarity of their shingles' counts. Windows at the similarity can
differ by more bits than any radius that prunes, so texts and items that are not settled
yet and share enough shingles of their own are verified too: no match depends on the radius.
These meet by an item's rarest shingles alone, of which a match holds one at least, so that a
passage that many texts and items hold doesn't pair them all.

Words are compared in lower case and without signs, so decorated copies are found too.
Items stay a table: only the filter and the items' sizes go to the executors.

Defined results: a null or empty text or item matches nothing. Items of fewer words than a
shingle are one shingle of all their words. A text shorter than an item is one window.
Repeated rows and items are reported each. Empty tables give no rows. The table of texts
must be one whose scan gives the same rows in the same order each time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIds, column, discard, mix64, raw, small_batches, stage

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which blocks of eight bits find all pairs; three random pairs in a hundred agree on a block.
RADIUS = 7
#: Bits of the filter for each shingle of the items, and in all; beyond that it lets more windows through.
FILTER_SHARE, FILTER_BITS = 16, 1 << 27
#: Windows that are fingerprinted together.
WINDOWS = 4096

_SIGNS = re.compile(r"[\W_]+")
#: The same for ASCII words, as bytes.
_LOWER, _ASCII_SIGNS = bytes(range(256)).lower(), bytes(c for c in range(128) if not chr(c).isalnum())


class Words:
    """Hashes of words without signs; 0 for words of signs alone."""

    def __init__(self) -> None:
        self.ids = WordIds()
        self.hashes = np.zeros(0, np.uint64)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        w, ends = self.joined(texts)
        return np.split(w, ends[:-1])

    def joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' hashes one after another, those of signs alone left out, and where each text ends."""
        if self.ids.trim():
            self.hashes = np.zeros(0, np.uint64)
        idx = [self.ids.of(t.split()) for t in texts]
        if new := self.ids.words[len(self.hashes) :]:
            plain = [w.translate(_LOWER, _ASCII_SIGNS) if w.isascii() else _SIGNS.sub("", w.decode("utf-8", "replace").lower()) for w in new]
            self.hashes = np.r_[self.hashes, np.array([xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in plain], np.uint64)]
        w = self.hashes[np.concatenate(idx)]
        there = w != 0
        return w[there], np.r_[0, np.cumsum(there)][np.cumsum([len(i) for i in idx])]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return h


def simhash(hashes: np.ndarray) -> int:
    """Each occurrence votes, so shingles weigh as often as they occur."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhashes(h: np.ndarray, first: int, n: int, width: int) -> np.ndarray:
    """Fingerprints of the n windows of that width from the first on."""
    out = []
    for s in range(first, first + n, WINDOWS):
        k = min(WINDOWS, first + n - s)
        bits = np.unpackbits(h[s : s + k + width - 1].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        out.append(np.packbits(2 * (sums[width:] - sums[: k]) > width, axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(out)


_ITEM = "iid bigint, item_id {}, k int, m int, fp bigint, hashes array<bigint>"


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """iid (the row's place), item_id, shingle size k, number m of shingles, fingerprint and the shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in small_batches(batches, 512):
            rows = []
            for iid, item_id, w in zip(column(b, "iid").to_pylist(), column(b, "item_id").to_pylist(), words.of(raw(b)), strict=True):
                if len(w):
                    h = shingles(w, min(k, len(w)))
                    rows.append((iid, item_id, min(k, len(w)), len(h), int(np.array([simhash(h)], np.uint64).view(np.int64)[0]), h.view(np.int64)))
            if rows:
                kinds = (pa.int64(), column(b, "item_id").type, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["iid", "item_id", "k", "m", "fp", "hashes"])

    rows = items.where("text is not null").select(F.monotonically_increasing_id().alias("iid"), "item_id", "text")
    return rows.mapInArrow(run, _ITEM.format(items.schema["item_id"].dataType.simpleString()))


def shingle_filter(known: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each slot that a shingle of an item falls into, packed, and the number of slots: FILTER_BITS at most."""
    n = known.agg(F.sum("m")).first()[0] or 0
    slots = min(FILTER_BITS, 1 << max(16, (FILTER_SHARE * n).bit_length()))
    at = F.explode("hashes").alias("h")
    place = F.col("h").bitwiseAND(slots - 1) + 1  # Spark's bitmaps count from one
    rows = known.select(at).groupBy(F.bitmap_bucket_number(place).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(slots // 8, np.uint8)
    for r in rows:
        lo = (r["no"] - 1) * 4096
        part = np.frombuffer(r["bits"], np.uint8)[: len(out) - lo]
        out[lo : lo + len(part)] = part
    return out, slots


_WINDOWS = "rid bigint, k int, m int, n int, starts array<int>, fps array<bigint>, places array<int>, hashes array<bigint>"


def windows(docs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """For each text (rid) and item size (k, m): the starts of the windows that may match, their
    fingerprints, and the shingles in them that pass the filter, with their places. n: the text's shingles."""
    bits, slots = shingle_filter(known)
    sizes: dict[int, list[int]] = {}
    for r in known.select("k", "m").distinct().orderBy("k", "m").collect():
        sizes.setdefault(r["k"], []).append(r["m"])
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = Words(), held.value
        for b in small_batches(batches, 512):
            rows = []
            rids = column(b, "rid")
            w, ends = words.joined(raw(b))
            begins = np.r_[0, ends[:-1]]
            for k, lengths in sizes.items():  # all texts of a batch at once; few hold enough of any item's shingles to be looked at one by one
                all_h = shingles(w, k)
                slot = (all_h & np.uint64(slots - 1)).astype(np.int64)
                all_hits = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                all_upto = np.r_[0, np.cumsum(all_hits)]
                lasts = np.maximum(ends - k + 1, begins)  # shingles over a text's end don't count
                whole = lasts > begins
                most = np.zeros(len(ends), np.int64)
                most[whole] = all_upto[lasts[whole]] - all_upto[begins[whole]]
                for i in np.flatnonzero(most >= least * lengths[0] - 1e-9).tolist():
                    rid, h, hit = rids[i].as_py(), all_h[begins[i] : lasts[i]], all_hits[begins[i] : lasts[i]]
                    upto = np.r_[0, np.cumsum(hit)]
                    top, of = len(h), len(h)  # the most hits of any window of a width
                    for m in lengths:
                        if upto[-1] < least * m - 1e-9:
                            break
                        width = min(m, len(h))
                        if width >= of and min(top + width - of, -(-width // of) * top) < least * m - 1e-9:  # a longer window holds no more than this
                            continue
                        inside = upto[width:] - upto[: len(h) - width + 1]
                        top, of = int(inside.max()), width
                        if top < least * m - 1e-9:
                            continue
                        starts = np.flatnonzero(inside >= least * m - 1e-9)
                        cut = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
                        runs = [(int(starts[i]), int(j - i)) for i, j in zip(cut, [*cut[1:], len(starts)], strict=True)]
                        fps = np.concatenate([simhashes(h, s, n, width) for s, n in runs])
                        inside = np.zeros(len(h) + 1, np.int64)
                        for s, n in runs:
                            inside[s] += 1
                            inside[s + n - 1 + width] -= 1
                        at = np.flatnonzero(hit & (np.cumsum(inside)[:-1] > 0))
                        rows.append((rid, k, m, len(h), starts, fps.view(np.int64), at, h[at].view(np.int64)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "k", "m", "n", "starts", "fps", "places", "hashes"])

    return docs.where("text is not null").select("rid", "text").mapInArrow(run, _WINDOWS)


def _blocks(radius: int) -> list[tuple[int, int]]:
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def within_radius(found: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    """rid and iid of all windows and items of one size within the radius, by equal blocks of bits."""
    def dealt(rows: DataFrame, fp: str) -> DataFrame:
        parts: list[Column] = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit(mask).cast("bigint")) for lo, mask in _blocks(radius)]
        return rows.select("*", F.posexplode(F.array(*parts)).alias("block", "bits"))

    near = dealt(found.select("rid", "k", "m", F.explode("fps").alias("fp")).distinct(), "fp")
    own = dealt(known.select("iid", "k", "m", F.col("fp").alias("item_fp")), "item_fp")
    both = near.join(own, ["k", "m", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return both.select("rid", "iid").distinct()


def meeting(own: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """rid, iid, k and m of texts and items that have one of the item's first shingles in common, once for each such shingle.

    own: an item's shingles (iid, k, m, h) and their counts c; near: the texts' (rid, k, m, h).
    An item's shingles are put in order, those of the fewest texts first. The first are those
    whose counts together exceed what a match may miss, so that every match holds one of them.
    """
    often = stage(near.groupBy("k", "m", "h").agg(F.count("*").alias("texts")))
    ordered = own.join(often, ["k", "m", "h"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    before = F.sum("c").over(Window.partitionBy("iid").orderBy("texts", "h").rowsBetween(Window.unboundedPreceding, -1))  # of one item's shingles
    missing = F.col("m") - F.ceil(F.lit(least) * F.col("m") - 1e-9)
    first = ordered.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col("_before") <= missing) & (F.col("texts") > 0))
    return near.join(stage(first.select("iid", "k", "m", "h")), ["k", "m", "h"]).select("rid", "iid", "k", "m")


def sharing(found: DataFrame, known: DataFrame, least: float, settled: DataFrame) -> DataFrame:
    """rid and iid of texts and items of one size of which the text holds enough of the item's shingles, settled pairs left out.

    Only pairs that have met by the items' first shingles are counted in full.
    """
    own = stage(known.select("iid", "k", "m", F.explode("hashes").alias("h")).groupBy("iid", "k", "m", "h").agg(F.count("*").alias("c")))
    near = stage(found.select("rid", "k", "m", F.explode(F.array_distinct("hashes")).alias("h")))
    met = stage(meeting(own, near, least).distinct().join(settled, ["rid", "iid"], "left_anti"))
    both = met.join(own, ["iid", "k", "m"]).join(near, ["rid", "k", "m", "h"]).groupBy("rid", "iid", "m").agg(F.sum("c").alias("c"))
    return both.where(F.col("c") >= F.lit(least) * F.col("m") - 1e-9).select("rid", "iid")


def best_windows(starts: list[int], places: list[int], hashes: list[int], n: int, own: list[int], least: float) -> Iterator[tuple[int, float]]:
    """Number of the window and its similarity: the best of each run of windows that reach the similarity and overlap."""
    want, have = Counter(own), Counter()
    m = len(own)
    width = min(m, n)
    lo = hi = both = 0
    best: tuple[int, float] | None = None
    for i, s in enumerate(starts):
        while hi < len(places) and places[hi] < s + width:
            h = hashes[hi]
            both += have[h] < want[h]
            have[h] += 1
            hi += 1
        while lo < hi and places[lo] < s:
            h = hashes[lo]
            have[h] -= 1
            both -= have[h] < want[h]
            lo += 1
        if (sim := both / (width + m - both)) >= least:
            if best and s - starts[best[0]] >= width:
                yield best
                best = None
            if not best or sim > best[1]:
                best = i, sim
    if best:
        yield best


def verified(pairs: DataFrame, found: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """rid, iid and the place, length, differing bits and similarity of each match of the pairs."""
    own = known.select("iid", "k", "m", F.col("fp").alias("item_fp"), F.col("hashes").alias("own"))
    rows = pairs.join(own, "iid").join(found, ["rid", "k", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            out = []
            for r in b.to_pylist():
                for i, sim in best_windows(r["starts"], r["places"], r["hashes"], r["n"], r["own"], least):
                    differ = ((r["fps"][i] ^ r["item_fp"]) & ((1 << 64) - 1)).bit_count()
                    out.append((r["rid"], r["iid"], r["starts"][i], min(r["m"], r["n"]) + r["k"] - 1, differ, sim))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["rid", "iid", "first_word", "n_words", "bits", "similarity"])

    return rows.mapInArrow(run, "rid bigint, iid bigint, first_word bigint, n_words bigint, bits int, similarity double")


def matches(docs: DataFrame, items: DataFrame, k: int, least: float, radius: int) -> DataFrame:
    """rid and the matches of docs (rid, text)."""
    known = stage(item_shingles(items, k))
    found = stage(windows(docs, known, least))
    near = stage(verified(within_radius(found, known, radius), found, known, least))
    rest = sharing(found, known, least, near.select("rid", "iid").distinct())
    out = stage(near.unionByName(verified(rest, found, known, least)).join(known.select("iid", "item_id"), "iid"))
    discard(known, found, near)
    return out


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, first_word, n_words (words with signs alone don't count), bits and similarity of each match."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    found = matches(rows, items, k, least, radius)
    return rows.select("rid", "doc_id").join(found, "rid").select("doc_id", "item_id", "first_word", "n_words", "bits", "similarity")


def clean(docs: DataFrame, items: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that match no item."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"))
    found = matches(rows.select("rid", F.col("row")["text"].alias("text")), items, k, least, radius)
    left = rows.join(found.select("rid").distinct(), "rid", "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
