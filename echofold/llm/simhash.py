"""SimHash fingerprints and their near-duplicate groups, by a self-join of binary tries.

Equal fingerprints are collapsed first, so a group of copies is one node however large it
is. The distinct fingerprints are dealt out by the blocks of their bits that must agree:
with b blocks, two fingerprints within r bits agree on b - r of them at least. In each
bucket the fingerprints form a binary trie; pairs of its nodes are walked down together,
level by level, the differing bits adding up, and a pair of nodes is dropped once they
exceed the radius. A bucket returns a spanning forest of the links it has found, not all
pairs; the components of these links are then found over the whole table.

A radius of 4 bits holds few of the pairs whose shingle sets have a Jaccard similarity of
0.8 (they differ in about 10 bits), and no trie can be walked with such a budget over a
large table. near_copies() therefore goes on where the radius ends: texts that agree on a
band of min-hashes are compared exactly, by hubs, so that no bucket emits all its pairs.

Defined results: a null, empty or white text has the fingerprint zero and links like any
other. Repeated rows and ties fall into one node. A null doc_id takes part, but is no
representative unless its component has no other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, mix64, raw, small_batches, stage
from .components import components

SEED = 42
#: Bands of min-hashes: of pairs at a similarity of 0.8, 1 in 60,000 agrees on none of them.
BANDS, ROWS = 60, 8
_STEPS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
#: Shingles that are joined and hashed together.
PIECE = 8_192
#: Fingerprints of a bucket whose trie one task walks.
BUCKET = 50_000
#: Rounds of hubs before the texts of buckets with several components are compared by their rarest shingles.
HUB_ROUNDS = 4


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    out = np.empty(len(w) - k + 1, np.uint64)
    for i in range(0, len(out), PIECE):  # the shingles of a very long text are never all held as strings
        part = w[i : i + PIECE + k - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(k)), strict=False))
        out[i : i + PIECE] = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(part) - k + 1)
    return out


def fingerprint(text: bytes, k: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    return fingerprint_of(shingle_hashes(text, k))


def fingerprint_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):  # a bit more memory than the hashes themselves
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fingerprint, a signed 64-bit number, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            f = np.fromiter((fingerprint(t, shingle) for t in raw(b)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(f)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def block_count(n: int, radius: int) -> int:
    """Blocks so that the bits that must agree tell about as many buckets as there are fingerprints."""
    b = radius + 1
    while b < 2 * radius and 64 * (b - radius) // b < n.bit_length() - 3:
        b += 1
    return b


def agreeing_blocks(blocks: int, radius: int) -> list[int]:
    """Masks of the bits in each choice of blocks - radius blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def trie_links(fps: np.ndarray, bucket: np.ndarray, radius: int, room: int = 400_000) -> np.ndarray:
    """For each fingerprint the place of its group's first one, over links within the same bucket.

    fps are sorted within equal buckets. A trie's node is a range of the sorted array; a
    frontier of node pairs goes down one bit a level. When the frontier would outgrow the
    room, it is halved and its halves are walked one after the other.
    """
    n = len(fps)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.empty(0, np.int64)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    z = starts[many]
    todo = [(63, z, ends[many], z, ends[many], np.zeros(len(z), np.int64))] if len(z) else []
    while todo:
        bit, a0, a1, b0, b1, d = todo.pop()
        if bit < 0:
            unite(label, a0, b0)
            continue
        if len(d) > room:
            h = len(d) // 2
            todo += [(bit, *(x[h:] for x in (a0, a1, b0, b1, d))), (bit, *(x[:h] for x in (a0, a1, b0, b1, d)))]
            continue
        one = (fps >> np.uint64(bit) & np.uint64(1)).astype(np.int64)
        ones = np.r_[0, np.cumsum(one)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the ones begin
        same = a0 == b0
        parts = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), tuple(x[~same] for x in (am, a1, b0, bm, d + 1))]
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (d <= radius) & (a0 < a1) & (b0 < b1) & ~((a0 == b0) & (a1 - a0 < 2))
        if todo and keep.any():  # nodes that are of one group already need no more links
            a0, a1, b0, b1, d = (x[keep] for x in (a0, a1, b0, b1, d))
            turns = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            keep = (label[a0] != label[b0]) | (turns[a1 - 1] != turns[a0]) | (turns[b1 - 1] != turns[b0])
        if keep.any():
            todo.append((bit - 1, *(x[keep] for x in (a0, a1, b0, b1, d))))
    return label


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each link the smaller of their groups' labels until nothing changes."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def closer(used: int, radius: int) -> list[int]:
    """Masks that add to used two of radius + 2 blocks of its other bits: two fingerprints within the radius agree on one such mask."""
    free = [i for i in range(64) if not used >> i & 1]
    n = radius + 2
    blocks = [sum(1 << i for i in free[len(free) * j // n : len(free) * (j + 1) // n]) for j in range(n)]
    return [used | a | b for a, b in combinations(blocks, 2)]


def dealt(rows: DataFrame, choices: dict[int, list[int]]) -> DataFrame:
    """Each fingerprint (fp, used) once for each choice of bits that must agree, with its own bits there."""
    masks = F.lit(None).cast("array<bigint>")
    for used, more in choices.items():
        masks = F.when(F.col("used") == F.lit(_signed(used)).cast("bigint"), F.array(*(F.lit(_signed(m)).cast("bigint") for m in more))).otherwise(masks)
    return rows.select("fp", F.explode(masks).alias("used")).withColumn("part", F.col("fp").bitwiseAND(F.col("used")))


def buckets(distinct: DataFrame, radius: int, count: int) -> DataFrame:
    """fp, used and part: fingerprints with the buckets in which all their links lie.

    A bucket of more than BUCKET fingerprints (a large family that agrees on these bits) is a
    node of the tries that is dealt out again by more bits, until it is small or has so few
    bits left that it must be.
    """
    keyed = dealt(distinct.select("fp", F.lit(0).cast("bigint").alias("used")), {0: agreeing_blocks(block_count(count, radius), radius)})
    done = []
    while True:
        large = stage(keyed.groupBy("used", "part").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("used", "part"))
        masks = [r["used"] % (1 << 64) for r in large.select("used").distinct().collect()]  # as many as there are choices of blocks
        choices = {m: closer(m, radius) for m in masks if 64 - m.bit_count() > 16}
        if not choices:
            break
        again = stage(large.where(F.col("used").isin([_signed(m) for m in choices])))
        done.append(keyed.join(again, ["used", "part"], "left_anti").select("fp", "used", "part"))
        keyed = stage(dealt(keyed.join(again, ["used", "part"], "left_semi"), choices))
    for x in done:
        keyed = keyed.unionByName(x)
    return keyed


def links(distinct: DataFrame, radius: int, count: int) -> DataFrame:
    """A spanning forest (src > dst) in each bucket of the links within the radius."""
    keyed = buckets(distinct, radius, count)
    tasks = max(8, count * len(agreeing_blocks(block_count(count, radius), radius)) // 200_000)
    keyed = keyed.withColumn("slot", F.pmod(F.xxhash64("used", "part"), F.lit(tasks * 32)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fps, used, part = rows["fp"].to_numpy().view(np.uint64), rows["used"].to_numpy(), rows["part"].to_numpy()
        order = np.lexsort((fps, part, used))
        fps, used, part = fps[order], used[order], part[order]
        bucket = np.cumsum(np.r_[0, (used[1:] != used[:-1]) | (part[1:] != part[:-1])])
        label = trie_links(fps, bucket, radius)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"src": fps[linked].view(np.int64), "dst": fps[label[linked]].view(np.int64)})

    return keyed.groupBy("slot").applyInPandas(run, "src bigint, dst bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over links within the radius."""
    fps = stage(fingerprints(docs, shingle))
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, radius, distinct.count()))
    nodes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    nodes = stage(nodes)
    least = stage(nodes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return fps.join(nodes.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least value of the shingles' hashes under each of the BANDS * ROWS steps."""
    out = np.full(len(_STEPS), np.iinfo(np.uint32).max, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(out, (_STEPS[:, None] * short[None, i : i + 2048]).min(1), out=out)
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and, for each band, a key of its min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            least = np.array([least_hashes(shingle_hashes(t, shingle)) for t in raw(b)], np.uint64).reshape(-1, BANDS, ROWS)
            keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(least), 1))
            for r in range(ROWS):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, :, r])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), bands], ["doc_id", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, bands array<bigint>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and the distinct hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in raw(b)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, hashes array<bigint>")


def sharing_rare(sets: DataFrame, least: float, part: str = "doc_id") -> DataFrame:
    """Pairs (doc_id > hub) of texts of different parts that have one of their rarest shingles in common.

    With all shingles in one order, rarest first, two texts of that similarity have one in
    common among the first n - least * n + 1 of the longer and the first
    n - 2 * least / (1 + least) * n + 1 of the shorter. Passages that many texts hold come
    last in the order, so they pair few. Shingles of a single text count, but needn't be held.
    A shingle's parts are paired before their texts, so texts of one part never meet. Two
    texts have no more in common than follows the first such shingle in either's order, so
    pairs that meet late in it, as by a line that is most of both, are left out: a pair at
    the similarity meets at its first common shingle too, where this leaves room.
    """
    room = least / (1 + least) - 1e-9
    words = sets.select("doc_id", F.col(part).alias("part"), F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    # staged, so that the join is a plain shuffled one, which Spark can split at a frequent shingle
    shared = stage(words.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1"))
    ranked = words.join(shared, "h").groupBy("doc_id", "part", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "h"))).alias("by"))
    alone = F.col("n") - F.size("by")

    def first(share: float) -> Column:  # a little below, so that no rounding of the product leaves one out
        return F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1 - alone

    held = F.slice("by", F.lit(1), F.greatest(first(least), F.lit(0)).cast("int"))
    rare = ranked.select("doc_id", "part", "n", alone.alias("alone"), F.posexplode(held).alias("place", "at"), first(2 * least / (1 + least)).alias("few"))
    rest = F.col("n") - F.col("alone") - F.col("place")  # shingles from this one on
    rare = stage(rare.select("doc_id", "part", "n", "at.h", (F.col("place") < F.col("few")).alias("few"), rest.alias("rest")).where(F.col("rest") >= room * (1 + least) * F.col("n")))
    short = rare.where("few").select("h", F.col("part").alias("p"), F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("rest").alias("rest_a"))
    other = rare.select("h", F.col("part").alias("q"), F.col("doc_id").alias("b"), "n", F.col("rest").alias("rest_b"))
    least_p = stage(short.groupBy("h", "p").agg(F.min("m").alias("m0"), F.max("m").alias("m1"), F.max("rest_a").alias("rest_p")))
    least_q = stage(other.groupBy("h", "q").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("rest_b").alias("rest_q")))
    may = (F.col("p") != F.col("q")) & (F.col("m1") >= (least - 1e-9) * F.col("n0")) & (F.col("m0") <= F.col("n1")) & (F.least("rest_p", "rest_q") >= room * (F.col("m0") + F.col("n0")))
    met = stage(least_p.join(least_q, "h").where(may).select("h", "p", "q"))
    met = met.join(short, ["h", "p"]).join(other, ["h", "q"])
    met = met.where((F.col("m") >= (least - 1e-9) * F.col("n")) & F.expr("m < n or m = n and a < b") & (F.least("rest_a", "rest_b") >= room * (F.col("m") + F.col("n"))))
    return met.select(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("hub")).distinct()


def resembling(docs: DataFrame, shingle: int, least: float, ties: DataFrame | None = None) -> DataFrame:
    """Links (src, dst) of texts whose shingle sets have that Jaccard similarity at least.

    With the given ties, they join what all such links between texts of a common band join.
    First each bucket of a band compares one member, the hub, with all others: the one that
    meets most texts over all its buckets, as the middle of a group of edited copies does.
    Those that resemble it leave the rounds, the others go on to the next one without the
    hub, so a group of n copies costs about n comparisons. That leaves links of texts that
    have left, so afterwards all texts of buckets that still hold several components, hubs
    and those that have left included, are compared with those of other components where
    sharing_rare() pairs them, which loses no link.
    """
    drawn = stage(sketches(docs, shingle))
    # texts that agree on all bands are copies: the smallest stands for them
    copies = stage(drawn.groupBy(F.xxhash64("bands").alias("all"), F.element_at("bands", 1).alias("one")).agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
    told = drawn.select("doc_id", F.xxhash64("bands").alias("all"), F.element_at("bands", 1).alias("one"))
    links = [stage(told.join(copies.where("n > 1"), ["all", "one"]).where("doc_id <> head").select(F.col("doc_id").alias("src"), F.col("head").alias("dst")))]
    keys = drawn.join(copies.select(F.col("head").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key"))
    often = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    reach = keys.join(often, "key").groupBy("doc_id").agg(F.sum("n").alias("reach"), F.collect_list("key").alias("keys"))
    buckets = keys = stage(reach.select("doc_id", "reach", F.explode("keys").alias("key")))
    sets = stage(shingle_sets(docs.join(keys.select("doc_id").distinct(), "doc_id", "left_semi"), shingle))
    discard(often)

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("hub"), F.col("hashes").alias("others")), "hub")
        shared = F.size(F.array_intersect("hashes", "others"))
        # a little below, so that no rounding of the quotient loses a pair at the bound itself
        both = both.where(shared >= (least - 1e-9) * (F.size("hashes") + F.size("others") - shared))
        return stage(both.select(F.col("doc_id").alias("src"), F.col("hub").alias("dst")))

    for _ in range(HUB_ROUNDS):
        hubs = stage(keys.groupBy("key").agg(F.min(F.struct(-F.col("reach"), "doc_id")).alias("hub")).select("key", "hub.doc_id").withColumnRenamed("doc_id", "hub"))
        faced = stage(keys.join(hubs, "key").where("doc_id <> hub").select("key", "doc_id", "reach", "hub"))
        pairs = stage(faced.select("doc_id", "hub").distinct())
        links.append(alike(pairs))
        rest = stage(faced.join(links[-1].select("src").distinct(), F.col("doc_id") == F.col("src"), "left_anti").select("key", "doc_id", "reach"))
        discard(hubs, faced, pairs, *([keys] if keys is not buckets else []))
        keys = rest
        if keys.isEmpty():
            break
    found = links[0] if ties is None else links[0].unionByName(ties)
    for x in links[1:]:
        found = found.unionByName(x)
    roots = stage(components(found))
    placed = stage(buckets.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("part")))
    torn = stage(placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key"))
    unsettled = stage(placed.join(torn, "key").select("doc_id", "part").distinct())
    pairs = stage(sharing_rare(sets.join(unsettled, "doc_id"), least, "part"))
    discard(keys, placed, torn, *([buckets] if keys is not buckets else []))
    return found.unionByName(alike(pairs))


def near_copies(docs: DataFrame, shingle: int = 5, radius: int = 4, least: float = 0.8) -> DataFrame:
    """doc_id, fp and component_id: groups over links within the radius and over those of texts of that similarity.

    doc_ids must differ and not be null. No two texts of different groups that agree on a
    band are of that similarity.
    """
    near = stage(near_duplicates(docs, shingle, radius))
    ties = near.where("doc_id <> component_id").select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst"))
    roots = stage(components(resembling(docs, shingle, least, ties)))
    out = near.join(roots, near.doc_id == roots.node, "left")
    return out.select("doc_id", "fp", F.coalesce("root", "doc_id").alias("component_id"))
