"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Each shard owns many virtual nodes, places on a ring of 64-bit hashes; a key belongs to
the first virtual node at or after its own hash. A shard holds at most its quota of keys;
keys of an arc whose shard is full go on clockwise to the next shard with room. Quotas are
the floor or ceiling of the mean count and add up to the number of keys, so that in the
end counts differ by one at most, whatever the keys are.

Only the counts per arc, shards * virtual nodes of them, come to the driver to settle who
takes how many keys of which arc; keys are told by their rank within their arc.

Defined results: a null key or text counts as one (size 16 with a null text). Rows with
equal keys fall into one arc, where a hash of the key, the size and the checksum ranks them;
only rows that are alike in all three are told apart by their place in the table, so the
result doesn't depend on files and partitions. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARDS = 40
VIRTUAL = 64
#: Rows of an arc that are ranked together.
CELL = 50_000


def _place(shard: int, node: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big", signed=True)


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    return sorted((_place(s, v), s) for s in range(shards) for v in range(virtual))


def arc_of(hashed: Column, places: list[int]) -> Column:
    """The number of ring places below the hash, modulo their number.

    A table over the top bits gives the places before that stretch of the ring; the few
    places inside a stretch are compared one by one.
    """
    bits = max(1, (len(places) - 1).bit_length())
    edges = [(i << (64 - bits)) - (1 << 63) for i in range((1 << bits) + 1)]
    first = [bisect.bisect_left(places, e) for e in edges]
    stretches = F.lit(json.dumps([{"n": lo, "p": places[lo:hi]} for lo, hi in zip(first, first[1:], strict=False)]))
    table = F.from_json(stretches, "array<struct<n:int,p:array<bigint>>>")  # a constant, folded once
    from_least = hashed.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))  # the ring begins at the least signed number
    at = table[F.shiftrightunsigned(from_least, 64 - bits).cast("int")]
    below = at["n"] + F.size(F.filter(at["p"], lambda p: p < hashed))
    return F.pmod(below, F.lit(len(places)))


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which shard takes which ranks of an arc."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    waiting: list[tuple[int, int, int]] = []
    out = []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        k = min(hi - lo, room[shard] - used[shard])
        if k:
            out.append((arc, lo, lo + k, shard, used[shard]))
            used[shard] += k
        return lo + k

    for arc in range(len(nodes)):  # each shard first serves its own arcs
        if n := counts.get(arc, 0):
            lo = take(arc, 0, n, nodes[arc][1])
            if lo < n:
                waiting.append((arc, lo, n))
    for arc, lo, hi in waiting:  # then the overflow goes clockwise
        step = arc
        while lo < hi:
            step = (step + 1) % len(nodes)
            lo = take(arc, lo, hi, nodes[step][1])
    return out


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """Columns: key, size, text_crc32, shard, slot, ring_shard (the shard before any overflow)."""
    nodes = ring(shards, virtual)
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(F.col(key), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), arc_of(hashed, [p for p, _ in nodes]).alias("arc"), F.monotonically_increasing_id().alias("_row"))
    rows = stage(rows)  # so that a row's place is fixed
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    takes = settle(counts, nodes, shards)
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(("arc", "lo", "hi", "shard", "base"), t, strict=True)) for t in takes])), "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,base:bigint>>")))
    arcs = [{"arc": i, "ring_shard": s, "cells": counts.get(i, 0) // CELL + 1} for i, (_, s) in enumerate(nodes)]
    owner = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(arcs)), "array<struct<arc:int,ring_shard:int,cells:bigint>>")))
    plan = plan.join(F.broadcast(owner.drop("cells")), "arc")
    # a rank in an arc is the rows of the cells before and the rank in the row's own cell, so no task ranks a whole crowded arc
    rows = rows.join(F.broadcast(owner.drop("ring_shard")), "arc").withColumn("_spread", F.xxhash64(key, "size", "text_crc32")).withColumn("_cell", F.pmod("_spread", "cells"))
    # copies of one row beyond a cell's worth have cells of their own; Spark broadcasts these few hashes if they are small enough
    crowds = stage(rows.groupBy("arc", "_spread").agg(F.count("*").alias("_n")).where(F.col("_n") > CELL).select("arc", "_spread", F.expr(f"_n div {CELL} + 1").alias("_parts")))
    rows = rows.join(crowds, ["arc", "_spread"], "left").withColumn("_crowd", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.col("_spread")))
    rows = rows.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), "_parts") + 1, F.lit(0)))
    cell = ["_cell", "_crowd", "_part"]
    before = Window.partitionBy("arc").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("arc", *cell).agg(F.count("*").alias("_n")).select("arc", *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("arc", *cell).orderBy("_spread", key, "size", "text_crc32", "_row")).cast("long") - 1)
    ranked = ranked.join(offsets, ["arc", *cell]).withColumn("rank", F.col("_offset") + F.col("_r"))
    # the plan has a row for each arc and for each overflow: a bounded number, whatever the table
    taken = ranked.alias("r").join(F.broadcast(plan.alias("p")), (F.col("r.arc") == F.col("p.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return taken.select(f"r.{key}", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), "ring_shard")
