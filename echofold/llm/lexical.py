"""Ranked lexical search: an index of compressed postings in shards, merged document by document.

A shard holds the documents that a task has read up to a bound of text; its documents are
numbered by doc_id, and a row for each of its terms holds the numbers' gaps and the term's
occurrences as variable-length bytes. A shard's documents and their lengths are one more row.
So an index is built without a shuffle, and its rows grow with the input alone.

To search, document frequencies are summed over shards for the items' terms only. For each
item a shard's postings are merged by a heap of cursors in the order of documents; the k best
so far are kept in a heap by score, then doc_id. Terms whose greatest contributions together
can't lift a document above the worst of these leave the heap of cursors and are only looked
up for documents that the other terms bring (the scores stay exact). Spark ranks the shards'
k best of each item. Items go to the tasks in blocks of bounded size.

Defined results: a null or empty text, or one without terms, counts nowhere and is never
found. Repeated rows are documents of their own, and repeated items items of their own.
Equal scores go by doc_id, a null one last. An item without terms, or whose terms no document
holds, has no rows; an empty table gives none. Terms of any length count. Columns other than
doc_id, item_id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush, heapreplace
from math import floor, log
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordIds, column, discard, raw, small_batches, stage

#: Bytes of text that a shard's documents have, but for the last of them.
SHARD_BYTES = 32 << 20
#: Bytes of items that are searched at once.
ITEM_BYTES = 4 << 20
#: Postings that are compressed at once, and bytes of text that are cut into terms at once.
POSTINGS = 1 << 18
PIECE = 1 << 22
#: Terms by their characters, as in the contract, and the same by UTF-8 bytes: signs are blanks and A-Z small letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    plain = text.translate(_BYTES)
    at = 0
    while len(plain) - at > PIECE:
        cut = plain.rfind(b" ", at, at + PIECE)
        if cut <= at:
            cut = plain.find(b" ", at + PIECE)
            if cut < 0:
                break
        yield plain[at:cut].split()
        at = cut
    yield plain[at:].split()


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers as bytes of seven bits, the lowest first, the eighth bit set on all but a number's last; and where each number ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> np.uint64(7 * k) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        seven = (values[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[ends[has] - size[has] + k] = seven | (size[has] > k + 1).astype(np.uint8) << 7
    return out.tobytes(), ends


def unpack(data: bytes) -> np.ndarray:
    """The numbers that pack() has written."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - first + 1
    out = np.zeros(len(last), np.int64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (b[first[has] + k] & 127).astype(np.int64) << 7 * k
    return out


class Shard:
    """Documents in memory until they are written."""

    def __init__(self) -> None:
        self.words, self.bytes = WordIds(), 0
        self.ids: list[pa.Scalar] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_id: pa.Scalar, text: bytes) -> None:
        self.bytes += len(text)
        counts: Counter[int] = Counter()
        for some in terms(text):
            counts.update(map(self.words.__getitem__, some))
        if counts:
            self.ids.append(doc_id)
            self.lengths.append(counts.total())
            self.found.append(np.fromiter(counts.keys(), np.int32, len(counts)))
            self.times.append(np.fromiter(counts.values(), np.int64, len(counts)))

    def rows(self, number: int, id_type: pa.DataType, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = pa.array([x.as_py() for x in self.ids], id_type)
        order = np.asarray(pc.sort_indices(ids, null_placement="at_end"))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        head = [[number], [None], [len(order)], [int(lengths.sum())], [pack(lengths)[0]], pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(id_type))]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(head, schema, strict=True)], schema=schema)
        term, tf = np.concatenate(self.found), np.concatenate(self.times)
        doc = np.repeat(place.astype(np.int32), [len(x) for x in self.found])
        self.found.clear(), self.times.clear()
        by = np.lexsort((doc, term))
        term, tf, doc = term[by], tf[by], doc[by]
        del by
        first = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])
        at = 0
        while at < len(first) - 1:  # terms of so many postings at a time, one term at least
            to = max(at + 1, int(np.searchsorted(first, first[at] + POSTINGS, "right")) - 1)
            yield self._terms(number, term, tf, doc, first[at : to + 1], id_type, schema)
            at = to

    def _terms(self, number: int, term: np.ndarray, tf: np.ndarray, doc: np.ndarray, first: np.ndarray, id_type: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
        """Rows of the terms whose postings begin at first; its last is the end."""
        own = slice(first[0], first[-1])
        start, df = first[:-1] - first[0], np.diff(first)
        gap = np.diff(doc[own], prepend=0).astype(np.int64)
        gap[start] = doc[own][start]
        data, ends = pack(np.stack([gap, tf[own]], 1).reshape(-1))
        stops = ends[2 * (start + df) - 1]
        strings = pa.array([self.words.words[t] for t in term[first[:-1]].tolist()], pa.binary()).cast(pa.string(), safe=False)
        postings = pa.BinaryArray.from_buffers(pa.binary(), len(df), [None, pa.array(np.concatenate([[0], stops]), pa.int32()).buffers()[1], pa.py_buffer(data)])
        cols = [pa.array(np.full(len(df), number)), strings, pa.array(df), pa.array(np.add.reduceat(tf[own], start)), postings, pa.nulls(len(df), pa.list_(id_type))]
        return pa.RecordBatch.from_arrays(cols, schema=schema)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of the documents' texts, not staged.

    A row of a term: shard, term, n (documents of the shard that hold it), tokens (its
    occurrences) and postings. The row of a shard has a null term: n documents with terms,
    all their tokens, their lengths as postings, and their ids in doc_ids.
    """
    id_type = docs.schema["doc_id"].dataType
    kind = id_type.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, schema, arrow = TaskContext.get().partitionId() << 32, Shard(), None, None
        for b in small_batches(batches):
            own = column(b, "doc_id")
            arrow = own.type
            schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("tokens", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(arrow))])
            for doc_id, text in zip(own, raw(b), strict=True):
                shard.add(doc_id, text)
                if shard.bytes >= shard_bytes:
                    if shard.ids:
                        yield from shard.rows(number, arrow, schema)
                        number += 1
                    shard = Shard()
        if shard.ids:
            yield from shard.rows(number, arrow, schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"shard bigint, term string, n bigint, tokens bigint, postings binary, doc_ids array<{kind}>")


def merge(lists: list[tuple[list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best documents with a score above 0, the best first.

    lists: for each term the documents in order and what it adds to each one's score. Equal
    scores go to the lower document.
    """
    lists = sorted((x for x in lists if x[0]), key=lambda x: max(x[1]))
    bounds, n = [], len(lists)
    for _, adds in lists:
        bounds.append((bounds[-1] if bounds else 0) + max(adds))
    docs, adds = [x[0] for x in lists], [x[1] for x in lists]
    ends = list(map(len, docs))
    at = [0] * n
    first = 0  # the lists before this one can't lift a document into the best by themselves
    cursors = [docs[i][0] * n + i for i in range(n)]
    heapify(cursors)
    best: list[tuple[int, int]] = []
    worst = 0
    while cursors:
        doc, score = cursors[0] // n, 0
        while cursors:
            d, i = divmod(cursors[0], n)
            if d != doc:
                break
            p = at[i]
            score += adds[i][p]
            at[i] = p = p + 1
            if p < ends[i]:
                heapreplace(cursors, docs[i][p] * n + i)
            else:
                heappop(cursors)
        for i in range(first - 1, -1, -1):
            if score + bounds[i] <= worst:
                break
            at[i] = p = bisect_left(docs[i], doc, at[i])
            if p < ends[i] and docs[i][p] == doc:
                score += adds[i][p]
        if score <= worst:
            continue  # documents come in order, so one of an equal score comes too late
        if len(best) < k:
            heappush(best, (score, -doc))
        else:
            heapreplace(best, (score, -doc))
        if len(best) == k and best[0][0] > worst:
            worst, was = best[0][0], first
            while first < n and bounds[first] <= worst:
                first += 1
            if first > was:
                cursors = [c for c in cursors if c % n >= first]
                heapify(cursors)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def weight(df: int, documents: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def _block(index: DataFrame, asked: DataFrame, documents: int, tokens: int, k: int, item_type: T.DataType) -> DataFrame:
    """item, item_id, doc_id, score: of each item of one block the k best of each shard."""
    spark = index.sparkSession
    items = [(r["_item"], r["item_id"], r["terms"]) for r in asked.select("_item", "item_id", "terms").toLocalIterator()]
    wanted = F.broadcast(asked.select(F.explode("terms").alias("term")).distinct())  # of a block of bounded size
    held = index.join(wanted, "term", "left_semi")
    weights = {r["term"]: weight(r["df"], documents) for r in held.groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator()}
    shared = spark.sparkContext.broadcast((items, weights))
    id_type = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("_item", T.LongType()), T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        own_items, own_weights = shared.value
        head = rows.filter(pc.is_null(rows["term"]))
        ids = head["doc_ids"].combine_chunks().flatten()
        m = 10 + 90 * unpack(head["postings"][0].as_py()) * documents // tokens
        lists: dict[str, tuple[list[int], list[int]]] = {}
        found = rows.filter(pc.is_valid(rows["term"]))
        for term, data in zip(found["term"].to_pylist(), found["postings"].to_pylist(), strict=True):
            both = unpack(data).reshape(-1, 2)
            doc, tf = np.cumsum(both[:, 0]), both[:, 1]
            lists[term] = doc.tolist(), (own_weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))).tolist()
        out: list[tuple[int, Any, int, int]] = []
        for number, item_id, own in own_items:
            out += [(number, item_id, doc, score) for score, doc in merge([lists[t] for t in own if t in lists], k)]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        made = pa.table({"_item": pa.array(cols[0], pa.int64()), "doc_id": ids.take(pa.array(cols[2], pa.int64())), "score": pa.array(cols[3], pa.int64())})
        return made.add_column(1, "item_id", pa.array(cols[1], to_arrow(item_type)))

    heads = index.where("term is null")
    return heads.unionByName(held.select(*index.columns)).groupBy("shard").applyInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents. index is a staged or stored index."""
    found = F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0)))
    asked = stage(items.select("item_id", found.alias("terms")).where(F.size("terms") > 0).withColumn("_item", F.monotonically_increasing_id()))
    whole = index.where("term is null").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    size = asked.agg(F.sum(F.length(F.array_join("terms", " "))).alias("b")).first()["b"] or 0
    kind = items.schema["item_id"].dataType
    blocks = -(-size // ITEM_BYTES) or 1
    passes = []
    if whole["n"] is None or not size:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast(index.schema["doc_ids"].dataType.elementType).alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == i)
        each = _block(index, part, whole["n"], whole["tokens"], k, kind)
        order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        passes.append(stage(ranked) if blocks > 1 else ranked)
    out = stage(reduce(DataFrame.unionByName, passes))
    discard(asked, *(passes if blocks > 1 else []))
    return out.select("item_id", "rank", "doc_id", "score")
