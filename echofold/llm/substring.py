"""Exact substring dedup: suffix buckets over sampled positions, refined by bucket pointers.

Two equal windows of `length` bytes hold the same q-grams, so they hold the same least one
(by hash): it is enough to bucket the suffixes at those positions, one byte in about 85. An
anchor's initial bucket is its q-gram. Buckets with a single member hold no repeat and are
dropped. The others are refined by the bucket identifiers of later offsets. A place's
identifier over 2n bytes is made of those over n bytes at the place and n places on, so
each doubling reuses what the one before has named, from single bytes up to 256; a stretch
of n to 2n bytes is named by the identifiers at its beginning and n bytes before its end.

A bucket of what all windows of a piece have in common splits by the identifier of what they
span together. Members whose span is shared are repeats as a whole; a bucket that didn't
split is settled; in the others one member of each refined bucket goes on to the next step,
where a piece is a thirteenth of the one before: 169 windows, 13, 1. A single window is both
its common part and its span, so the last step is exact, up to identifiers of 128 bits.

All refinement steps are grouped counts and equi-joins; no bucket is ever gathered in one
task, however many members it has.

Defined results: a null text is an empty one; texts shorter than the length lose nothing.
Rows are told apart by their place in the table, so repeated rows are repeats of each
other and are removed in full. Null doc_ids are rows like others. An empty table gives no
rows. The table must be one whose scan gives the same rows in the same order each time
(stored files, or a staged table).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, mix64, raw, stage

LENGTH = 200
Q = 32
#: Windows that hold a given q-gram: 13 pieces of 13 windows.
SIDE = 13
#: Window starts that are looked at together.
STRETCH = 1 << 23
WINDOWS = SIDE * SIDE
assert LENGTH - Q + 1 == WINDOWS

#: Two independent names of each byte; the first alone names q-grams.
_BYTES = mix64(np.arange(1, 513, dtype=np.uint64)).reshape(2, 256)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of short texts whose anchors are found together.
TOGETHER = 1 << 16
#: The most bytes of a stretch of text around anchors, and of stretches that are named together.
PART, NAMED = 1 << 20, 1 << 21


def identifiers(text: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Identifiers of the n bytes (a power of two) from each place on, by doubling."""
    ids, m = _BYTES[lane][text], 1
    while m < n:
        ids = ids[:-m] * _STEP + ids[m:]
        ids ^= ids >> np.uint64(29)
        m *= 2
    return ids * np.uint64(0xD6E8FEB86659FD93)


def qgram_ids(text: np.ndarray) -> np.ndarray:
    return identifiers(text, Q)


def least_places(ids: np.ndarray) -> np.ndarray:
    """For each window of WINDOWS consecutive places, the first place of its least identifier.

    The minimum is taken over numbers that hold the identifier's upper bits and the place,
    so that of equal ones the first wins, wherever in a text the window lies.
    """
    w, n = WINDOWS, len(ids) - WINDOWS + 1
    bits = 24
    rows = -(-len(ids) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ids)] = ids >> np.uint64(bits) << np.uint64(bits) | np.arange(len(ids), dtype=np.uint64)
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, bucket identifiers and the packed range of offsets at which windows chose the place.

    A text of over 16 MB is taken in stretches that overlap by a window, so that all texts
    compare the same bits.
    """
    if len(text) < LENGTH:
        e = np.empty(0, np.int64)
        return e, e, e
    parts = []
    for at in range(0, len(text) - LENGTH + 1, STRETCH):
        ids = qgram_ids(np.frombuffer(text[at : at + STRETCH + LENGTH - 1], np.uint8))
        place = least_places(ids)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        x = place[first]
        parts.append((x + at, ids[x].view(np.int64), (x - last) << 8 | (x - first)))
    x, g, o = (np.concatenate(c) for c in zip(*parts, strict=True))
    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])  # a run that two stretches share is one
    end = np.r_[new[1:], len(x)] - 1
    return x[new], g[new], (o[end] >> 8) << 8 | (o[new] & 255)


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, bucket identifier and packed offsets of the anchors of texts laid end to end, 16 MB at most.

    Windows that reach into the next text are left out, so that each text's anchors are its own.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.maximum(sizes - LENGTH + 1, 0)
    if not starts.any():
        return (np.empty(0, np.int64),) * 4
    ids = qgram_ids(np.frombuffer(b"".join(texts), np.uint8))
    begin = np.cumsum(sizes) - sizes
    window = np.flatnonzero(np.repeat(np.tile([True, False], len(sizes)), np.column_stack([starts, sizes - starts]).ravel()))
    place = least_places(ids)[window]
    new = np.flatnonzero(place[1:] != place[:-1]) + 1
    x, first, last = place[np.concatenate([[0], new])], window[np.concatenate([[0], new])], window[np.concatenate([new, [len(place)]]) - 1]
    row = np.searchsorted(begin, x, "right") - 1
    return row, x - begin[row], ids[x].view(np.int64), (x - last) << 8 | (x - first)


def numbered(docs: DataFrame) -> DataFrame:
    """rid (the row's place), doc_id and the text's bytes."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid = column(b, "rid").to_numpy()
        found, held = [], 0
        own = column(b, "text").to_pylist()
        sizes = np.array([len(t) for t in own])
        group, long = np.cumsum(sizes) // TOGETHER, sizes > TOGETHER  # a long text is one of its own
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | long[1:] | long[:-1]) + 1), len(own)]
        for i, end in zip(cuts, cuts[1:], strict=False):
            if end - i == 1:
                x, g, o = anchors(own[i])
                row = np.zeros(len(x), np.int64)
            else:
                row, x, g, o = anchors_of(own[i:end])
            found.append((rid[i:end][row], x, o, g))
            held += len(x)
            if held >= 100_000 or end == len(own):
                c = [np.concatenate(y) for y in zip(*found, strict=True)]
                found, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1].astype(np.int32)), pa.array(c[2].astype(np.int32)), pa.array(c[3])], ["rid", "x", "o", "g"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the stretches around its anchors, and its length."""
    for b in batches:
        texts = column(b, "text").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        at, row = _lists(column(b, "anchors"))
        x = at.field("x").to_numpy().astype(np.int64)
        order = np.lexsort((x, row))
        row, x = row[order], x[order]
        lo, hi = np.maximum(x - WINDOWS + 1, 0), np.minimum(x + LENGTH, sizes[row])
        first = np.ones(len(x), bool)
        first[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(x))
        for k in np.flatnonzero(hi[end - 1] - lo[begin] > PART):
            since = lo[begin[k]]
            for i in range(begin[k], end[k]):
                if hi[i] - since > PART:
                    first[i], since = True, lo[i]
        begin = np.flatnonzero(first)
        row, lo, hi = row[begin], lo[begin], hi[np.append(begin[1:], len(x)) - 1]
        data = [texts[r][a:e] for r, a, e in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)]
        parts = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(data, pa.binary())], ["at", "bytes"])
        cuts = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([column(b, "rid"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(cuts, parts), column(b, "anchors")], ["rid", "size", "parts", "anchors"])


_ROW = "rid bigint, x int, o int, piece int, i bigint, u1 bigint, u2 bigint"


def _lists(col: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The elements of a list column, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    return col.flatten(), np.repeat(np.arange(len(col)), sizes)


def _pieces(step: int, o: np.ndarray, piece: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the anchors' windows (offsets o): anchor, number, nearest and farthest offset of each piece."""
    least, most, width = o >> 8, o & 255, (WINDOWS, SIDE, 1)[step]
    if step == 2:
        least, most = np.maximum(least, piece * SIDE), np.minimum(most, piece * SIDE + SIDE - 1)
    first, last = least // width, most // width
    n = np.maximum(last - first + 1, 0)
    of = np.repeat(np.arange(len(o)), n)
    p = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, p, p * width, p * width + width - 1


def _level(step: int):
    """Rows of step 0 (whole anchors), 1 (pieces of 13 windows) or 2 (windows), with common part i and span u."""
    n = 256 if step == 0 else 128
    bits = np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, size = column(b, "rid").to_numpy(), column(b, "size").to_numpy()
            parts, own = _lists(column(b, "parts"))
            anchors, of = _lists(column(b, "anchors"))
            if not len(anchors):
                continue
            at, data = parts.field("at").to_numpy().astype(np.int64), parts.field("bytes")
            cut = np.r_[0, np.cumsum(pc.binary_length(data).to_numpy().astype(np.int64))]
            x, o = (anchors.field(f).to_numpy().astype(np.int64) for f in ("x", "o"))
            more = anchors.field("piece" if step else "g").to_numpy()
            # the stretch that holds all of an anchor's windows begins at the first of them or before
            part = np.searchsorted((own << 40) + at, (of << 40) + np.maximum(x - WINDOWS + 1, 0), "right") - 1
            order = np.argsort(part, kind="stable")
            group = cut[:-1] // NAMED
            for g in np.unique(group[part]):
                lo_part, hi_part = np.searchsorted(group, [g, g + 1])
                a = order[np.searchsorted(part[order], lo_part) : np.searchsorted(part[order], hi_part)]
                text = np.frombuffer(b"".join(data.slice(lo_part, hi_part - lo_part).to_pylist()) + bytes(2 * n), np.uint8)
                place = cut[part[a]] - cut[lo_part] + x[a] - at[part[a]]
                who, p, near, far = _pieces(step, o[a], more[a] if step else None)
                w = a[who]
                lo, hi, here = x[w] - far, x[w] - near + LENGTH, place[who]
                inside = (lo >= 0) & (hi <= size[of[w]])
                start, end = np.where(inside, here - far, 0), np.where(inside, here - near + LENGTH, n)
                # a piece that reaches beyond its text is like no other
                alone = mix64((rid[of[w]].view(np.uint64) * _STEP + x[w].astype(np.uint64)) * _STEP + p.astype(np.uint64))
                salt = mix64(p.astype(np.uint64) + np.uint64(step * 256 + 1))
                u, common = [], None
                for lane in (0, 1):
                    ids = identifiers(text, n, lane)
                    named = mix64((ids[start] * _STEP + ids[end - n]) * _STEP + salt)
                    u.append(np.where(inside, named, mix64(alone + np.uint64(lane) + (np.uint64(1) << bits))).view(np.int64))
                    if lane == 0 and step == 1:
                        common = mix64((ids[here - near] * _STEP + ids[here - far + LENGTH - n]) * _STEP + salt).view(np.int64)
                i = more[w] if step == 0 else common if step == 1 else u[0]
                arrays = [rid[of[w]], x[w].astype(np.int32), o[w].astype(np.int32), p.astype(np.int32), i, *u]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["rid", "x", "o", "piece", "i", "u1", "u2"])

    return run


def refine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose span is shared; and a member of each refined bucket of the buckets that split."""
    # any member will do; first() of each column takes the same row's, in a hash aggregate without a sort
    classes = stage(rows.groupBy("i", "u1", "u2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("rid", "x", "o", "piece"))))
    split = stage(classes.groupBy("i").agg(F.count("*").alias("c")).where("c > 1").select("i"))
    shared = stage(rows.join(classes.where("n > 1").select("u1", "u2").hint("shuffle_hash"), ["u1", "u2"]).select("rid", "x", "piece"))
    going = stage(classes.join(split.hint("shuffle_hash"), "i").select("rid", "x", "o", "piece"))
    discard(classes, split)
    return shared, going


def repeats(docs: DataFrame) -> DataFrame:
    """rid, lo, hi: stretches of bytes that are covered by windows which start elsewhere too (they may overlap)."""
    base = numbered(docs)
    found = stage(base.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchor_rows, "rid bigint, x int, o int, g bigint"))
    # a staged table meets the rows in a plain shuffled join, which Spark can split at a hot bucket
    often = stage(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    by_text = found.join(often.hint("shuffle_hash"), "g").groupBy("rid").agg(F.collect_list(F.struct("x", "o", "g")).alias("anchors"))
    texts = stage(base.select("rid", "text").join(by_text.hint("shuffle_hash"), "rid").mapInArrow(_segments, "rid bigint, size int, parts array<struct<at:int,bytes:binary>>, anchors array<struct<x:int,o:int,g:bigint>>"))
    discard(found, often)
    out, going = None, None
    for step, width in enumerate((WINDOWS, SIDE, 1)):
        if step:
            by_text = going.groupBy("rid").agg(F.collect_list(F.struct("x", "o", "piece")).alias("anchors"))
            texts_here = texts.select("rid", "size", "parts").join(by_text.hint("shuffle_hash"), "rid")
        else:
            texts_here = texts
        rows = stage(texts_here.mapInArrow(_level(step), _ROW))
        if step:
            discard(going)
        shared, going = refine(rows)
        discard(rows)
        near = F.col("piece") * width
        spans = shared.select("rid", (F.col("x") - near - (width - 1)).alias("lo"), (F.col("x") - near + LENGTH).alias("hi"))
        out = spans if out is None else out.unionByName(spans)
    discard(texts, going)
    return out


def merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts of these sizes, with those of a row that overlap or touch made one, in order."""
    if not len(row):
        return row, lo, hi
    begin = np.cumsum(sizes + 1) - sizes - 1  # texts end to end, a byte between two, so that no span meets the next text's
    lo, hi = lo + begin[row], hi + begin[row]
    order = np.argsort(lo, kind="stable")
    row, lo, hi = row[order], lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    row = row[first]
    return row, lo[first] - begin[row], hi[np.append(first[1:], len(hi)) - 1] - begin[row]


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (byte spans), kept_sha256 and, if asked for, kept (the bytes left)."""
    spans = repeats(docs).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw(b)
            sizes = np.array([len(t) for t in texts], np.int64)
            spans, row = _lists(column(b, "spans"))
            row, lo, hi = merged(row, *(spans.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi")), sizes)
            cuts = np.searchsorted(row, np.arange(len(texts) + 1))
            left = list(texts)
            for r in np.unique(row).tolist():
                t, own = texts[r], slice(cuts[r], cuts[r + 1])
                left[r] = b"".join([t[a:e] for a, e in zip([0, *hi[own].tolist()], [*lo[own].tolist(), len(t)], strict=True)])
            removed = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
            n_removed = sizes - np.array([len(t) for t in left], np.int64)
            told = pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())
            arrays = [column(b, "doc_id"), pa.array(sizes), pa.array(n_removed), removed, told, *([pa.array(left, pa.binary())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256", "kept"][: len(arrays)])

    joined = numbered(docs).join(spans.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, removed array<struct<lo:bigint,hi:bigint>>, kept_sha256 string" + ", kept binary" * with_text)
