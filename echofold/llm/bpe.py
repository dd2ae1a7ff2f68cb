"""Byte-pair encoding by a priority queue of merges, and decoding.

A word's symbols form a doubly linked list. The queue holds (rank, place) of the pairs that
can merge; the least is taken, skipped if its pair is no longer there, and otherwise merged
in place, which puts at most two new pairs into the queue. Texts are cut at white space,
over which the vocabulary's rules never reach, and words are kept with their ids, so that a
word is merged once a worker and not once a text. The vocabulary file's own rules
(normalizer, splits, special strings) prepare a word; the merges are done here.

Every task encodes the texts it reads: nothing is shuffled, and the vocabulary file is read
by each worker from its own installation.

Defined results: a null or empty text has no ids and decodes to an empty string. Repeated
rows and null doc_ids are handled like any other row. An empty table gives no rows. A word of
any length is one word; its queue grows with the word alone. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, raw, small_batches

#: Words that a worker remembers with their ids; when there are more, it starts anew.
KEPT_WORDS = 600_000
#: Bytes up to which a word is remembered.
KEPT_BYTES = 64
#: Bytes of text cut at a time, so that a very long text is no list of all its words.
PIECE = 1 << 22
_PLACE = 32


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers format with BPE merges."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout") or model.get("unk_token") or spec["decoder"]:
            raise ValueError("the vocabulary must be of plain BPE merges, without a decoder of its own")
        rules = Tokenizer.from_file(path)
        self.normalize, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) packed into one number: rank and merged id.
        self.merges = {self.vocab[a] << _PLACE | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special strings must be taken as they stand")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = np.array([strings.get(i, "") for i in range(max(strings) + 1)], object)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, list[int]] = {}

    def merge(self, symbols: str) -> list[int]:
        """Ids of one word, given in the vocabulary's characters; one that is not in the vocabulary has none."""
        if not symbols:
            return []
        ids = [i for c in [*symbols[:-1], symbols[-1] + self.end] if (i := self.vocab.get(c)) is not None]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [found[0] << _PLACE | at for at in range(n - 1) if (found := merges.get(ids[at] << _PLACE | ids[at + 1]))]
        heapify(queue)
        place = (1 << _PLACE) - 1
        while queue:
            top = heappop(queue)
            at = top & place
            right = after[at]
            if ids[at] < 0 or right >= n:
                continue  # the symbol has been merged away, or is the last now
            found = merges.get(ids[at] << _PLACE | ids[right])
            if found is None or found[0] != top >> _PLACE:
                continue  # another pair stands there now; it has an entry of its own
            ids[at], ids[right] = found[1], -1
            after[at] = beyond = after[right]
            if beyond < n:
                before[beyond] = at
                if found := merges.get(ids[at] << _PLACE | ids[beyond]):
                    heappush(queue, found[0] << _PLACE | at)
            if (left := before[at]) >= 0 and (found := merges.get(ids[left] << _PLACE | ids[at])):
                heappush(queue, found[0] << _PLACE | left)
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> Iterator[int]:
        for part, _ in self.split(self.normalize(text)):
            ids = self.parts.get(part)
            if ids is None:
                ids = self.merge(part)
                if len(part) <= KEPT_BYTES:
                    if len(self.parts) >= KEPT_WORDS:
                        self.parts.clear()
                    self.parts[part] = ids
            yield from ids

    def _word(self, word: bytes) -> bytes:
        """Ids of a stretch without white space, as little-endian 32-bit numbers."""
        text, out, at = word.decode("utf-8", "replace"), [], 0
        if self.special_at:
            for m in self.special_at.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(self.special[m.group()])
                at = m.end()
        out += self._plain(text[at:] if at else text)
        ids = np.array(out, "<u4").tobytes()
        if len(word) <= KEPT_BYTES:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers."""
        known, out = self.words, []
        for piece in pieces(text):
            out.append(b"".join([known.get(w) or self._word(w) for w in piece.split()]))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings of the ids one after another, a space between two, as the file names no decoder."""
        return " ".join(self.strings[ids].tolist())


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in stretches of about size bytes, cut at a space or line feed."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size))
        if cut <= at:  # a word longer than that: up to its end
            m = re.compile(rb"[ \n]").search(text, at + size)
            if m is None:
                break
            cut = m.start()
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@lru_cache(1)
def codec(path: str) -> Codec:
    """One for all tasks of a worker, so that words stay known from one task to the next."""
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([own.encode(t).astype(np.int32) for t in raw(b)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that its ids stand for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in small_batches(batches):
            texts = [own.decode(np.asarray(x, np.int64)) if x else "" for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (unsigned 32 bits, little-endian) and of the text decoded from them.

    Ids and decoded texts are some four times the input; they are told apart by their digests within the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in small_batches(batches):
            n, of_ids, of_text = [], [], []
            for text in raw(b):
                ids = own.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
