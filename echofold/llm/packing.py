"""Packing token sequences by minimum bin slack.

Every task packs the documents it reads, in blocks, so nothing is shuffled. In a block,
pieces are counted by length; each window takes the longest piece left and then the
multiset of remaining lengths that comes closest to the capacity, found by a subset-sum
dynamic program over a bit set (bit s: the sum s can be reached) and read back as counts.
Windows with slack are not padded: their pieces are laid end to end and cut at the
capacity, and what is left at the end of a block is cut into powers of two.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are
packed once each. A null doc_id is packed like any other. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import column, raw

CAPACITY = 2048
BLOCK = 4096
END_ID = 1
#: Words of which a worker keeps the ids, and as many put by; fewer take less memory and more time.
WORDS = 300_000

#: Bytes of text whose words are looked up together.
LOOKED_UP = 1 << 20

#: ASCII signs that the tokenizer splits from a word that ends in a letter.
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class WordTokens:
    """Ids of white-space-free words, kept per word: the tokenizer never joins across white space.

    The whole text's ids are the words' ids one after another. Words are kept in lower
    case, as the tokenizer lowers them anyway (but for its special strings). Beyond the limit
    the words kept so far are put by, and only those that come again are taken over, so
    that a worker holds about twice the limit at most and frequent words stay known.
    """

    def __init__(self, path: str, limit: int = WORDS) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks have the cores; threads beside them only wait
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.ids: dict[bytes, bytes] = {}
        self.past: dict[bytes, bytes] = {}
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def tokenize(self, words: list[bytes]) -> None:
        """Keep the words' ids. Words of letters alone are one word to the tokenizer too, so that many
        go in a line: each then ends with the only token that ends a word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain, rest = [], []
        for i, t in enumerate(texts):
            (plain if t.isalpha() else rest).append(i)
        lines = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(line):
                rest += line
                continue
            data, at = ids.tobytes(), 0
            for i, end in zip(line, ends.tolist(), strict=True):
                self.ids[words[i]] = data[2 * at : 2 * end]
                at = end
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            self.ids[words[i]] = array("H", e.ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        tailed = {}
        for w in words:
            head = w.rstrip(_TAIL)
            if len(head) < len(w) and head[-1:].islower() and b"<|" not in w:
                tailed[w] = head, w[len(head) :]
        parts = {p for ps in tailed.values() for p in ps} | (words - tailed.keys())
        self.tokenize([p for p in parts if p not in self.ids])
        for w, (head, tail) in tailed.items():
            self.ids[w] = self.ids[head] + self.ids[tail]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text as unsigned 16-bit numbers, without the end id.

        A stretch of texts is split and its words numbered as one column, so that a word is
        looked up once a stretch and the texts' ids are one gather.
        """
        group = np.cumsum([len(t) for t in texts]) // LOOKED_UP
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)]
        for i, end in zip(cuts, cuts[1:], strict=False):
            whole = pa.array(texts[i:end], pa.large_binary()).view(pa.large_string())
            split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole)))
            flat = split.flatten().dictionary_encode()
            words = flat.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
            if len(self.ids) > self.limit:
                self.past, self.ids = self.ids, {}
            found = list(map(self.ids.get, words))
            if missing := {w for w, ids in zip(words, found, strict=True) if ids is None}:
                again = {w: ids for w in missing if (ids := self.past.get(w)) is not None}
                self.ids.update(again)
                self.learn(missing - again.keys())
                found = [self.ids[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            coded = pa.array(found, pa.large_binary()).take(flat.indices)
            _, at, data = coded.buffers()
            at = np.frombuffer(at, np.int64, len(coded) + 1)[np.asarray(split.offsets)] // 2
            ids = np.frombuffer(data, "<u2", at[-1]) if at[-1] else np.empty(0, "<u2")
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[a:e]


@lru_cache(1)
def word_tokens(path: str, limit: int = WORDS) -> WordTokens:
    """One for all tasks of a worker, so that words stay known from one task to the next."""
    return WordTokens(path, limit)


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """Counts of lengths whose sum is as close to target as the lengths left allow, never above it.

    reach is a bit set of sums. Lengths join it from the longest down, counts split into
    powers of two; it stops as soon as the target itself is reached, and walks back
    through the bit sets that it kept.
    """
    reach, steps = 1, []
    goal, full = 1 << target, (1 << (target + 1)) - 1
    for length in sorted((n for n in counts if n <= target), reverse=True):
        left, k = min(counts[length], target // length), 1
        while left and not reach & goal:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left -= k
            k *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every id of the given lengths once.

    Documents above the capacity give full windows of their own; the rest are pieces for
    the windows. A sequence is of the capacity, or of a power of two below it.
    """
    out: list[list[tuple[int, int, int]]] = []
    waiting: dict[int, list[tuple[int, int]]] = {}
    for doc, n in enumerate(lengths):
        whole = n // capacity * capacity
        out.extend([(doc, s, capacity)] for s in range(0, whole, capacity))
        if n > whole:
            waiting.setdefault(n - whole, []).append((doc, whole))
    counts = {n: len(x) for n, x in waiting.items()}
    loose: list[tuple[int, int, int]] = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        taken = fill(counts, capacity - longest)
        slack = capacity - longest - sum(n * k for n, k in taken.items())
        # the same window again, as long as all its lengths last
        times = 1 + min([counts.get(longest, 0), *((counts[n] - k) // (k + (n == longest)) for n, k in taken.items())]) if longest not in taken else 1
        for n, k in ({longest: times - 1} | {n: k * times for n, k in taken.items()} if longest not in taken else taken).items():
            if k:
                counts[n] -= k
                if not counts[n]:
                    del counts[n]
        for _ in range(times):
            window = [(*waiting[n].pop(), n) for n, k in [(longest, 1), *taken.items()] for _ in range(k)]
            if slack:
                loose += window
            else:
                out.append(window)
    return out + _cut(loose, capacity)


def _cut(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The pieces end to end, cut at the capacity and the last stretch into powers of two."""
    total = sum(p[2] for p in pieces)
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if rest >> b & 1]
    out, it, piece = [], iter(pieces), None
    for size in sizes:
        sequence = []
        while size:
            doc, start, n = piece or next(it)
            k = min(n, size)
            sequence.append((doc, start, k))
            piece = (doc, start + k, n - k) if n > k else None
            size -= k
        out.append(sequence)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, keep: int = WORDS) -> DataFrame:
    """Pieces of documents with their place in a sequence; with_ids adds the ids themselves.
    keep: the words that a worker remembers.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].
    sequence_id holds the number of the input partition in its upper bits.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_path, keep)
        sequence = TaskContext.get().partitionId() << 32
        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                b = big.slice(at, BLOCK)
                tokens = [np.append(t, np.uint16(END_ID)) for t in words.encode(raw(b))]
                rows = []
                for pieces in pack([len(t) for t in tokens], capacity):
                    offset = 0
                    for doc, start, n in pieces:
                        rows.append((doc, start, n, zlib.crc32(tokens[doc][start : start + n].astype("<u4").tobytes()), len(tokens[doc]), sequence, offset))
                        offset += n
                    sequence += 1
                cols = np.array(rows, np.int64).reshape(-1, 7).T
                out = [column(b, "doc_id").take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])]
                if with_ids:
                    out.append(pa.array([tokens[r[0]][r[1] : r[1] + r[2]].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(out)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
