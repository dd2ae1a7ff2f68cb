"""Quality rules on how public tokenizers fare with a text (their fertility).

Per text and vocabulary: characters per token, the share of byte-fallback tokens and the entropy of its
tokens, relative to the most that so many tokens can have. Rejection bands per language
and length (in half octaves of tokens, as the measures depend on it) come from all
distinct texts: the median of each measure, give or take a multiple of half the distance of its quartiles.
A text outside a band is rejected, besides the plain rules on length and repetition. A group
of few texts takes the band of its language's texts of the nearest lengths, as far as needed,
or, in a language of few texts, of all texts of the nearest lengths.

Defined results: a null, empty or white text has no words, so base_failed. Null languages
form one group of their own. Repeated rows each get a
verdict, but a text counts once in the bands of its language. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIds, column, raw, small_batches, stage

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Half quartile distances from the median at which a text is rejected.
WIDTH = 5.0
#: Texts that a band is drawn from at least, if there are as many.
MIN_GROUP = 30
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: Least half-width of a band: tokenizers' measures vary by as much within good text.
LEAST = {"chars_per_token": 0.08, "byte_share": 0.02, "token_entropy": 0.03}
SYMBOLS = b"#*$%&|<>"
#: Code points of a word that are merged together; the rest of a longer word follows in strings as long.
LONG_WORD = 512


def repeated(idx: np.ndarray, n: int = 3) -> int:
    """Words that lie in a window of n words found twice or more."""
    if len(idx) < n:
        return 0
    _, idx = np.unique(idx, return_inverse=True)
    code = idx[: len(idx) - n + 1].astype(np.int64)
    for i in range(1, n):  # pairs are renumbered after each word, so codes never clash
        code = np.unique(code * (idx.max() + 1) + idx[i : len(idx) - n + 1 + i], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(idx), bool)
    for i in range(n):
        covered[i : len(code) + i] |= twice
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def vocabulary(file: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """How a public vocabulary encodes words, and which of its tokens are single bytes that it falls back to.

    A .model file is one of sentencepiece; a .tiktoken file holds ranks of byte sequences,
    where words have a space before and the bytes beyond ASCII are the fallback.
    """
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda words: model.encode(words, num_threads=1), np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    import public_tokenizers
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    coder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    is_byte = np.zeros(max(ranks.values()) + 1, bool)
    is_byte[[rank for token, rank in ranks.items() if len(token) == 1 and token[0] >= 128]] = True

    def encode(words: list[str]) -> list[list[int]]:
        found = [coder.encode_ordinary(" " + w[:LONG_WORD]) for w in words]
        for tokens, w in zip(found, words, strict=True):
            for i in range(LONG_WORD, len(w), LONG_WORD):
                tokens += coder.encode_ordinary(w[i : i + LONG_WORD])
        return found

    return encode, is_byte


class Pieces:
    """The tokens of words in one vocabulary, told by the words' numbers."""

    def __init__(self, file: str) -> None:
        self.encode, self.is_byte = vocabulary(file)
        self.reset()

    def reset(self) -> None:
        self.n = 0
        self.first = np.zeros((1 << 12) + 1, np.int64)
        self.tokens = np.zeros(1 << 14, np.int32)

    def add(self, words: list[str]) -> None:
        found = self.encode(words)
        sizes = np.array([len(x) for x in found], np.int64)
        end = self.n + len(words)
        while len(self.first) <= end:
            self.first = np.r_[self.first, np.zeros(len(self.first) - 1, np.int64)]
        self.first[self.n + 1 : end + 1] = self.first[self.n] + np.cumsum(sizes)
        while len(self.tokens) < self.first[end]:
            self.tokens = np.r_[self.tokens, np.zeros_like(self.tokens)]
        self.tokens[self.first[self.n] : self.first[end]] = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        self.n = end

    def measure(self, idx: np.ndarray) -> tuple[int, int, float]:
        """Tokens, byte tokens and the tokens' entropy in bits of a text."""
        first = self.first[idx]
        sizes = self.first[idx + 1] - first
        total = int(sizes.sum())
        if not total:
            return 0, 0, 0.0
        at = np.arange(total) + np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        tokens = self.tokens[at]
        p = np.unique(tokens, return_counts=True)[1] / total
        return total, int(self.is_byte[tokens].sum()), float(-(p * np.log2(p)).sum())


class Words:
    """Numbers words and keeps their code points and their pieces in each vocabulary."""

    def __init__(self, files: tuple[str, ...]) -> None:
        self.pieces = [Pieces(f) for f in files]
        self.ids = WordIds()
        self.chars = np.zeros(1 << 12, np.int64)
        self.n = 0

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.ids.trim():
            self.n = 0
            for p in self.pieces:
                p.reset()
        out = [self.ids.of(t.split()) for t in texts]
        new = [w.decode("utf-8", "replace") for w in self.ids.words[self.n :]]
        if new:
            end = self.n + len(new)
            while len(self.chars) < end:
                self.chars = np.r_[self.chars, np.zeros_like(self.chars)]
            self.chars[self.n : end] = [len(w) for w in new]
            for p in self.pieces:
                p.add(new)
            self.n = end
        return out


@lru_cache(1)
def words_of(files: tuple[str, ...]) -> Words:
    """One for all tasks of a worker, so that words stay known from one task to the next."""
    return Words(files)


def measure_names(n: int) -> list[str]:
    """The measures in each of n vocabularies; those of the second end in _2, and so on."""
    return [m if i == 0 else f"{m}_{i + 1}" for i in range(n) for m in MEASURES]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")


def measures(docs: DataFrame, files: Sequence[str]) -> DataFrame:
    """doc_id, lang, the counts, the measures in each vocabulary (null without tokens) and a hash of each text."""
    files, names = tuple(files), measure_names(len(files))
    fields = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", "lang string", *(f"{c} bigint" for c in _COUNTS), *(f"{c} double" for c in names), "digest bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(files)
        for b in small_batches(batches, 512):
            texts = raw(b)
            counts, found = [], []
            for t, idx in zip(texts, words.numbers(texts), strict=True):
                chars = int(words.chars[idx].sum())
                told = [p.measure(idx) for p in words.pieces]
                counts.append((len(idx), chars, sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), dup_lines(t), repeated(idx), told[0][0]))
                found.append([x for n, n_byte, h in told for x in ((chars / n, n_byte / n, h / np.log2(n) if n > 1 else 1.0) if n else (None, None, None))])
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] + [pa.array(c, pa.float64()) for c in zip(*found, strict=True)]
            cols.append(pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "lang").cast(pa.string()), *cols], ["doc_id", "lang", *_COUNTS, *names, "digest"])

    return docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text").mapInArrow(run, fields)


def nearest(groups: DataFrame, *by: str) -> DataFrame:
    """by, octave and reach: the octaves up or down within which MIN_GROUP texts lie, null if there are not as many."""
    sums = groups.groupBy(*by, "octave").agg(F.sum("n").alias("n"))
    other = sums.select(*by, F.col("octave").alias("o"), F.col("n").alias("m"))
    met = (sums.join(other, [*by]) if by else sums.crossJoin(other)).withColumn("away", F.abs(F.col("octave") - F.col("o")))
    upto = Window.partitionBy(*by, "octave").orderBy("away").rangeBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("total", F.sum("m").over(upto))
    return met.groupBy(*by, "octave").agg(F.min(F.when(F.col("total") >= MIN_GROUP, F.col("away"))).alias("reach"))


def bands(groups: DataFrame, judged: DataFrame) -> DataFrame:
    """lang, octave and the quartiles of each measure (<measure>_q) for all groups, from the judged texts."""
    counts = judged.groupBy("lang", "octave").agg(F.count("*").alias("n"))
    groups = stage(groups.join(counts, ["lang", "octave"], "left").fillna(0, ["n"]))
    own = stage(nearest(groups, "lang"))
    thin = own.where("reach is null").select("octave").distinct()
    far = nearest(groups).join(thin, "octave").select("octave", F.coalesce("reach", F.lit(1 << 16)).alias("reach"))
    sources = groups.where("n > 0").select(F.col("lang").alias("l"), F.col("octave").alias("o"))
    near = F.abs(F.col("octave") - F.col("o")) <= F.col("reach")
    drawn = own.join(sources, (F.col("lang") == F.col("l")) & near).select("l", "o", F.lit(False).alias("pooled"), "lang", "octave")
    drawn = drawn.unionByName(far.join(sources, near).select("l", "o", F.lit(True).alias("pooled"), F.lit("").alias("lang"), "octave"))
    names = [c for c in judged.columns if c not in ("lang", "octave", "digest")]
    texts = judged.select(F.col("lang").alias("l"), F.col("octave").alias("o"), *names).join(stage(drawn), ["l", "o"])
    found = stage(texts.groupBy("pooled", "lang", "octave").agg(*(F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(f"{m}_q") for m in names)))
    quartiles = [f"{m}_q" for m in names]
    few = own.where("reach is null").select("lang", "octave").join(found.where("pooled").select("octave", *quartiles), "octave")
    return stage(found.where("not pooled").select("lang", "octave", *quartiles).unionByName(few.select("lang", "octave", *quartiles)))


def verdicts(docs: DataFrame, files: Sequence[str], width: float = WIDTH) -> DataFrame:
    """measures() with base_failed, band_failed and kept; files are those of the vocabularies, of which the first tells lengths."""
    names = measure_names(len(files))
    found = stage(measures(docs, files)).withColumn("octave", F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = stage(found.where(F.col("n_words") >= MIN_WORDS).groupBy("lang", "octave", "digest").agg(*(F.min(m).alias(m) for m in names)))
    # a row a language and length: joined as any table, so that Spark broadcasts it only if it is small
    out = found.join(bands(found.select("lang", "octave").distinct(), judged), ["lang", "octave"], "left")
    inside = F.lit(True)
    for m, least in zip(names, [LEAST[m] for m in MEASURES] * len(files), strict=True):
        q = F.col(f"{m}_q")
        reach = F.greatest(F.lit(least), width * (q[2] - q[0]) / 2)
        inside &= F.coalesce(F.abs(F.col(m) - q[1]) <= reach, F.lit(False))
    return out.select("doc_id", "lang", *_COUNTS, *names, base_failed.alias("base_failed"), (~inside).alias("band_failed"), (~base_failed & inside).alias("kept"))


