"""One query an operator, with production parameters, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontam, fertility, langid, lexical, lines, packing, pii, quality, ring, simhash, substring
from .common import discard, documents, stage, table


#: The vocabularies that op6 measures with: one with byte fallback and one of bytes for many languages.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = _remainder(3) == 1
    labelled = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labelled))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_suffix_bucket_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(documents(spark, sf_dir), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op3_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    counts = [pii.count_kind("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.told("base"), 256).alias("base_sha256"), pii.told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.verdicts(documents(spark, sf_dir), [public_tokenizers.path(v) for v in VOCABULARIES])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fertility.measure_names(len(VOCABULARIES)))


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring.assign(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(documents(spark, sf_dir))
    removed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["lo"].cast("string"), s["hi"].cast("string"))), ",")
    return out.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), removed.alias("removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = _remainder(5) == 0
    found = langid.predict(docs, langid.fit(docs.where(~held_out).select("text", "lang")))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, entries = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.told(entries)).alias("codebooks_sha256"))


def op12_bpe_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_heap_merge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stage(lexical.build_index(documents(spark, sf_dir)))
    found = lexical.search(index, table(spark, sf_dir, "benchmark"))
    discard(index)
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bradley_terry_quality, op2_suffix_bucket_dedup, op3_minimum_bin_slack, op4_simhash_trie, op5_contextual_pii,
        op6_tokeniser_fertility, op7_bounded_ring, op8_simhash_decontamination, op9_line_dedup, op10_language_bitmask,
        op11_hamerly_codes, op12_bpe_queue, op13_heap_merge_search,
    )
}


def _codes_sql(rounds: int = 2) -> str:
    """Product codes by plain rounds: all distances of all parts, in integers."""
    def assigned(n: int) -> str:
        return f"""
        d{n} AS (SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM part JOIN book{n} USING (p, j) GROUP BY r, p, e),
        a{n} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{n} GROUP BY r, p)"""

    def moved(n: int) -> str:
        return f"""
        s{n} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM part JOIN a{n} USING (r, p) GROUP BY p, e, j),
        book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN s.n IS NULL THEN b.c ELSE ((s.s - (((s.s % s.n) + s.n) % s.n)) // s.n)::BIGINT END AS c FROM book{n} b LEFT JOIN s{n} s USING (p, e, j))"""

    steps = ",".join(assigned(n) + "," + moved(n) for n in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        flat AS (SELECT r, len(v) // 16 AS w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM kept),
        part AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, x FROM flat),
        book0 AS MATERIALIZED (SELECT p, r AS e, j, x AS c FROM part WHERE r < 64),{steps},{assigned(rounds)},
        coded AS (SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
        told AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r) CROSS JOIN told"""


ORACLE_SQL: dict[str, str] = {
    "op11_hamerly_codes": _codes_sql(),
    "op13_heap_merge_search": r"""
        WITH words AS (SELECT k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS k, * FROM documents)),
        asked AS (SELECT DISTINCT k AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS k, * FROM benchmark)),
        tf AS (SELECT k, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        size AS (SELECT k, sum(tf)::BIGINT AS n FROM tf GROUP BY k),
        whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM size),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
        m AS (SELECT k, 10 + (90 * n * docs) // tokens AS m FROM size, whole),
        scored AS (SELECT item, item_id, doc_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op9_line_dedup": r"""
        WITH units AS (
            SELECT doc_id, text, unnest(string_split_regex(text, '[.!?\n]')) AS unit, generate_subscripts(string_split_regex(text, '[.!?\n]'), 1) AS k FROM documents),
        placed AS (
            SELECT doc_id, text, k, unit, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo,
                trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM units),
        judged AS (
            SELECT *, length(plain) - length(replace(plain, ' ', '')) >= 13 AS counts, least(lo + length(unit) + 1, length(text)) AS hi FROM placed),
        ranked AS (
            SELECT *, counts AND row_number() OVER (PARTITION BY counts, plain ORDER BY doc_id, k) > 1 AS gone FROM judged),
        told AS (
            SELECT doc_id, count(*) FILTER (counts) AS n_units, count(*) FILTER (gone) AS n_removed,
                coalesce(string_agg(lo || ':' || hi, ',' ORDER BY k) FILTER (gone), '') AS removed,
                coalesce(string_agg(substring(text, lo + 1, hi - lo), '' ORDER BY k) FILTER (NOT gone), '') AS kept FROM ranked GROUP BY doc_id)
        SELECT doc_id, n_units, n_removed, removed, sha256(kept) AS kept_sha256 FROM told""",
}
