"""The text operators in a row: each stage works on all that the one before kept.

Stages that end in Python give staged rows, so that these go through Python in batches of the
bytes that staging sets, and not of 10,000 texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import decontam, packing, pii, quality, simhash
from echofold.llm.common import documents, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier accepts (score 0.5 or more)."""
    learnt = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1
    labelled = table(spark, sf_dir, "labels").where(learnt).select("doc_id", F.col("quality").alias("label"))
    return stage(quality.accepted(docs, quality.fit(docs, labelled)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies; rows are told apart by place, so equal doc_ids don't matter."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("text"), F.struct("*").alias("row"))
    groups = simhash.near_copies(rows.select("doc_id", "text"), shingle=5, radius=4, least=0.8)
    first = groups.where("doc_id = component_id").select("doc_id")
    return rows.join(first, "doc_id", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences, with their ids."""
    return stage(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, keep=100_000))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", pack),
]

#: The stages learn, hash and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, function in STAGES[:-1]:
        docs = function(spark, docs, sf_dir)
        docs = docs if hasattr(docs, "staged_at") else stage(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
