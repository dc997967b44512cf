"""The corpus pipeline: five stages over `documents`, each of which works on all that the one before has kept.

quality       rejects documents that the quality network scores under its threshold
near_dedup    keeps one document of each group of near copies (five-word shingles, similarity 0.8)
decontaminate drops documents of which benchmark windows cover 5 % or more
pii           masks personal data in the texts
mix           takes documents by source weights; `taken` is a document's words in the mix, repeats counted
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, mixing, neardup, pii, quality
from helixframe.llm.common import checkpoint_dir, columns_of, cut, free_name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores ACCEPT or more. Null and empty texts get a score like others; repeated rows go or
    stay together; without labels every score is 0.5 and all stay; an empty table stays empty."""
    score = free_name(docs, "score")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, score).where(F.col(score) >= quality.ACCEPT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id, null last, then the least text hash. Rows that repeat
    both id and text count as one document; a text without words is alone in its group."""
    kept = cut(neardup.one_of_each(docs))
    rows = docs.select(columns_of(docs).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    hashes = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).groupBy("doc_id", "text_hash").count()
    repeated = hashes.where("count > 1").limit(1).count()
    return (rows.dropDuplicates(["doc_id", "text_hash"]) if repeated else rows).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than 5 %; null and empty texts, and all if there is no benchmark,
    stay."""
    name = free_name(docs, "found")
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), found=name)
    return found.where(~decontam.contaminated(name)).drop(name)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; null and empty texts as they are."""
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with source_size, target and taken beside their columns (own ones of these names are
    replaced). Documents without words are never taken; rows with one id and text go or stay together."""
    rows = docs.drop("size", "source_size", "target", "taken")
    sized = mixing.sized_documents(docs)
    mixed = mixing.apply_mix(mixing.sized_documents(docs, columns_of(rows).alias("row")), mixing.mix_plan(cut(sized))).where("taken > 0")
    return mixed.select("row.*", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
]
#: The stages' models and hashes can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
