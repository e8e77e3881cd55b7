"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each on all that the one before kept: toxicity and language ID drop the documents they
reject, near-dedup keeps one document of each group, the PII stage masks personal data in the
texts, packing cuts and packs them.  SQL expresses none of the models, so ORACLE_SQL is None and
the stages are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common, language, packing, pii, simhash, toxicity
from ledgerloom.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.masked(docs, pii.train(docs))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.  A
    stage's folder goes once the next is written; the last one stays, since the result reads it."""
    docs, path = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = path
        docs, path = common.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.dropped(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
