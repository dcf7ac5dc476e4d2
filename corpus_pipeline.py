"""Cleaning a corpus: quality, near-duplicates, benchmark passages, personal data, then tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, decontaminate, pii, quality, simhash
from vigil.llm.common import prepare, table
from vigil.llm.queries import tokenizer_path
from vigil.session import ensure_checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group stays, the one with the smallest id."""
    prepare(spark)
    return simhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with benchmark passages beyond the contract's share go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every span is replaced by its kind."""
    prepare(spark)
    return pii.redacted_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every document, and whether they decode to its text."""
    prepare(spark)
    rows = docs.select("doc_id", "text")
    coded = bpe.encode_decode(rows, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the classifier, XXH64 or the tokenizer: the stages are tested against plain versions.
ORACLE_SQL = None
