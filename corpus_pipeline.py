"""Training-data pipeline over ``documents``: toxic documents go, then exact copies, then
near copies; personal data is masked; what is left is packed into sequences.

Each stage is written as Parquet and read again as the next one's input.  Every stage
but the last returns the columns of ``documents``, others that the input has included.

Defined cases, in every stage: a null text counts as empty and stays null where rows are
kept; null or repeated doc_ids are rows like others; texts of any length are read whole; an
empty table gives an empty result; extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm import exact_dedup, ngram_join, packing, pii, toxicity
from tessela.llm.common import documents, scratch, table
from tessela.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of ``sf_dir``; rejected documents go.  Texts that
    are null, empty or without a letter are kept unless nearly all labels are toxic."""
    ship(spark)
    model = toxicity.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z the row with the largest doc_id stays; of rows
    that repeat doc_id and text, one.  Null and empty texts are equal."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.75 or more, directly or through
    others) the smallest doc_id stays.  Rows with a null doc_id and texts without a word
    stay."""
    ship(spark)
    return ngram_join.survivors(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; no row goes.
    ``n_chars`` is that of the masked text, null for a null one."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document, the columns of ``op1``."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("packing", pack),
]

#: Trained classifiers and exact tokenizers have no SQL form; tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
