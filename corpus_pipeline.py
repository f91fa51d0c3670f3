"""From raw documents to packed training sequences, in stages.

Each stage reads what its predecessor kept and returns documents with the same
columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near, packing, quality, secrets
from tidemark.llm.common import arrow_rows, new_table, removed, table, written
from tidemark.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.passing(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    arrow_rows(spark)
    return near.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and ``n_chars`` as it then is."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: clean text as it is, nothing toxic or low."""
    model = mixing.train(docs, mixing.domain_labels(table(spark, sf_dir, "labels")), dense=True)
    rated = mixing.rated(docs, model, {"clean": 1.0}, anchor="clean")
    return rated.withColumn("copies", mixing.whole_copies(model, "clean")).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    arrow_rows(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the models of strings and the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next; a table goes once its successor is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            before, path = path, new_table(spark)
            docs = written(docs, path)
            if before is not None:
                removed(spark, before)
    return docs
