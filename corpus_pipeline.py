"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import classifier, packing, pii, quality, simhash
from caseflow.llm.store import landed
from caseflow.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    return quality.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1; it learns from the labelled rows of the whole ``documents`` table."""
    forest = classifier.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = classifier.scored(docs, forest, score="_quality_score", predicted="_quality_predicted")
    return judged.filter("_quality_predicted = 1").drop("_quality_score", "_quality_predicted")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets; ``n_chars`` follows the text."""
    found = pii.with_spans(docs, pii.train(pii.histogram(docs)), name="_pii_spans")
    text = pii.redacted(F.col("text"), F.col("_pii_spans"))
    changed = F.size("_pii_spans") > 0
    return found.withColumns(
        {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    ).drop("_pii_spans")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document with their sequence and place."""
    items = packing.pieces(docs, vocabulary(), with_ids=False)
    return packing.packed(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

# Trees, fingerprints and token ids are beyond SQL; the tests run the stages beside a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
