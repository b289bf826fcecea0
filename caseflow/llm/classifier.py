"""Quality classifier: gradient-boosted trees over document statistics.

The statistics are Spark expressions over the whole text; only they go to Python, where a pandas function walks the
flattened trees over Arrow batches. The trees are fitted on the driver from at most ``most_rows`` labelled rows, those of
the lowest hash of the id, held-out ids left out.

Defined results: null and empty texts have all-zero statistics and get a score like any row; a null id is not held out;
labels that are null, repeated with another value or without a document are not learnt from; without usable labels every
score is one half; an empty table gives an empty one. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import once
from caseflow.llm.textstats import text_stats
from caseflow.llm.trees import Forest, fit

STATS = "_classifier_stats"
HELD_OUT = 1
FOLDS = 3
MOST_TRAINING_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(stats: Column) -> dict[str, Column]:
    """Scale-free statistics; each is defined for a text without words."""
    words, chars = F.greatest(stats["n_words"], F.lit(1)), F.greatest(stats["n_chars"], F.lit(1))
    lines = F.greatest(stats["n_lines"], F.lit(1))
    return {
        "log_words": F.log1p(stats["n_words"]),
        "word_chars": stats["word_chars"] / words,
        "symbols": stats["n_symbols"] / words,
        "marks": stats["n_marks"] / words,
        "digits": stats["n_digits"] / chars,
        "upper": stats["n_upper"] / chars,
        "stop_words": stats["n_stop_words"] / words,
        "distinct": stats["n_distinct_words"] / words,
        # Herdan's C: distinct words in terms of length, so that long clean texts are not taken for repetition.
        "richness": F.log1p(stats["n_distinct_words"]) / F.greatest(F.log1p(stats["n_words"]), F.lit(1.0)),
        "dup_lines": stats["n_dup_lines"] / lines,
        "line_words": F.log1p(stats["n_words"] / lines),
    }


def with_features(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the array ``name`` of its features, each computed once."""
    stats = docs.withColumn(STATS, once(text_stats(F.col(text), repeats=False)))
    return stats.withColumn(name, F.array(*[v.cast("double") for v in features(F.col(STATS)).values()])).drop(STATS)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_TRAINING_ROWS, text: str = "text", doc_id: str = "doc_id"
) -> Forest:
    """Trees fitted on labelled documents that are not held out; ``most_rows`` bounds what the driver gets."""
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter(F.col("label") == F.col("other"))
        .select("id", "label")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most_rows)
    )
    # At most ``most_rows`` pairs of an id and a bit, so the documents stay where they are.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id")
    rows = with_features(rows, "t", "x").groupBy("id").agg(F.min("x").alias("x"), F.min("label").alias("label")).toPandas().sort_values("id")
    width = len(features(F.struct(F.lit(0))))
    table = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), width)
    return fit(table, rows["label"].to_numpy(dtype=float))


def scored(docs: DataFrame, forest: Forest, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""

    @F.pandas_udf("double")
    def walk(rows: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack(rows.to_numpy())) if len(rows) else [], dtype="float64")

    with_x = with_features(docs, text, "_classifier_x")
    return (
        with_x.withColumn(score, walk("_classifier_x"))
        .withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
        .drop("_classifier_x")
    )
