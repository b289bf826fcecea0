"""Scans: Parquet tables, JSON lines, file inventories; sinks: atomic, appending and snapshot writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.columns import col
from caseflow.functions.udfs import decode_bytes

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("suffix", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified_utc", T.TimestampType()),
        T.StructField("annotation_status", T.StringType()),
        T.StructField("sha256", T.StringType()),
    ]
)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined ones (with ``_corrupt_record``) of a JSON-lines file; the reader skips blank lines."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = (
        spark.read.schema(marked)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    good = rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, rows.filter(F.col("_corrupt_record").isNotNull())


def parse_json_lines(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Records of a text column that holds one JSON object per row; blanks are skipped, bad lines flagged."""
    text = F.trim(F.col(column))
    return (
        lines.filter(text != "")
        .withColumn("record", F.from_json(text, schema))
        .withColumn("is_bad", F.to_json("record") == F.lit("{}"))
    )


def file_inventory(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """Path, suffix, size and time of every file below folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select(
        F.col("path").alias("source_path"),
        suffix.alias("suffix"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_utc"),
    ).filter(F.col("suffix").isin(suffixes))


def content_digest(content) -> Column:
    """SHA-256 of bytes, or of a text's UTF-8 bytes, in hex."""
    return F.sha2(col(content).cast("binary"), 256)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of every file below folder; each file is hashed inside the task that reads it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("source_path"), content_digest("content").alias("sha256"))


def page_text_from_bytes(pages: DataFrame, content: str = "content") -> DataFrame:
    """Decode landed page bytes with the charset named in their first 4096 bytes, else UTF-8."""
    head = F.decode(F.substring(F.col(content), 1, 4096), "ISO-8859-1")
    charset = F.lower(F.regexp_extract(head, r"(?i)charset\s*=\s*[\"']?([^;\"'\s/>]+)", 1))
    known = ["us-ascii", "iso-8859-1", "utf-8", "utf-16be", "utf-16le", "utf-16", "utf-32"]
    text = F.decode(F.col(content), "UTF-8")
    for name in known:
        text = F.when(charset == name, F.decode(F.col(content), name)).otherwise(text)
    other = (charset != "") & ~charset.isin(known)
    # Only the bytes in other charsets travel to Python.
    return pages.withColumn("charset", charset).withColumn(
        "html", F.coalesce(decode_bytes(F.when(other, F.col(content)), charset), text)
    )


def write_new_version(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a complete new version; the committer publishes it only when the job succeeds.

    Readers keep the old version's path until they are pointed at the new one.
    """
    df.write.mode("errorifexists").format(fmt).save(path)


def append_new(df: DataFrame, path: str, keys: list[str], existing: DataFrame | None) -> DataFrame:
    """Append the rows whose keys are not in ``existing``; returns what was appended."""
    fresh = df if existing is None else df.join(existing.select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def write_snapshot(tables: dict[str, DataFrame], root: str, stamp: str) -> None:
    """Copy every table below ``root/snapshot=<stamp>`` in parallel tasks, one job per table."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{root}/snapshot={stamp}/{name}")


def snapshot_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row-count manifest of a snapshot, one row per table."""
    counts = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = row if counts is None else counts.unionByName(row)
    return counts
