"""Sharding along a Hilbert curve.

Several metadata columns are quantised (numbers by quantile cuts, texts by hash bucket), each row gets its place on the
curve through that grid, and the rows in curve order are cut into runs. Rows that are close in all dimensions fall into the
same run, so file statistics prune on any of them.

The order is made by range partitioning on (place, ties), so no group is too large for a task; every row is numbered from
the totals of the ranges before its own.

Defined results: a null dimension value lies in the lowest cell; rows equal in place and ties are numbered in any order;
an empty table gives an empty one; other columns pass through and those named like added ones are replaced. Equal texts get
no special treatment: they lie together where their metadata does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.store import landed

BITS = 5
ACCURACY = 10_000


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, values below 2**bits)."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's turns from the coarsest level on
        low = (1 << level) - 1
        for k in range(dims):
            inside = (x[k] >> level) & 1 == 1
            swapped = np.where(inside, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(inside, low, swapped)
            x[k] ^= swapped
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            place = (place << 1) | ((x[k] >> level) & 1)
    return place


def _cells(docs: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """One cell number per dimension: quantile of a number, hash bucket of anything else."""
    kinds = dict(docs.dtypes)
    numbers = [d for d in dims if kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[d].startswith("decimal")]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = docs.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, ACCURACY).alias(f"c{k}") for k, d in enumerate(numbers)]).first() if numbers else []
    cells = []
    for d in dims:
        if d in numbers:
            edges = sorted(set(cuts[numbers.index(d)] or []))
            value = F.col(d).cast("double")
            cell = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < value)) if edges else F.lit(0)
        else:
            cell = F.crc32(F.col(d).cast("string")) % (1 << bits)
        cells.append(F.when(F.col(d).isNull(), 0).otherwise(cell).cast("int"))
    return cells


def with_place(docs: DataFrame, dims: list[str], bits: int = BITS, name: str = "place") -> DataFrame:
    """``docs`` with the place on the curve (long)."""

    @F.pandas_udf("long")
    def place(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_places(np.stack(cells.to_numpy()), bits) if len(cells) else [], dtype="int64")

    return docs.withColumn(name, place(F.array(*_cells(docs, dims, bits))))


def shards(docs: DataFrame, dims: list[str], ties: list[str], count: int = 8, bits: int = BITS, ranges: int | None = None) -> DataFrame:
    """``docs`` with ``place``, ``shard`` (0 to ``count`` - 1; row counts at most one apart) and ``slot`` (gapless from 0 in its shard).

    ``ties`` orders rows of one place. ``ranges`` is the number of ranges the order is made with (the session's number of
    shuffle partitions by default); it does not change the result. Pass columns that are to be carried; for whole texts
    join the narrow result to them or use ``write_shards``.
    """
    added = ["place", "shard", "slot"]
    rows = with_place(docs.drop(*added), dims, bits)
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["place", *ties]
    kept = landed(
        rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "curve"
    )
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range: its first number, and the number of all rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"),
        F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    number = kept.withColumn("_own", own.cast("long")).join(F.broadcast(starts), "_range").withColumn("_number", F.col("_first") + F.col("_own") - 1)
    shard = F.expr(f"(_number * {count}) div _all")
    # The first number of shard s is the least n with n * count >= s * all.
    first = F.expr(f"(shard * _all + {count - 1}) div {count}")
    placed = number.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_number") - first)
    return placed.drop("_range", "_own", "_first", "_all", "_number")


def write_shards(docs: DataFrame, path: str, dims: list[str], ties: list[str], count: int = 8, bits: int = BITS) -> None:
    """Write whole rows as one folder per shard, in curve order within each file, so that row-group statistics prune.

    The session's number of shuffle partitions decides how many files there are; large shards get several.
    """
    placed = shards(docs, dims, ties, count, bits)
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(max(files, count), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
