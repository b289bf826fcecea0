"""Best-fit packing of token pieces into sequences of a fixed capacity, by large-item matching.

Pieces above a third of the capacity go at most two to a sequence: from the longest down, each meets the longest partner
that still fits. Shorter pieces then go, longest first, into the smallest gap that holds them, and open a sequence only where
none does. Pieces of one length are alike, so the whole plan is made from the number of pieces of each length (at most
``capacity`` numbers, whatever the size of the corpus) as runs of equal sequences; every piece looks its place up by its
number within its length. Nothing is dropped, and no length, however common, is gathered in one task.

Defined results: a null or empty text is one piece, its end id; rows with null or repeated ids are packed like any other;
an empty table gives an empty one; columns other than the id and the text are ignored by ``pieces`` and carried by ``packed``.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.store import landed
from caseflow.llm.tokens import END, encoder

CAPACITY = 2048


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first is shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = defaultdict(list)
            texts = (t.as_py() for t in batch.column(1))
            for row, ids in enumerate(encoder(vocabulary).encode(texts)):
                ids += END
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for name, value in (("row", row), ("piece", piece), ("start", start), ("length", length), ("crc", zlib.crc32(own))):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(own)
            columns = [batch.column(0).take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32())]
            columns += [pa.array(rows[name], pa.int64()) for name in ("start", "length", "crc")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(rows["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Plan:
    """Where the n-th piece of a length goes: runs of ``per_bin`` pieces of one length side by side in successive sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.bins = 0
        self.entries: list[tuple[int, int, int, int, int]] = []  # length, first number, first bin, pieces per bin, offset
        self.left = dict(counts)
        self.placed: dict[int, int] = defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first bin, bins)
        self._match_large()
        self._fill_gaps()
        table = np.array(sorted(self.entries), dtype=np.int64).reshape(-1, 5)
        self.length, self.number, self.bin, self.per_bin, self.offset = table.T
        self.key = (self.length << 44) | self.number

    def _put(self, length: int, first_bin: int, bins: int, per_bin: int, offset: int) -> None:
        self.entries.append((length, self.placed[length], first_bin, per_bin, offset))
        self.placed[length] += bins * per_bin
        self.left[length] -= bins * per_bin

    def _open(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def _match_large(self) -> None:
        large = sorted((n for n in self.left if 3 * n > self.capacity), reverse=True)
        for n in large:
            while self.left[n] > 0:
                partner = next((m for m in large if m <= min(n, self.capacity - n) and self.left[m] > (m == n)), None)
                if partner is None:
                    bins = self.left[n]
                    first = self._open(bins)
                    self._put(n, first, bins, 1, 0)
                    self.gaps[self.capacity - n].append((first, bins))
                elif partner == n:
                    bins = self.left[n] // 2
                    first = self._open(bins)
                    self._put(n, first, bins, 2, 0)
                    self.gaps[self.capacity - 2 * n].append((first, bins))
                else:
                    bins = min(self.left[n], self.left[partner])
                    first = self._open(bins)
                    self._put(n, first, bins, 1, 0)
                    self._put(partner, first, bins, 1, n)
                    self.gaps[self.capacity - n - partner].append((first, bins))

    def _fill_gaps(self) -> None:
        for n in sorted((n for n in self.left if 3 * n <= self.capacity), reverse=True):
            while self.left[n] > 0:
                gap = next((g for g in range(n, self.capacity + 1) if self.gaps.get(g)), self.capacity)
                if not self.gaps.get(gap):
                    fresh = -(-self.left[n] // (self.capacity // n))
                    self.gaps[gap].append((self._open(fresh), fresh))
                first, bins = self.gaps[gap].pop()
                # A sequence takes as many of this length as it holds, as it stays the best fit; the last takes what is left.
                each = min(gap // n, self.left[n])
                used = min(bins, self.left[n] // each)
                self._put(n, first, used, each, self.capacity - gap)
                self.gaps[gap - each * n].append((first, used))
                if used < bins:
                    self.gaps[gap].append((first + used, bins - used))

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces, given their lengths and their numbers from 0 within the length."""
        at = np.searchsorted(self.key, (length.astype(np.int64) << 44) | number, side="right") - 1
        step = number - self.number[at]
        return self.bin[at] + step // self.per_bin[at], self.offset[at] + step % self.per_bin[at] * length


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (``length`` of 1 to ``capacity``; any other columns) with ``sequence_id`` and ``offset``."""
    items = landed(items.drop("sequence_id", "offset").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    sizes = items.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``capacity`` rows, one per length.
    plan = Plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_row")) - 1

    @F.pandas_udf("sequence long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(length.to_numpy(dtype="int64"), number.to_numpy(dtype="int64"))
        return pd.DataFrame({"sequence": sequence, "offset": offset})

    placed = (
        items.withColumn("_own", own)
        .join(starts, ["_part", "length"])
        .withColumn("_place", place("length", F.col("_own") + F.col("_before")))
    )
    names = [c for c in items.columns if c not in ("_part", "_row")]
    return placed.select(*names, F.col("_place.sequence").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces with their ids; a sequence holds ``capacity`` ids at most."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("own", F.lit(b""), lambda ids, one: F.concat(ids, one["ids"]))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), own.alias("own")).select("sequence_id", "n_tokens", joined.alias("ids"))
