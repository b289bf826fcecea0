"""Whitening of embeddings along their leading principal components, found by Jacobi-Davidson without forming a covariance.

A vector's entries become whole numbers x = floor(1024 c) + 100000, so sums are exact and centring loses nothing. The fit
rows lie in the shared folder as blocks of vectors; every product of the covariance with a block of directions is one job over
them, each task adding up (x - mean)((x - mean)' Q) of its rows. The driver holds a few directions and their images: dimension
times some ninety numbers at most, whatever the number of rows.

Defined results: a row whose vector is null, or holds a null or non-finite entry, is dropped. The vectors of one fit have one
length, the one that most remaining rows have (the longer of equally frequent ones); rows of another length are dropped, and so
are empty vectors. Entries beyond 2**39 in size count as that. A null id and repeated rows are rows like any other. Components
without variance (at most ``dim`` x machine precision of the whole) are left out, so constant vectors, a single row and an empty
table give no rows. Other columns are ignored. ``deviation`` is null where it would exceed 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.jacobi import EPS, leading
from caseflow.llm.store import landed

SCALE, SHIFT = 1024, 100_000
BLOCK_BYTES = 1 << 18
MOST = float(1 << 49)
BLOCK_ROWS = 1 << 13  # as many entries of size MOST stay within 64 bits when added up
COMPONENTS = 8


def fit_blocks(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(dim, n, ids, x): the usable vectors in blocks, as whole numbers, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dim)
                size = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * dim)))
                for k in range(0, len(own), size):
                    some = own[k : k + size]
                    c = flat[starts[some][:, None] + np.arange(dim)]
                    # The scaled entry is clipped as a float first, where a huge one would not be a whole number.
                    x = np.floor(np.clip(SCALE * c, -MOST, MOST)).astype(np.int64) + SHIFT
                    narrow = x.astype("<i4") if (np.abs(x) < 1 << 31).all() else x.astype("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([ids.take(pa.array(some)).to_pylist()], pa.list_(pa.int64())), pa.array([narrow.tobytes()], pa.binary())],
                        names=["dim", "n", "ids", "x"],
                    )

    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(usable)
    return landed(vectors.mapInArrow(run, "dim int, n long, ids array<long>, x binary"), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, place in it, vectors as rows of whole numbers) of each block; the first column holds the counts, the last the blobs."""
    for batch in batches:
        for k in range(batch.num_rows):
            n, blob = batch.column(0)[k].as_py(), batch.column(batch.num_columns - 1)[k].as_buffer()
            yield batch, k, np.frombuffer(blob, "<i4" if blob.size == 4 * n * dim else "<i8").reshape(n, dim).astype(np.int64)


class Fit:
    """The fit list, its moments and its leading components."""

    def __init__(self, blocks: DataFrame, components: int = COMPONENTS):
        found = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        self.dim, self.n = (found["dim"], found["n"]) if found else (0, 0)
        self.blocks = blocks.filter(F.col("dim") == self.dim).select("n", "ids", "x")
        self.sums = self._sums()
        # x - S/n = (x - floor(S/n)) - remainder/n: whole numbers first, so nothing is lost to their size.
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        self.trace = float(self._summed(self._squares).sum()) / self.n if self.n else 0.0
        self.values, self.vectors = leading(self.product, self.dim, components) if self.trace > 0 else (np.empty(0), np.empty((self.dim, 0)))
        kept = self.values > self.dim * EPS * self.trace
        self.values, self.vectors = self.values[kept], self.vectors[:, kept]

    def _sums(self) -> list[int]:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A block has too few rows for its sums to leave 64 bits; the sums of all are added up as decimals.
            for _, _, x in _blocks(batches, dim):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(x.sum(axis=0))], names=["at", "s"])

        sums = self.blocks.select("n", "x").mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = {r["at"]: int(r["s"]) for r in sums.collect()}
        return [found[k] for k in range(dim)] if found else []

    def _summed(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all vectors of ``part``, which maps centred rows to a flat array of one size."""
        dim, whole, shift = self.dim, self.whole, self.rest / self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, _, x in _blocks(batches, dim):
                own = part((x - whole) - shift)
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

        rows = self.blocks.select("n", "x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(rows))
        out[[r["at"] for r in rows]] = [r["v"] for r in rows]
        return out

    @staticmethod
    def _squares(centred: np.ndarray) -> np.ndarray:
        return (centred * centred).sum(axis=0)

    def product(self, directions: np.ndarray) -> np.ndarray:
        """The covariance times ``directions`` (dim x m), by one job."""
        return self._summed(lambda c: (c.T @ (c @ directions)).ravel()).reshape(directions.shape) / self.n

    def identity_error(self) -> float | None:
        """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
        k, turn = len(self.values), self.vectors / np.sqrt(self.values)
        if not k:
            return None

        def moments(centred: np.ndarray) -> np.ndarray:
            w = centred @ turn
            return np.r_[w.sum(axis=0), (w.T @ w).ravel()]

        found = self._summed(moments) / self.n
        mean, second = found[:k], found[k:].reshape(k, k)
        return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(fit: Fit) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every fit row and component."""
    dim, n, whole, rest, error = fit.dim, fit.n, fit.whole, fit.rest, fit.identity_error()
    values, turn, explained = fit.values, fit.vectors / np.sqrt(fit.values), fit.values / (fit.trace or 1.0)
    k = len(values)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def deviations(off: np.ndarray) -> list[int | None]:
        largest = n * (int(np.abs(off).max()) + 1)
        if largest * largest * dim < 1 << 63:
            return ((n * off - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in off.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, x in _blocks(batches, dim):
            if not k:
                continue
            off = x - whole
            ids, each = batch.column(1)[at].as_py(), np.arange(len(x)).repeat(k)
            size = len(each)
            columns = [
                pa.array(ids, pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, n, dtype=np.int64)), pa.array(deviations(off), pa.int64()).take(pa.array(each)),
                pa.array(((off - rest / n) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.blocks.mapInArrow(run, schema)


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``whitened`` of the usable rows of ``rows``, fitted on all of them."""
    return whitened(Fit(fit_blocks(rows, vec_id, embedding), components))
