"""SimHash near-duplicates: every pair of fingerprints within a radius, by exact comparison of tiles.

Distinct fingerprints are dealt into tiles that share one of ``radius`` + 1 bands of bits: two fingerprints that differ in
at most ``radius`` bits agree on one band at least, so no link is lost. A tile's rows are sorted by population count and
compared block by block with exclusive-or and bit counts; a pair of blocks whose counts differ by more than the radius is
skipped. A tile beyond ``TILE_ROWS`` is divided by bands of its rows' other bits, and what is still too large into parts by
population count, of which those within the radius meet pair by pair. A tile puts out one edge per linked row at most, not its pairs.

Defined results: null and empty texts and those without words have fingerprint zero and link like any other; equal texts
share a fingerprint; rows with a null id get a component like any row, named by the smallest id in it (null when it has
none); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.graph import components
from caseflow.llm.store import landed

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 4096
BLOCK = 512
HASHES_AT_ONCE = 1 << 16
SALTS = 16


def fingerprint(text: str | None) -> int:
    """64 bits, as a signed integer: a bit is one if it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z changes, only the six ASCII blanks part
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    shingles = map(b" ".join, zip(*[words[k:] for k in range(size)]))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    counts, n = np.zeros(64, dtype=np.int64), 0
    while len(some := np.fromiter(islice(hashes, HASHES_AT_ONCE), dtype="<u8")):
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _prints(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id: ``kind``, fp: long) of rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp: long) of every row."""
    return _prints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "long")


def _bands(bits: int, radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``radius`` + 1 bands that cover ``bits`` bits."""
    edges = [bits * k // (radius + 1) for k in range(radius + 2)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def _cut(value: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << bits) - 1)


def _without(low: int, bits: int) -> Column:
    """The bits of ``fp`` outside a band, moved together."""
    below = F.col("fp").bitwiseAND((1 << low) - 1)
    return below if low + bits == 64 else F.shiftleft(F.shiftrightunsigned("fp", low + bits), low).bitwiseOR(below)


TILE = ["band", "value", "sub", "sub_value"]


def _tiles(groups: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(band, value, sub, sub_value, low, high, fp): the rows of each tile, or of each pair of parts of a crowded one.

    Rows of a band value that more than ``tile_rows`` share agree on one band of their other bits as well, so these
    make finer tiles in its place. A finer tile that is still crowded is cut into parts by ascending population count; a
    part meets only those whose counts come within the radius of its rows'.
    """
    bands = F.array(
        *[
            F.struct(F.lit(k).alias("band"), _cut(F.col("fp"), low, bits).alias("value"), _without(low, bits).alias("others"))
            for k, (low, bits) in enumerate(_bands(64, radius))
        ]
    )
    rows = groups.select("fp", F.inline(bands))
    large = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile_rows)
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_value")))
    subs = _bands(64 - 64 // (radius + 1), radius)
    finer = F.array(*[F.struct(F.lit(k).alias("sub"), _cut(F.col("others"), low, bits).alias("sub_value")) for k, (low, bits) in enumerate(subs)])
    sorted_out = rows.join(large, ["band", "value"], "left").select("fp", "band", "value", F.inline(F.when(F.col("n").isNull(), whole).otherwise(finer)))
    tiles = sorted_out.withColumn("ones", F.bit_count("fp"))

    # At most 65 population counts in a tile: the places of their rows, and those of the rows they can be linked to.
    cells = tiles.filter("sub >= 0").groupBy(*TILE, "ones").agg(F.count(F.lit(1)).alias("n"))
    tile = Window.partitionBy(*TILE)
    placed = cells.withColumn("end", F.sum("n").over(tile.orderBy("ones"))).withColumn("total", F.sum("n").over(tile)).filter(F.col("total") > tile_rows)
    near = tile.orderBy("ones").rangeBetween(-radius, radius)
    start = F.col("end") - F.col("n")
    reach = placed.select(*TILE, "ones", "n", start.alias("start"), F.min(start).over(near).alias("least"), F.max("end").over(near).alias("most"))

    part = lambda place: F.coalesce(F.floor(place / tile_rows), F.lit(0)).cast("int")
    split = tiles.join(reach, [*TILE, "ones"], "left")
    split = split.withColumn("own", part(F.col("start") + F.pmod(F.xxhash64("fp"), F.col("n"))))
    pairs = F.transform(
        F.sequence(part(F.col("least")), part(F.col("most") - 1)),
        lambda k: F.struct(F.least("own", k).alias("low"), F.greatest("own", k).alias("high")),
    )
    return split.select(*TILE, F.inline(pairs), "fp")


def _unite(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[k] and b[k] in ``roots``, which keeps each row's smallest member."""
    while len(a):
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a tile the place of the first member of its class; ``fps`` is unsigned, in any order."""
    ones = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(ones, kind="stable")
    fps, ones, roots = fps[order], ones[order], np.arange(len(fps))
    for i in range(0, len(fps), BLOCK):
        left = fps[i : i + BLOCK]
        for j in range(i, len(fps), BLOCK):
            if ones[j] - ones[min(i + BLOCK, len(fps)) - 1] > radius:
                break  # and so are all later blocks
            near = np.bitwise_count(left[:, None] ^ fps[None, j : j + BLOCK]) <= radius
            a, b = np.nonzero(near)
            keep = a + i < b + j
            _unite(roots, a[keep] + i, b[keep] + j)
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = order[roots]
    return out


def _links(radius: int):
    """Edges of the tiles of a partition that is sorted by tile; a tile may go on in the next batch."""

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(keys)]
        a, b = [], []
        for start, end in zip(starts, ends):
            if end - start > 1:
                own = fps[start:end]
                roots = linked(own.view(np.uint64), radius)
                moved = np.flatnonzero(roots != np.arange(len(own)))
                a.append(own[moved])
                b.append(own[roots[moved]])
        none = np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(TILE) + 2
        keys, fps = np.empty((0, width), dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(width + 1)]
            keys, fps = np.concatenate([keys, np.stack(columns[:width], axis=1)]), np.concatenate([fps, columns[width]])
            done = len(keys) - int((keys == keys[-1]).all(axis=1)[::-1].cumprod().sum())
            if done:
                yield edges(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            yield edges(keys, fps)

    return run


def near_duplicates(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, salts: int = SALTS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``prints`` (doc_id, fp)."""
    prints = landed(prints.select("doc_id", "fp"), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    key = [*TILE, "low", "high"]
    tiles = _tiles(groups, radius, tile_rows).repartition(*key).sortWithinPartitions(*key)
    roots = components(tiles.mapInArrow(_links(radius), "a long, b long"))
    placed = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # Many fingerprints may share a root, and many rows a fingerprint: the one row of each name is repeated per salt, the
    # many rows are dealt over the salts.
    named = _dealt(placed, "fp", salts).join(_repeated(names, salts), ["root", "salt"]).select("fp", "component_id")
    return _dealt(prints, "doc_id", salts).join(_repeated(named, salts), ["fp", "salt"]).select("doc_id", "fp", "component_id")


def _dealt(rows: DataFrame, by: str, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def _repeated(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without their near-duplicates: of each component one row stays, that of the smallest id.

    Rows are told apart by id and text, so rows with one id and different texts each belong to their own text's component. Null
    ids come last; among equal ids the smaller hash of the text decides; of rows equal in both one stays.
    """
    id_ = F.col(doc_id).cast("long")
    key = {"_simhash_null": id_.isNull(), "_simhash_id": F.coalesce(id_, F.lit(0)), "_simhash_text": F.xxhash64(text)}
    keyed = docs.withColumns(key)
    kind = "struct<_simhash_null: boolean, _simhash_id: bigint, _simhash_text: bigint>"
    prints = _prints(keyed.select(F.struct(*key).alias("doc_id"), F.col(text).alias("text")), kind)
    found = near_duplicates(prints)
    first = found.filter("doc_id = component_id").select("doc_id.*")
    return keyed.join(first, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)
