"""Token ids in a Re-Pair compressed binary format with random access.

Ids and nonterminals are 16-bit symbols. In rounds the frequent pairs of neighbouring
symbols of a shard become nonterminals, and every place of them is replaced from the left, until a round gains little. The
id 0 that ends a document is in no rule, so each document is a run of symbols of its own, and the expansion length kept for
every nonterminal lets a reader find any token without expanding what stands before it.

A shard is one row of a Parquet table: bytes in the layout of ``dump`` and the index of its documents. Shards are made from
rows in ascending id order (null ids first, repeated ids by text hash), about ``SHARD_TOKENS`` tokens each; a document is
never split. Defined results: a null or empty text is its end id; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.tokens import END, encoder

SHARD_TOKENS = 1 << 20
SYMBOLS = 1 << 16
RULES_A_ROUND = 4096
ROUNDS = 6
LEAST_PLACES = 8
LEAST_GAIN = 0.03
MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIQ")  # magic, first nonterminal, rules, symbols


@dataclass(frozen=True)
class Grammar:
    """``rules[k]`` is the pair that nonterminal ``first + k`` stands for, ``lengths[k]`` its number of tokens."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    stream: np.ndarray

    def dump(self) -> bytes:
        head = HEAD.pack(MAGIC, self.first, len(self.rules), len(self.stream))
        return head + self.rules.astype("<u2").tobytes() + self.lengths.astype("<u4").tobytes() + self.stream.astype("<u2").tobytes()

    @staticmethod
    def load(blob: bytes) -> Grammar:
        magic, first, rules, symbols = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size
        pairs = np.frombuffer(blob, "<u2", 2 * rules, at).reshape(rules, 2)
        lengths = np.frombuffer(blob, "<u4", rules, at + 4 * rules)
        return Grammar(first, pairs, lengths, np.frombuffer(blob, "<u2", symbols, at + 8 * rules))

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        long = symbols >= self.first
        lengths = np.ones(len(symbols), dtype=np.int64)
        lengths[long] = self.lengths[symbols[long].astype(np.int64) - self.first]
        return lengths

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids (unsigned 32-bit) that the symbols stand for."""
        if len(symbols) <= len(self.rules):
            return self._by_levels(symbols)
        # Many symbols: every rule is expanded once, each symbol takes its own stretch of the result.
        stretches = np.concatenate([np.arange(self.first, dtype="<u4"), self._by_levels(np.arange(len(self.rules)) + self.first)])
        starts = np.concatenate([np.arange(self.first), self.first + np.cumsum(np.r_[0, self.lengths[:-1]], dtype=np.int64)[: len(self.rules)]])
        sizes = self.symbol_lengths(symbols)
        ends = sizes.cumsum()
        return stretches[np.arange(ends[-1]) + np.repeat(starts[symbols] - (ends - sizes), sizes)]

    def _by_levels(self, symbols: np.ndarray) -> np.ndarray:
        """Each pass opens one level of rules."""
        while (long := symbols >= self.first).any():
            out = np.repeat(symbols, long + 1)
            at = np.flatnonzero(long)
            pairs = self.rules[symbols[at].astype(np.int64) - self.first]
            at = at + np.arange(len(at))
            out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols.astype("<u4")

    def tokens(self, symbol_start: int, symbol_end: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the document that the symbols of this range are; only symbols that touch them are expanded."""
        own = self.stream[symbol_start:symbol_end]
        ends = self.symbol_lengths(own).cumsum()
        i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        skipped = int(ends[i - 1]) if i else 0
        return self.expand(own[i : j + 1])[start - skipped : stop - skipped]


def compress(ids: np.ndarray, rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND, least_places: int = LEAST_PLACES) -> Grammar:
    """Re-Pair in rounds over ids below 65536."""
    first = int(ids.max(initial=0)) + 1
    if first > SYMBOLS:
        raise ValueError("ids need 16 bits at most")
    stream, rules, lengths = ids.astype(np.uint16), np.empty((0, 2), np.uint16), np.empty(0, np.int64)
    for _ in range(rounds):
        room = min(rules_a_round, SYMBOLS - first - len(rules))
        if room <= 0 or len(stream) < 2:
            break
        code = (stream[:-1].astype(np.uint32) << 16) | stream[1:]
        code[(stream[:-1] == 0) | (stream[1:] == 0)] = 0  # no rule holds a document's end
        chosen = _frequent(code, room, least_places)
        if not len(chosen):
            break
        rule, at = _places(code, chosen)
        used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)))
        renamed = np.zeros(len(chosen), dtype=np.uint16)
        renamed[used] = first + len(rules) + np.arange(len(used))
        pairs = np.stack([chosen[used] >> 16, chosen[used] & 0xFFFF], axis=1).astype(np.uint16)
        sizes = np.r_[np.ones(first, np.int64), lengths][pairs]
        before = len(stream)
        kept = np.ones(before, dtype=bool)
        kept[at + 1] = False
        stream = stream.copy()
        stream[at] = renamed[rule]
        stream = stream[kept]
        rules, lengths = np.concatenate([rules, pairs]), np.concatenate([lengths, sizes.sum(axis=1)])
        if before - len(stream) < LEAST_GAIN * before:
            break
    return Grammar(first, rules, lengths, stream)


def _frequent(code: np.ndarray, most: int, least_places: int) -> np.ndarray:
    """The ``most`` most frequent pairs that stand ``least_places`` times or more, in ascending order; ties by code."""
    ordered = np.sort(code)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[starts, len(ordered)])
    values = ordered[starts]
    often = np.flatnonzero((counts >= least_places) & (values > 0))
    if len(often) > most:
        often = often[np.argsort(-counts[often], kind="stable")[:most]]
    return np.sort(values[often])


def _slots(code: np.ndarray) -> np.ndarray:
    """Places of pairs in a table of 2**18 slots: the high bits of a product with an odd constant."""
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(14)


def _places(code: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``chosen``, position) of the pairs to replace; of overlapping ones the first, third and so on of a row.

    Of chosen pairs with the same slot only the last is replaced; the others are as frequent in the next round.
    """
    pair, place = np.zeros(1 << 18, dtype=np.uint32), np.zeros(1 << 18, dtype=np.int32)
    slots = _slots(chosen)
    pair[slots], place[slots] = chosen, np.arange(len(chosen))
    slots = _slots(code)
    at = np.flatnonzero((pair[slots] == code) & (code > 0))
    if not len(at):
        return at, at
    starts = np.r_[True, np.diff(at) != 1]
    run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    at = at[(np.arange(len(at)) - run) % 2 == 0]
    return place[slots[at]], at


SHARD = "part int, shard int, n_tokens long, doc_ids array<long>, token_starts array<long>, symbol_starts array<long>, blob binary"


def write(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS, parts: int | None = None) -> None:
    """Write the ids of every document, in ascending id order, as a table of shards at ``path``.

    ``parts`` is the number of id ranges that are written side by side (the session's number of shuffle partitions by default).
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).withColumn("tie", F.xxhash64("t"))
    rows = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select(F.spark_partition_id().alias("part"), "id", "t")

    def shard(part: int, number: int, ids: list[int | None], blobs: list[bytes]) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(blobs), dtype="<u4")
        starts = np.cumsum([0] + [len(b) // 4 for b in blobs[:-1]])
        grammar = compress(tokens)
        # Every document begins after an end id, which is a symbol by itself; an id 0 inside a text is one as well.
        ends = np.flatnonzero(grammar.stream == 0) + 1
        token_ends = grammar.symbol_lengths(grammar.stream).cumsum()[ends - 1]
        at = np.r_[0, ends][np.searchsorted(np.r_[0, token_ends], starts)]
        values = [[part], [number], [len(tokens)], [ids], [starts.tolist()], [at.tolist()], [grammar.dump()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        names = [f.split()[0] for f in SHARD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, blobs, size = 0, 0, [], [], 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            for own, blob in zip(batch.column(1), encoder(vocabulary).encode(t.as_py() for t in batch.column(2))):
                ids.append(own.as_py())
                blobs.append(blob + END)
                size += len(blobs[-1]) // 4
                if size >= shard_tokens:
                    yield shard(part, number, ids, blobs)
                    number, ids, blobs, size = number + 1, [], [], 0
        if ids:
            yield shard(part, number, ids, blobs)

    rows.mapInArrow(run, SHARD).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the shards at ``path``; ``start`` counts all ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar.load(row["blob"])
                tokens = grammar.expand(grammar.stream).tobytes()
                starts = row["token_starts"]
                ends = [*starts[1:], row["n_tokens"]]
                columns = [
                    pa.array([row["part"]] * len(starts), pa.int32()), pa.array([row["shard"]] * len(starts), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array([j - i for i, j in zip(starts, ends)], pa.int64()),
                    pa.array([zlib.crc32(tokens[4 * i : 4 * j]) for i, j in zip(starts, ends)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARD).parquet(path)
    found = shards.select("part", "shard", "n_tokens", "doc_ids", "token_starts", "blob").mapInArrow(
        run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    sizes = shards.select("part", "shard", "n_tokens")
    # One row per id range, then one row per shard inside its range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part")
    bases = bases.select("part", "shard", (F.col("base") + F.col("inner")).alias("base"))
    return found.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def document(spark: SparkSession, path: str, doc_id: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one document, from its shard alone."""
    row = spark.read.schema(SHARD).parquet(path).filter(F.array_contains("doc_ids", doc_id)).first()
    if row is None:
        raise KeyError(doc_id)
    k = row["doc_ids"].index(doc_id)
    grammar = Grammar.load(row["blob"])
    token_ends, symbol_ends = [*row["token_starts"][1:], row["n_tokens"]], [*row["symbol_starts"][1:], len(grammar.stream)]
    length = token_ends[k] - row["token_starts"][k]
    return grammar.tokens(row["symbol_starts"][k], symbol_ends[k], start, length if stop is None else min(stop, length))
