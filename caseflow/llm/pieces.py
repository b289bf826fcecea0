"""Encoding into and decoding from unigram pieces, giant documents by a max-plus scan.

A document of up to ``CHUNK`` characters is encoded as it stands. A longer one is cut into chunks, at the last word boundary
of a chunk or, inside a word longer than a chunk, anywhere. A boundary's state is the number of characters by which a piece
reaches over it. Each chunk yields the matrix of the best sums from each entry state to each exit state; matrices combine by
max-plus products, which are associative, first within groups of ``GROUP`` chunks and then over a document's groups; going
back from the end gives every boundary its state, and each chunk is segmented between its two states by itself.

Defined results: a null or empty text has no pieces; null and repeated ids and repeated rows are encoded like any other; an
empty table gives an empty one; columns other than id and text are ignored. Sums are whole numbers, so a giant document's
total is that of one pass; only among equal sums may a chunked word of more than ``CHUNK`` characters be cut otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.store import landed
from caseflow.llm.unigram import CHARS_AT_ONCE, LOW, Vocabulary, vocabulary

CHUNK = 16_384
GROUP = 64
ROWS_AT_ONCE = 500
PIECES = "doc_id long, row long, chunk long, text string, ids array<int>"


def chunks(text: str, size: int, longest: int) -> list[tuple[str, str, bool]]:
    """(own characters, those a piece may reach into the next chunk, whether the chunk ends inside a word)."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            out.append((text[at:], "", False))
            break
        # A word boundary is a blank after another character.
        cut = next((k for k in range(end, at, -1) if text[k] == " " and text[k - 1] != " "), None)
        end = cut or end
        out.append((text[at:end], "" if cut else text[end : end + longest - 1], not cut))
        at = end
    return out


def transfer(words: Vocabulary, own: str, ahead: str, from_word: bool) -> np.ndarray:
    """Best sums from entry state (row) to exit state (column); an impossible way is ``LOW``."""
    states = words.longest
    matrix = np.full((states, states), LOW, dtype=np.int64)
    text, width = own + ahead, states if from_word else 1
    entries = range(min(width, len(own) + 1))
    first = next((k for k in range(1, len(own)) if own[k] == " " and own[k - 1] != " "), None)
    if first is None:
        # One word: a row of sums, one per entry, for each place.
        best = np.full((len(text) + 1, states), LOW, dtype=np.int64)
        _spread(words, text, best, entries, len(own))
        for e in range(len(ahead) + 1):
            matrix[:, e] = _reach(words, text, best, len(own), e)
        for s in entries:
            if s >= len(own):  # the piece that enters goes on into the next chunk
                matrix[s, s - len(own)] = max(matrix[s, s - len(own)], 0)
        return matrix
    last = next(k for k in range(len(own) - 1, 0, -1) if own[k] == " " and own[k - 1] != " ")
    middle = int(words.scores[words.encode(own[first:last])].sum())
    tail = np.full((len(text) - last + 1, 1), LOW, dtype=np.int64)
    _spread(words, text[last:], tail, range(1), len(own) - last)
    ends = [_reach(words, text[last:], tail, len(own) - last, e)[0] for e in range(len(ahead) + 1)]
    for s in [s for s in entries if s <= first]:
        head = int(words.scores[words.encode(own[s:first])].sum())
        for e, end in enumerate(ends):
            if end > LOW:
                matrix[s, e] = head + middle + end
    return matrix


def _spread(words: Vocabulary, text: str, best: np.ndarray, entries, boundary: int) -> None:
    """Fill the best sums up to the boundary; entry s starts at place s."""
    for s in entries:
        if s <= boundary:
            best[s, s] = 0
    for end in range(1, boundary + 1):
        for start, score in words.edges(text, end):
            np.maximum(best[end], np.where(best[start] > LOW, best[start] + score, LOW), out=best[end])


def _reach(words: Vocabulary, text: str, best: np.ndarray, boundary: int, e: int) -> np.ndarray:
    """Best sums of the ways whose first break at or after the boundary is ``e`` characters behind it."""
    if e == 0:
        return best[boundary].copy()
    top = np.full(best.shape[1], LOW, dtype=np.int64)
    for start, score in words.edges(text, boundary + e):
        if start < boundary:
            np.maximum(top, np.where(best[start] > LOW, best[start] + score, LOW), out=top)
    return top


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    sums = np.where((a[:, :, None] > LOW) & (b[None, :, :] > LOW), a[:, :, None] + b[None, :, :], LOW)
    return sums.max(axis=1)


def walk(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all boundaries of a best way from ``entry`` to ``leave``; of equal ones the smallest state, from the end on."""
    front = [np.full(len(matrices[0]), LOW, dtype=np.int64)]
    front[0][entry] = 0
    for m in matrices:
        front.append(product(front[-1][None, :], m)[0])
    states = [leave]
    for k in range(len(matrices) - 1, -1, -1):
        ways = np.where((front[k] > LOW) & (matrices[k][:, states[-1]] > LOW), front[k] + matrices[k][:, states[-1]], LOW)
        states.append(int(ways.argmax()))
    return states[::-1]


def _matrix(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(blob, dtype=np.int64)
    return flat.reshape(int(len(flat) ** 0.5), -1)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    """A row per array; pyarrow would copy unsigned numbers into it one at a time."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, "<u4"), *ids]).view(np.int32))


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHARS_AT_ONCE`` characters in the column at ``text``: a worker holds one slice's results."""
    ends = np.cumsum(pc.utf8_length(batch.column(text)).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHARS_AT_ONCE)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if i < j)


def _in_order(group: pd.DataFrame, by: str) -> tuple[pd.DataFrame, list[np.ndarray]]:
    group = group.sort_values(by)
    return group, [_matrix(b) for b in group["matrix"]]


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    group, matrices = _in_order(group, "chunk")
    whole = matrices[0]
    for m in matrices[1:]:
        whole = product(whole, m)
    return pd.DataFrame({"row": [group["row"].iloc[0]], "part": [group["part"].iloc[0]], "matrix": [whole.tobytes()]})


def _part_states(group: pd.DataFrame) -> pd.DataFrame:
    group, matrices = _in_order(group, "part")
    states = walk(matrices, 0, 0)
    return pd.DataFrame({"row": group["row"], "part": group["part"], "entry": states[:-1], "leave": states[1:]})


def _chunk_states(group: pd.DataFrame) -> pd.DataFrame:
    group, matrices = _in_order(group, "chunk")
    states = walk(matrices, int(group["entry"].iloc[0]), int(group["leave"].iloc[0]))
    return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "enters": states[:-1], "leaves": states[1:]})


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, chunk, text, ids): the pieces of every document, giant ones in a row per chunk.

    ``row`` tells the documents apart that are in several chunks, ``text`` is what the ids of the row stand for.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(F.lit(" "), F.col(text)).alias("t"))
    rows = rows.withColumn("t", F.when(F.length("t") > 1, F.col("t")).otherwise(""))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for part in (part for batch in batches for part in _slices(batch, 1)):
            ids = _lists(list(words.encode_all(t.as_py() for t in part.column(1))))
            none = pa.array([None] * len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), none, none, part.column(1), ids], names=["doc_id", "row", "chunk", "text", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = vocabulary(model).longest
        for batch in batches:
            for own_id, row, t in zip(*[c.to_pylist() for c in batch.columns]):
                parts = chunks(t, chunk, longest)
                own, ahead, inside = zip(*parts)
                values = [[own_id] * len(parts), [row] * len(parts), list(range(len(parts))), own, ahead, (False, *inside[:-1])]
                names = ["doc_id", "row", "chunk", "own", "ahead", "from_word"]
                yield pa.RecordBatch.from_pydict(dict(zip(names, values)))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for part in (part for batch in batches for part in _slices(batch, 2)):
            row, number, own, ahead, from_word = [c.to_pylist() for c in part.columns]
            found = [transfer(words, *x).tobytes() for x in zip(own, ahead, from_word)]
            yield pa.RecordBatch.from_pydict({"row": row, "chunk": number, "matrix": found})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for part in (part for batch in batches for part in _slices(batch, 3)):
            own_id, row, number, own, ahead, enters, leaves = [c.to_pylist() for c in part.columns]
            texts = [(o + a[:e])[s:] for o, a, s, e in zip(own, ahead, enters, leaves)]
            ids = _lists(list(words.encode_all(texts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own_id, pa.int64()), pa.array(row, pa.int64()), pa.array(number, pa.int64()), pa.array(texts, pa.string()), ids],
                names=["doc_id", "row", "chunk", "text", "ids"],
            )

    short = rows.filter(F.length("t") <= chunk).mapInArrow(whole, PIECES)
    giant = rows.filter(F.length("t") > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "t")
    cuts = landed(giant.mapInArrow(cut, "doc_id long, row long, chunk long, own string, ahead string, from_word boolean"), "chunks")
    # Chunks of one document lie in one file; they are dealt anew, so that a giant one does not keep to one task.
    parts = cuts.select("row", "chunk", "own", "ahead", "from_word").repartition("row", "chunk").mapInArrow(matrices, "row long, chunk long, matrix binary")
    parts = landed(parts.withColumn("part", F.floor(F.col("chunk") / GROUP)), "matrices")
    # A group's time is not in its few bytes: numbered partitions, else adaptive execution puts all groups into one task.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, "row", "part")
    groups = parts.groupBy("row", "part").applyInPandas(_combine, "row long, part long, matrix binary")
    ends = groups.repartition(tasks, "row").groupBy("row").applyInPandas(_part_states, "row long, part long, entry int, leave int")
    states = parts.join(ends, ["row", "part"]).groupBy("row", "part").applyInPandas(_chunk_states, "row long, chunk long, enters int, leaves int")
    cut_rows = cuts.join(states, ["row", "chunk"]).select("doc_id", "row", "chunk", "own", "ahead", "enters", "leaves")
    return short.unionByName(cut_rows.mapInArrow(back, PIECES))


def decode(pieces: DataFrame, model: str) -> DataFrame:
    """``pieces`` with ``decoded``: the string of each row's ids. A document is its rows in chunk order without the first blank."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(model)
        for batch in batches:
            yield pa.concat_arrays([words.decode_lists(batch.slice(at, ROWS_AT_ONCE)) for at in range(0, max(len(batch), 1), ROWS_AT_ONCE)])

    return pieces.withColumn("decoded", text("ids"))
