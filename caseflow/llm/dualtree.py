"""Exact ranked lexical search by two trees: one over the items (queries), one over the documents of each shard.

A node holds, per term, the largest weight of its items or the largest part of its documents. The product of an item node and
a document node bounds every score between them; where it lies below the weakest k-th score of the node's items, the whole
batch of pairs is skipped. What is left goes down: to the node's children, to the documents' next level, and in the end to
single documents, whose scores are exact integers.

Scores are whole numbers. A term's weight is floor(1000 ln((2N+2) / (2 df+1))), a document's part of a term
(1000000000 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, and a score is the sum of weight times part over the item's
terms, repeats included. N counts the documents with a term, L their terms, n those of one document.

Documents become shards of bounded size, each a row of a table in the shared folder: postings of the terms that items hold, by
term and document, documents of one kind and length side by side. Both passes over it are linear: the first has every shard
put forward the leaf that looks best for each item, whose scores give each item a k-th score that is true for all shards;
the second searches under it. Shards' best rows merge into the exact answer.

Items go in blocks of about ``BLOCK_TERMS`` terms, so that what tasks receive is bounded; a set of items of any size needs as
many passes over the documents as it has blocks.

Defined results: a null or empty text has no terms, finds nothing and is never found; a null item_id asks nothing; rows with
one item_id are one item, their terms added up; a document with a null id can be found, and comes first among equal scores;
rows with one doc_id are documents of their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.store import landed

BLOCK_TERMS = 1_000_000
SHARD_DOCS = 1 << 14
SHARD_POSTINGS = 2_000_000
SHARD_WORDS = 1 << 22
LEAF, FAN = 16, 8
PART_MOST = 1_000_000  # no document's part of a term exceeds it
INDEX = "ids array<long>, lengths binary, terms binary, starts binary, docs binary, tfs binary"
#: Bytes that end a term become blanks, A-Z become a-z; bytes from 128 on belong to terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: pa.StringScalar | pa.LargeStringScalar) -> list[bytes]:
    """The terms of a whole text, in order; none of a null."""
    blob = text.as_buffer()
    return [] if blob is None else blob.to_pybytes().translate(TERM_BYTES).split()


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times) of the rows of ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, t in zip(batch.column(0), batch.column(1)):
                seen = Counter(terms_of(t))
                columns = [pa.array([own.as_py()] * len(seen), pa.int64()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "term", "times"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter("item_id IS NOT NULL")
    return rows.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _shard(ids: list[int | None], lengths: np.ndarray, codes: np.ndarray, size: int) -> pa.RecordBatch:
    """A shard of documents whose terms' codes follow one another; code -1 is a term that no item holds."""
    docs = np.repeat(np.arange(len(ids)), lengths)
    held = codes >= 0
    keys, tfs = np.unique(docs[held] * size + codes[held], return_counts=True)
    docs, codes = keys // size, keys % size
    # A language shows in the term a document repeats most: by it, then by length, alike documents come together.
    by_use = np.lexsort((codes, -tfs, docs))
    first = by_use[np.flatnonzero(np.r_[True, docs[by_use][1:] != docs[by_use][:-1]])] if len(docs) else by_use
    kind = np.full(len(ids), -1)
    kind[docs[first]] = codes[first]
    order = np.lexsort((lengths, kind))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    docs = place[docs]
    by_term = np.lexsort((docs, codes))
    codes, docs, tfs = codes[by_term], docs[by_term].astype(np.int32), tfs[by_term].astype(np.int32)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    blobs = [lengths[order].astype(np.int64), codes[starts].astype(np.int32), starts.astype(np.int64), docs, tfs]
    values = [pa.array([[ids[k] for k in order.tolist()]], pa.list_(pa.int64())), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]]
    return pa.RecordBatch.from_arrays(values, names=["ids", "lengths", "terms", "starts", "docs", "tfs"])


def index(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Shards of the documents that have a term, over the terms of ``vocabulary``, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {term: k for k, term in enumerate(vocabulary)}
        ids, lengths, codes, words = [], [], [], 0

        def shard() -> pa.RecordBatch:
            return _shard(ids, np.array(lengths, dtype=np.int64), np.concatenate(codes), max(1, len(code)))

        for batch in batches:
            for own, t in zip(batch.column(0), batch.column(1)):
                found = terms_of(t)
                if found:
                    ids.append(own.as_py())
                    lengths.append(len(found))
                    codes.append(np.fromiter(map(code.get, found, repeat(-1)), dtype=np.int32, count=len(found)))
                    words += len(found)
                    if len(ids) >= shard_docs or words >= SHARD_WORDS:
                        yield shard()
                        ids, lengths, codes, words = [], [], [], 0
        if ids:
            yield shard()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return landed(rows.mapInArrow(run, INDEX), "dual-tree-index")


def totals(shards: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                found = np.frombuffer(blob.as_buffer(), np.int64)
                yield pa.RecordBatch.from_pydict({"n": [len(found)], "words": [int(found.sum())]})

    row = shards.select("lengths").mapInArrow(run, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    return row["n"] or 0, row["words"] or 0


def frequencies(shards: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts, docs in zip(*batch.columns):
                terms, starts = np.frombuffer(terms.as_buffer(), np.int32), np.frombuffer(starts.as_buffer(), np.int64)
                dfs = np.diff(np.r_[starts, docs.as_buffer().size // 4]) if len(starts) else starts
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(dfs)], names=["term", "df"])

    found = shards.select("terms", "starts", "docs").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[found["term"].to_numpy(dtype=np.int64)] = found["df"].to_numpy(dtype=np.int64)
    return out


def weights(dfs: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2N+2) / (2 df+1))) of each term."""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * dfs + 1.0))).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = sizes.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class ItemTree:
    """Items sorted so that alike ones are neighbours; a node holds the largest weight its items give each term.

    ``nodes[0]`` are the items, the last level is the root; a node is (terms, weights, first child, end of children).
    """

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], weighted: list[np.ndarray], word_weight: np.ndarray):
        # The most frequent term tells the language, the rarest the subject.
        least = [(int(t[word_weight[t].argmin()]), int(t[word_weight[t].argmax()])) if len(t) else (-1, -1) for t in terms]
        order = sorted(range(len(terms)), key=least.__getitem__)
        self.ids = ids[order]
        self.nodes = [[(terms[k], weighted[k], at, at + 1) for at, k in enumerate(order)]]
        while len(self.nodes[-1]) > 1:
            below = self.nodes[-1]
            self.nodes.append([self._over(below, k, min(k + FAN, len(below))) for k in range(0, len(below), FAN)])

    @staticmethod
    def _over(below: list, start: int, end: int) -> tuple:
        terms, weighted = (np.concatenate([node[side] for node in below[start:end]]) for side in (0, 1))
        order = np.argsort(terms, kind="stable")
        terms, weighted = terms[order], weighted[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, np.int64)
        return terms[first], np.maximum.reduceat(weighted, first) if len(first) else weighted, start, end


class DocTree:
    """The documents of a shard: per level the entries (term, node) with the largest part, and their entries one level down.

    Level 0 are the postings themselves, level 1 leaves of ``LEAF`` documents, each further level joins ``FAN`` nodes.
    """

    def __init__(self, row: dict, n: int, words: int):
        self.ids = row["ids"]
        lengths, tfs = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        docs = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        self.terms, starts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["starts"], np.int64)
        # Python's whole numbers: the product of a long text's length and the number of documents may leave 64 bits.
        m = np.array([25 + 75 * own * n // words for own in lengths.tolist()], dtype=np.int64)
        self.code = np.repeat(self.terms, np.diff(np.r_[starts, len(docs)])) if len(docs) else docs
        self.levels = [(docs, 1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]), None, None)]
        self.codes = [self.code]
        self.sizes = [len(self.ids)]
        fan, term_start = LEAF, starts
        while self.sizes[-1] > 1 or len(self.levels) == 1:
            node, most = self.levels[-1][0] // fan, self.levels[-1][1]
            first = np.zeros(len(node), dtype=bool)
            first[term_start] = True
            first[1:] |= node[1:] != node[:-1]
            entry = np.flatnonzero(first)
            size = np.diff(np.r_[entry, len(node)])
            most = np.maximum.reduceat(most, entry) if len(entry) else most
            term_start = np.searchsorted(entry, term_start)
            self.levels.append((node[entry], most, entry, size))
            self.codes.append(self.codes[-1][entry])
            self.sizes.append(-(-self.sizes[-1] // fan))
            fan = FAN
        self.top = np.r_[term_start, len(self.levels[-1][0])]


class Search:
    """One shard under one item tree; ``best[i]`` is the k-th score item ``i`` is known to have somewhere, ``found`` its rows here."""

    def __init__(self, items: ItemTree, docs: DocTree, floors: np.ndarray, k: int, vocabulary: int):
        self.items, self.docs, self.k = items, docs, k
        self.best = floors.copy()
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items.ids)
        self.weight = np.zeros(vocabulary, dtype=np.int64)
        self.pairs = 0

    def _top(self, terms: np.ndarray) -> np.ndarray:
        """The root's entries of those terms that the shard has."""
        at = np.searchsorted(self.docs.terms, terms)
        own = at < len(self.docs.terms)
        own[own] = self.docs.terms[at[own]] == terms[own]
        at = at[own]
        return _ranges(self.docs.top[at], self.docs.top[at + 1] - self.docs.top[at])

    def _bounds(self, node: tuple, level: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of the node's terms, bound per document node) at a level."""
        terms, weighted = node[:2]
        self.weight[terms] = weighted
        own = self.weight[self.docs.codes[level][entries]]
        self.weight[terms] = 0
        entries, own = entries[own > 0], own[own > 0]
        where, most = self.docs.levels[level][:2]
        parts, size = own * most[entries], self.docs.sizes[level]
        if float(weighted.sum()) * PART_MOST < 2.0**53:  # a float holds every sum exactly
            return entries, np.bincount(where[entries], parts, size).astype(np.int64)
        bound = np.zeros(size, dtype=np.int64)
        np.add.at(bound, where[entries], parts)
        return entries, bound

    def _down(self, level: int, entries: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The entries one level below those of the nodes that are alive."""
        where, _, below, size = self.docs.levels[level]
        kept = entries[alive[where[entries]]]
        return _ranges(below[kept], size[kept])

    def _scores(self, item: int, entries: np.ndarray) -> None:
        """Take the exact scores of the documents that ``entries`` of level 0 hold."""
        _, score = self._bounds(self.items.nodes[0][item], 0, entries)
        docs = np.flatnonzero((score > 0) & (score >= self.best[item]))
        docs, scores = np.r_[self.found[item][0], docs], np.r_[self.found[item][1], score[docs]]
        if len(docs) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            docs, scores = docs[scores >= least], scores[scores >= least]
            self.best[item] = max(self.best[item], least)
        self.found[item] = docs, scores

    def run(self) -> None:
        root = self.items.nodes[-1][0]
        self._visit(len(self.items.nodes) - 1, 0, len(self.docs.levels) - 1, self._top(root[0]))

    def _visit(self, depth: int, at: int, level: int, entries: np.ndarray) -> None:
        """Pairs of an item node and the document nodes at ``level`` that ``entries`` belong to."""
        node = self.items.nodes[depth][at]
        entries, bound = self._bounds(node, level, entries)
        start, end = at, at + 1
        for d in range(depth, 0, -1):
            start, end = self.items.nodes[d][start][2], self.items.nodes[d][end - 1][3]
        alive = (bound > 0) & (bound >= self.best[start:end].min())
        self.pairs += int(alive.sum()) * (end - start) if level == 1 and depth == 0 else 0
        if not alive.any():
            return
        if depth == 0 and level == 1:
            return self._leaves(at, entries, bound, alive)
        if level > 1:
            entries, level = self._down(level, entries, alive), level - 1
        else:
            entries = entries[alive[self.docs.levels[level][0][entries]]]
        children = range(node[2], node[3]) if depth else (at,)
        for child in children:
            self._visit(max(depth - 1, 0), child, level, entries)

    def _leaves(self, item: int, entries: np.ndarray, bound: np.ndarray, alive: np.ndarray) -> None:
        """An item's leaves from the largest bound down, in growing steps, until none can reach the k-th score."""
        order = np.flatnonzero(alive)
        order = order[np.argsort(-bound[order], kind="stable")]
        done, step = 0, 8
        while done < len(order) and bound[order[done]] >= self.best[item]:
            some = order[done : done + step]
            taken = np.zeros(len(bound), dtype=bool)
            taken[some[bound[some] >= self.best[item]]] = True
            self._scores(item, self._down(1, entries, taken))
            done, step = done + step, step * 4

    def seed(self) -> None:
        """Score, for each item, the leaf that is reached by always taking the best-looking child."""
        for item, node in enumerate(self.items.nodes[0]):
            entries = self._top(node[0])
            for level in range(len(self.docs.levels) - 1, 0, -1):
                entries, bound = self._bounds(node, level, entries)
                taken = np.zeros(len(bound), dtype=bool)
                if bound.max(initial=0) > 0:
                    taken[bound.argmax()] = True
                entries = self._down(level, entries, taken)
            self._scores(item, entries)


def _searched(shards: DataFrame, items: ItemTree, n: int, words: int, floors: np.ndarray, k: int, vocabulary: int, seeding: bool) -> DataFrame:
    """(item, doc_id, score): each shard's rows for each item, its k best among them; from one leaf only when ``seeding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                search = Search(items, DocTree(batch.slice(at, 1).to_pylist()[0], n, words), floors, k, vocabulary)
                search.seed() if seeding else search.run()
                rows = []
                for item, (docs, scores) in enumerate(search.found):
                    own = [search.docs.ids[d] for d in docs.tolist()]
                    top = sorted(zip((-scores).tolist(), own), key=lambda x: (x[0], x[1] is not None, x[1] or 0))[:k]
                    rows += [(item, d, -s) for s, d in top]
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return shards.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str, shard_docs: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block of items, which holds about ``BLOCK_TERMS`` terms."""
    rows = asked.toPandas()
    codes, vocabulary = rows["term"].map(bytes).factorize(sort=True)
    vocabulary = vocabulary.tolist()
    shards = index(docs, vocabulary, doc_id, text, shard_docs)
    n, words = totals(shards)
    word_weight = weights(frequencies(shards, len(vocabulary)), n)
    by_item = rows.assign(code=codes, weight=rows["times"].to_numpy() * word_weight[codes]).sort_values(["item_id", "code"]).groupby("item_id")
    ids = np.array(sorted(by_item.groups), dtype=np.int64)
    items = ItemTree(ids, [by_item.get_group(i)["code"].to_numpy() for i in ids], [by_item.get_group(i)["weight"].to_numpy() for i in ids], word_weight)
    size = len(vocabulary)
    seeds = _ranked(_searched(shards, items, n, words, np.zeros(len(ids), np.int64), k, size, seeding=True), k)
    floors = np.zeros(len(ids), dtype=np.int64)
    for row in seeds.filter(F.col("rank") == k).select("item", "score").collect():
        floors[row["item"]] = row["score"]
    best = _ranked(_searched(shards, items, n, words, floors, k, size, seeding=False), k)
    names = docs.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(items.ids)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 for each item, among all ``docs``."""
    asked = landed(item_terms(items, item_id, text), "dual-tree-items")
    blocks = max(1, -(-asked.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for b in range(blocks if blocks > 1 or asked.take(1) else 0):
        own = asked.filter(block == b)
        if own.take(1):
            rows = _search_block(docs, own, k, doc_id, text, shard_docs)
            found = rows if found is None else found.unionByName(rows)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
