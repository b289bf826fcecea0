"""Token counts by dynamic programming on a trie that pre-tokens share.

The distinct pre-tokens (blanks and a word) of many documents form a trie. It is walked depth-first, that is over the sorted
words, with the best sum and the number of pieces of every prefix on the way down, so a prefix that many words share is scored
once; the number at a word's end is its count. A document's count is the sum over its words. Nothing is shuffled.

Defined results: a null or empty text has no tokens; null and repeated ids and repeated rows are counted like any other; an
empty table gives an empty one; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.unigram import CHARS_AT_ONCE, MOST_WORDS, UNIT, Vocabulary, vocabulary

_KNOWN: dict[str, dict[str, int]] = {}


def terminal_counts(words: Vocabulary, distinct: Iterable[str]) -> dict[str, int]:
    """Pieces in the best segmentation of each of the distinct pre-tokens."""
    return {word: pieces[-1] for word, _, _, pieces in words.paths(sorted(distinct))}


def _counted(texts: list[str], words: Vocabulary, known: dict[str, int]) -> Iterator[tuple[int, int]]:
    """(pre-tokens, tokens) of each text; ``known`` grows up to ``MOST_WORDS``."""
    units = [UNIT.findall(" " + t) if t else [] for t in texts]
    found = [list(map(known.get, own)) for own in units]
    learnt = terminal_counts(words, {u for own, counts in zip(units, found) for u, n in zip(own, counts) if n is None})
    known.update(islice(learnt.items(), max(0, MOST_WORDS - len(known))))
    for own, counts in zip(units, found):
        yield len(own), sum(n or learnt[u] for u, n in zip(own, counts))


def counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = vocabulary(model), _KNOWN.setdefault(model, {})
        for batch in batches:
            n_words, n_tokens, some, size = [], [], [], 0

            def flush():
                for own, tokens in _counted(some, words, known):
                    n_words.append(own)
                    n_tokens.append(tokens)
                some.clear()

            for t in batch.column(1):
                some.append(t.as_py() or "")
                size += len(some[-1])
                if size >= CHARS_AT_ONCE:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
