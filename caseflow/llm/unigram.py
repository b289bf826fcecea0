"""Unigram segmentation over the pieces of a SentencePiece model file.

Blanks stand for the model's blank sign, so a text may hold that sign itself. A text gets one blank before it, as the model
asks. A character that is no piece is written as its bytes. A merge-rank (BPE) file has no probabilities: its pieces get
Zipf's, log(1 / (rank + 2.7)), in millionths and rounded, so that sums are exact in any order. Among equal sums the longest
last piece wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa

SIGN = "▁"
UNIT = re.compile(" *[^ ]+| +")
SCALE = 1_000_000
LOW = -(1 << 60)
MOST_WORDS = 300_000
CHARS_AT_ONCE = 4_000_000


class _Known(dict):
    """Ids by unit; ``rest`` holds those of the units at hand that a full table has no place for."""

    rest: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        return self.rest[unit]


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores = np.zeros(size, dtype=np.int64)
        self.bytes = [b""] * size
        self.byte_ids = [0] * 256
        pieces = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        total = math.log(sum(1 / (rank + 2.7) for rank in range(len(pieces))))
        for rank, k in enumerate(pieces):
            piece = model.id_to_piece(k).replace(SIGN, " ")
            self.ids[piece] = k
            self.bytes[k] = piece.encode()
            self.scores[k] = round(-SCALE * (math.log(rank + 2.7) + total))
        if any(" " in piece.lstrip(" ") for piece in self.ids):
            raise ValueError("a piece holds a blank after another character")
        self.byte_score = int(self.scores.min()) - 10 * SCALE
        for k in range(size):
            if model.is_byte(k):
                value = int(model.id_to_piece(k)[3:5], 16)
                self.byte_ids[value], self.bytes[k], self.scores[k] = k, bytes([value]), self.byte_score
        self.all_bytes = pa.array(self.bytes, pa.binary())
        self.longest = max(map(len, self.ids))
        self.piece_scores = {piece: int(self.scores[k]) for piece, k in self.ids.items()}
        # Score of a piece, None for what only begins one.
        self.table = dict.fromkeys(piece[:k] for piece in self.ids for k in range(1, len(piece))) | self.piece_scores
        self.known = _Known()
        self.letters = {piece for piece in self.ids if len(piece) == 1}
        # A character that no piece holds: every segmentation breaks at it.
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(set().union(*self.ids)))) + "])")
        self.inside = set().union(*self.ids) - self.letters  # in longer pieces only
        self.own_ids = np.array(list(self.ids.values()), dtype="<u4")
        self.search = self._search()

    def _search(self):
        """The tokenizers library's search over the same pieces and whole-number scores.

        Its sums are exact, and like ``paths`` it takes the longest last piece of equal ones. It knows no byte pieces, so it only
        gets words, or what lies between two foreign characters of a word, whose every character is a piece.
        """
        from tokenizers.models import Unigram

        return Unigram([(piece, float(score)) for piece, score in self.piece_scores.items()], None, False).tokenize

    def edges(self, text: str, end: int, least: int = 0):
        """(start, score) of every piece that ends at ``end`` and starts at ``least`` or later, longest first."""
        get = self.piece_scores.get
        for start in range(max(least, end - self.longest), end):
            score = get(text[start:end])
            if score is not None:
                yield start, score
        if text[end - 1] not in self.piece_scores:
            yield end - 1, self.byte_score * len(text[end - 1].encode())

    def paths(self, words: Iterable[str]) -> Iterator[tuple[str, list[int], list[int], list[int]]]:
        """(word, best sums, starts of the last pieces, numbers of pieces) per end, for words in ascending order.

        The words are walked as a depth-first walk of their trie: the lists are those of the path to the present word, so a
        prefix that several words share is scored once. They are only valid until the next word is asked for.
        """
        table, lowest = self.table.get, self.byte_score
        before, best, back, pieces, open_starts = "", [0], [0], [0], [()]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            for path in (best, back, pieces, open_starts):
                del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, at, step, live = LOW, end - 1, 1, []
                for start in (*open_starts[-1], end - 1):
                    score = table(word[start:end], 0)
                    if score == 0:  # neither a piece nor the beginning of one
                        continue
                    live.append(start)
                    if score is not None and best[start] + score > top:
                        top, at = best[start] + score, start
                if word[end - 1] not in self.piece_scores:
                    size = len(word[end - 1].encode())
                    if best[end - 1] + lowest * size > top:
                        top, at, step = best[end - 1] + lowest * size, end - 1, size
                best.append(top)
                back.append(at)
                pieces.append(pieces[at] + step)
                open_starts.append(live)
            before = word
            yield word, best, back, pieces

    def _ids(self, word: str, back: list[int]) -> list[int]:
        ids, end = [], len(word)
        while end:
            start = back[end]
            k = self.ids.get(word[start:end])
            ids.append([k] if k is not None else [self.byte_ids[b] for b in word[start:end].encode()])
            end = start
        return [k for own in reversed(ids) for k in own]

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a string, by one pass over it."""
        return next(self._ids(word, back) for word, _, back, _ in self.paths([text]))

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of units (blanks and a word) that are not known yet."""
        spelled = list(filter(self.letters.issuperset, new))
        flat, ends, search = [], [0], self.search
        for word in spelled:
            flat += [token.id for token in search(word)]
            ends.append(4 * len(flat))
        blob = self.own_ids[np.array(flat, dtype=np.int64)].tobytes()
        learnt = dict(zip(spelled, [blob[i:j] for i, j in zip(ends, ends[1:])]))
        if len(spelled) < len(new):
            others = new.difference(learnt)
            mixed = set(filter(self.inside.isdisjoint, others))
            learnt.update(self._with_foreign(mixed))
            hard = sorted(others - mixed)
            learnt.update((word, np.array(self._ids(word, back), dtype="<u4").tobytes()) for word, _, back, _ in self.paths(hard))
        if len(self.known) < MOST_WORDS:
            self.known.update(islice(learnt.items(), MOST_WORDS - len(self.known)))
        return learnt

    def _with_foreign(self, words: set[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words of letters and foreign characters, each run of letters searched by itself and once."""
        runs: dict[str, list[int]] = {}
        own_ids = self.own_ids.tolist()
        for word in words:
            ids: list[int] = []
            for k, part in enumerate(self.foreign.split(word)):
                if k % 2:
                    ids += [self.byte_ids[b] for b in part.encode()]
                elif part:
                    if part not in runs:
                        runs[part] = [own_ids[token.id] for token in self.search(part)]
                    ids += runs[part]
            yield word, np.array(ids, dtype="<u4").tobytes()

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each string; no piece goes from a word into the next, so the units are segmented once each, many together."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= CHARS_AT_ONCE:
                yield from self._several(some)
                some, size = [], 0
        yield from self._several(some)

    def _several(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts, known = [UNIT.findall(t) for t in texts], self.known
        # Not ``difference(known)``: for a subclass of dict that walks the whole table, however few the units.
        new = set(filterfalse(known.__contains__, set().union(*parts)))
        rest = self.learn(new) if new else {}
        for units in parts:
            known.rest = rest
            yield np.frombuffer(b"".join(map(known.__getitem__, units)), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        """The string that the ids stand for, with the blank before the text."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


    def decode_lists(self, lists: pa.ListArray) -> pa.StringArray:
        """``decode`` of each row: all pieces' bytes lie in one buffer, in which a row goes from its first piece to its last."""
        starts = lists.offsets.to_numpy()
        found = self.all_bytes.take(lists.values.slice(starts[0], starts[-1] - starts[0]))
        offsets, data = (found.buffers()[k] for k in (1, 2))
        offsets = np.frombuffer(offsets, np.int32, len(found) + 1, 4 * found.offset)
        rows = np.ascontiguousarray(offsets[starts - starts[0]])
        out = pa.StringArray.from_buffers(len(lists), pa.py_buffer(rows), data)
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that are no text's
            return pa.array([self.decode(np.array(ids, dtype=np.int64)) for ids in lists.to_pylist()], pa.string())
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's own vocabulary; it serves all tasks of the worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]
