"""Byte-level BPE ids of many texts with the tokenizers library, which encodes each distinct word once.

The vocabulary splits a text into pieces before it merges bytes. No piece goes over a single blank or line feed between two
other characters, so the ids of a text are those of its words (each with the blank or line feed before it), one after the
other. A text with longer runs of blanks goes by ``CHUNK`` instead, which cuts around such runs as the vocabulary does. A
text that holds the string of a special token goes to the library whole.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

END = b"\0\0\0\0"  # id 0, which ends a document
#: A full table stays as it is: it holds the frequent entries, and a worker's memory is bounded.
MOST_WORDS = 300_000
MOST_CHUNKS = 100_000
JOINED = 256
CHARS_AT_ONCE = 50_000
MARKS = string.punctuation

# Unicode's white space, as the vocabulary's own splitting rule has it.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def _grow(table: dict[str, bytes], new: dict[str, bytes], most: int) -> None:
    if len(table) < most:
        table.update(new if len(table) + len(new) <= most else islice(new.items(), most - len(table)))


def _is_word(part: str) -> bool:
    """No blank at either end, but for the line feed that may come before a word."""
    word = part[1:] if part[:1] == "\n" else part
    return bool(word) and not (word[0].isspace() or word[-1].isspace())


class _ByteLetters(dict):
    """The letters that stand for a character's bytes in the vocabulary, by its code point, as the library gives them."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, point: int) -> str:
        self[point] = letters = self.byte_level.pre_tokenize_str(chr(point))[0][0]
        return letters


class Encoder:
    """Ids as little-endian unsigned 32-bit integers in one bytes object per text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's own core only
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        added = self.library.get_added_tokens_decoder()
        self.special = [token.content for token in added.values()]
        self.mark, self.mark_id = next((token.content, k) for k, token in added.items())
        self.bytes_of = _ByteLetters()
        self.line = self._whole("\n")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, many in one call: the library splits at the special token between two parts first."""
        out: list[bytes] = []
        for k in range(0, len(parts), JOINED):
            ids = np.array(self.library.encode(self.mark.join(parts[k : k + JOINED]), add_special_tokens=False).ids, dtype="<u4")
            at = np.flatnonzero(ids == self.mark_id)
            blob = ids.tobytes()
            out += [blob[i:j] for i, j in zip(np.r_[0, 4 * at + 4].tolist(), np.r_[4 * at, len(blob)].tolist())]
        return out

    def _word_ids(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of new words. Letters are a piece of their own and go to the model at once, as do the ASCII marks after them.

        What is no word, as it has a blank at an end, is left out.
        """
        learnt, others = {}, []
        known, piece, tails = self.words.get, self._piece, self.tails
        for word in words:
            stem = word.rstrip(MARKS)
            if stem.isalpha():
                ids = None if stem is word else known(stem)
                if ids is None:
                    ids = piece("Ġ" + stem if stem.isascii() else "Ġ" + stem.translate(self.bytes_of))
            elif stem[1:].isalpha() and stem[0] == "\n":
                ids = self.line + piece(stem[1:] if stem.isascii() else stem[1:].translate(self.bytes_of))
            else:
                if _is_word(word):
                    others.append(word)
                continue
            if len(stem) < len(word):
                tail = word[len(stem) :]
                ids += tails[tail] if tail in tails else self._tail(tail)
            learnt[word] = ids
        learnt.update(zip(others, self._encoded([w if w[0] == "\n" else " " + w for w in others])))
        return learnt

    def _tail(self, marks: str) -> bytes:
        ids = self._piece(marks)
        _grow(self.tails, {marks: ids}, MOST_CHUNKS)
        return ids

    def _piece(self, letters: str) -> bytes:
        """Ids of a piece in the vocabulary's letters, in which ASCII marks and letters stand for themselves."""
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _looked_up(self, parts: list[list[str]], table: dict[str, bytes], most: int, learn) -> list[list[bytes | None]]:
        """Ids of every part from the table or from ``learn``; None where neither has them."""
        found = [list(map(table.get, own)) for own in parts]
        lacking = [i for i, ids in enumerate(found) if not all(ids)]
        learnt = learn({w for i in lacking for w, ids in zip(parts[i], found[i]) if ids is None})
        for i in lacking:
            found[i] = [learnt.get(w) if ids is None else ids for w, ids in zip(parts[i], found[i])]
        _grow(table, learnt, most)
        return found

    def _chunk_ids(self, chunks: Iterable[str]) -> dict[str, bytes]:
        chunks = list(chunks)
        return dict(zip(chunks, self._encoded(chunks)))

    def _some(self, texts: list[str]) -> list[bytes]:
        """A few texts without special tokens."""
        # Each word follows one blank, which it leaves out, or one line feed, which it keeps; so does the first.
        words = [("\n" + t).replace("\n", " \n")[1:].split(" ") for t in texts]
        found = self._looked_up(words, self.words, MOST_WORDS, self._word_ids)
        spaced = [i for i, ids in enumerate(found) if not all(ids)]
        parts = [CHUNK.findall(texts[i]) for i in spaced]
        by_chunks = self._looked_up(parts, self.chunks, MOST_CHUNKS, self._chunk_ids)
        out = [b"".join(ids)[4:] if all(ids) else b"" for ids in found]
        for i, ids in zip(spaced, by_chunks):
            out[i] = b"".join(ids)
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; a null text has none."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= CHARS_AT_ONCE:
                yield from self._several(some)
                some, size = [], 0
        yield from self._several(some)

    def _several(self, texts: list[str]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not special:
            return self._some(texts)
        plain = iter(self._some([t for i, t in enumerate(texts) if i not in set(special)]))
        return [self._whole(t) if i in set(special) else next(plain) for i, t in enumerate(texts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file; it serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
