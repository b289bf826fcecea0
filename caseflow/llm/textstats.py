"""Counts over a whole text as column expressions; a null text counts as empty.

Words are runs of characters other than the six ASCII blanks. Every expression is linear in the text but for
``repeated_words``, which sorts the windows of those texts that repeat one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.columns import let

BLANKS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
MARKS = "!?"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "with", "as", "be", "at", "this", "by", "from",
    "der", "die", "das", "und", "ist", "den", "zu", "mit", "auf", "im", "ein", "eine", "von", "sich", "für", "des",
    "le", "la", "les", "de", "et", "un", "une", "du", "est", "que", "pour", "dans", "qui", "par", "pas", "sur", "au",
    "el", "los", "las", "y", "en", "se", "del", "por", "con", "para", "su", "al",
]


def stop_forms() -> list[str]:
    """The stop words as they stand inside and at the start of a sentence; shouted text has none."""
    return sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS + "+"), "")


def without(text: Column, characters: str) -> Column:
    """Number of characters of ``text`` that are in ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words inside a window of ``size`` words that stands twice or more in the text, all its places counted.

    Equal windows have equal hashes, so a text whose window hashes all differ is done; the others compare the windows
    themselves.
    """
    starts = F.slice(words, 1, F.size(words) - (size - 1))

    def window_hash(_, i):
        return F.xxhash64(*[F.get(words, i + k) for k in range(size)])

    def covered(ordered):
        def here(i):
            return F.get(ordered, i)["w"]

        places = F.transform(
            F.filter(
                F.sequence(F.lit(0), F.size(ordered) - 1),
                lambda i: F.coalesce(here(i) == here(i - 1), F.lit(False)) | F.coalesce(here(i) == here(i + 1), F.lit(False)),
            ),
            lambda i: F.get(ordered, i)["i"],
        )
        empty = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(places),
            empty,
            lambda done, i: F.struct(
                (done["total"] + i + size - F.greatest(i, done["end"])).alias("total"), (i + size).alias("end")
            ),
            lambda done: done["total"],
        )

    exact = let(
        F.sort_array(
            F.transform(starts, lambda _, i: F.struct(F.array_join(F.slice(words, i + 1, size), " ").alias("w"), i.alias("i")))
        ),
        covered,
    )
    none_twice = let(F.transform(starts, window_hash), lambda hashes: F.size(F.array_distinct(hashes)) == F.size(hashes))
    return F.when(F.size(words) < size, F.lit(0)).when(none_twice, F.lit(0)).otherwise(exact)


def text_stats(text: Column, repeats: bool = True, distinct: bool = True) -> Column:
    """One struct of whole-text counts (long); ``repeats`` and ``distinct`` switch the two costly ones on."""

    def counted(t, words, lines):
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
            "n_chars": F.length(t),
            "n_symbols": without(t, SYMBOLS),
            "n_marks": without(t, MARKS),
            "n_digits": without(t, DIGITS),
            "n_upper": F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop_forms()))),
        }
        if repeats:
            counts["n_repeat_words"] = repeated_words(words)
        if distinct:
            counts["n_distinct_words"] = F.size(F.array_distinct(words))
        return F.struct(*[value.cast("long").alias(name) for name, value in counts.items()])

    def with_text(t):
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        return let(words_of(t), lambda words: let(lines, lambda own: counted(t, words, own)))

    return let(filled(text), with_text)
