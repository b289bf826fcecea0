"""Quality rules: a threshold table compiled into one projection, without user functions.

Defined results: a null text is the empty text, which has no words and fails the base rule; null ids and any other
column pass through; repeated rows are judged alike; an empty table gives an empty one. Columns named like the
verdict columns are replaced in ``judged`` and untouched by ``passing``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import once
from caseflow.llm.textstats import text_stats

STATS = "_quality_stats"
LEAST_WORDS = 20
MOST_REPEATED_PER_CENT = 30


@dataclass(frozen=True)
class Rule:
    """``low <= value <= high``; a bound of None is open."""

    name: str
    value: Callable[[Column], Column]
    low: float | None = None
    high: float | None = None

    def holds(self, stats: Column) -> Column:
        value = self.value(stats)
        bounds = [value >= self.low] if self.low is not None else []
        bounds += [value <= self.high] if self.high is not None else []
        verdict = F.lit(True)
        for bound in bounds:
            verdict = verdict & bound
        return F.coalesce(verdict, F.lit(False))


def ratio(part: str, whole: str) -> Callable[[Column], Column]:
    return lambda stats: stats[part] / F.greatest(stats[whole], F.lit(1))


# The threshold table.
RULES = [
    Rule("length", lambda stats: stats["n_words"], low=LEAST_WORDS),
    Rule("word_length", ratio("word_chars", "n_words"), low=1.5, high=20),
    Rule("symbols", ratio("n_symbols", "n_words"), high=0.25),
    Rule("stop_words", ratio("n_stop_words", "n_words"), low=0.02),
    Rule("repeated_lines", ratio("n_dup_lines", "n_lines"), high=0.4),
]


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED_PER_CENT * stats["n_words"])


def judged(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with its counts, one boolean per rule (``ok_<rule>``), ``base_failed`` and ``kept``."""
    stats = F.col(STATS)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]
    verdict = ~base_failed(stats)
    for rule in rules:
        verdict = verdict & rule.holds(stats)
    added = (
        {name: stats[name] for name in counts}
        | {f"ok_{rule.name}": rule.holds(stats) for rule in rules}
        | {"base_failed": base_failed(stats), "kept": verdict}
    )
    return docs.withColumn(STATS, once(text_stats(F.col(text), distinct=False))).withColumns(added).drop(STATS)


def passing(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    stats = F.col(STATS)
    verdict = ~base_failed(stats)
    for rule in rules:
        verdict = verdict & rule.holds(stats)
    return docs.withColumn(STATS, once(text_stats(F.col(text), distinct=False))).filter(verdict).drop(STATS)
