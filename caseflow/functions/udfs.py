"""Python where Spark has no built-in: difflib ratio, NFKC, rare charsets. Arrow batches in and out."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def similarity(left: Column, right: Column) -> Column:
    """Share of matching blocks in two texts, 0 to 1."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio(left, right)


def best_ratios(text: Column, groups: list[list[str]]) -> Column:
    """For each group of labels the largest ratio of a text with one of them; null for a null. A batch looks at each text once."""

    @F.pandas_udf("array<double>")
    def ratios(texts: pd.Series) -> pd.Series:
        ratio = lambda t, label: difflib.SequenceMatcher(None, t, label).ratio()
        known = {t: [max(ratio(t, label) for label in own) for own in groups] for t in texts.dropna().unique()}
        return texts.map(known.get)

    return ratios(text)


def nfkc(text: Column) -> Column:
    """Unicode compatibility form, which folds every width variant."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return fold(text)


def decode_bytes(content: Column, charset: Column) -> Column:
    """Text of bytes in a charset that the JVM function does not offer; unknown charsets read as UTF-8."""

    @F.pandas_udf("string")
    def decode(data: pd.Series, names: pd.Series) -> pd.Series:
        def one(raw, name):
            if raw is None:
                return None
            try:
                return bytes(raw).decode(name, errors="replace")
            except LookupError:
                return bytes(raw).decode("utf-8", errors="replace")

        return pd.Series([one(raw, name) for raw, name in zip(data, names)], dtype="object")

    return decode(content, charset)
