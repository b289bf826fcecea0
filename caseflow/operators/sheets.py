"""Page index: the tokens of a sheet in one row, in reading order and by height on the page.

A page is one physical sheet. Its tokens are brought together once; every rule then works on the row: ``near`` finds the tokens
around a label by binary search in the places sorted by centre, so a rule costs its labels times their neighbourhood. Rules are
columns over ``toks``, ``by_y`` and ``tall``, and any number of them share the one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import let

TOKEN = ["ord", "text", "score", "x0", "y0", "x1", "y1", "cx", "cy", "h"]
TOKS, BY_Y, TALL = "toks", "by_y", "tall"
FEW = 48  # up to here looking at every token is faster than searching


def sheets(tokens: DataFrame, *more: str, **extra: Column) -> DataFrame:
    """One row per page: ``toks`` by ``ord`` (with the columns ``more``), ``by_y`` their centres and places, ``tall`` the tallest height.

    ``extra`` are further aggregates over a page's tokens.
    """
    every = F.sort_array(F.collect_list(F.struct(*TOKEN, *more)))
    rows = tokens.groupBy("page_id").agg(every.alias(TOKS), F.max("h").alias(TALL), *[a.alias(n) for n, a in extra.items()])
    places = F.sort_array(F.transform(TOKS, lambda t, i: F.struct(t["cy"].alias("cy"), i.alias("at"))))
    return rows.withColumn(BY_Y, F.when(F.size(TOKS) > FEW, places))


def page_texts(tokens: DataFrame) -> DataFrame:
    """One row per page with ``toks`` by ``ord`` as in ``sheets``, but only their places and texts, for rules that look at nothing else.

    Such rules on the same tokens share one exchange.
    """
    return tokens.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias(TOKS))


def _below(y: Column) -> Column:
    """Number of tokens whose centre lies above ``y`` on the page, that is, before it in ``by_y``."""
    size = F.size(BY_Y)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        def at(mid: Column) -> Column:
            before = F.get(F.col(BY_Y), mid)["cy"] < y
            return F.struct(F.when(before, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(before, s["hi"]).otherwise(mid).alias("hi"))

        return F.when(s["lo"] < s["hi"], let(F.shiftright(s["lo"] + s["hi"], 1), at)).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def near(anchor: Column, reach: float) -> Column:
    """The other tokens that may lie within ``reach`` x the tallest height above or below the anchor: on a page of few tokens all,
    else those whose centres do. The rules test the distance themselves."""
    span = F.col(TALL) * reach
    # The upper end is found as the first token beyond it, so rounding never drops one that lies on it.
    ends = F.struct(_below(anchor["cy"] - span).alias("lo"), _below((anchor["cy"] + span) * (1 + 1e-12) + 1e-9).alias("hi"))
    places = let(ends, lambda e: F.slice(BY_Y, e["lo"] + 1, e["hi"] - e["lo"]))
    found = F.when(F.size(TOKS) <= FEW, F.col(TOKS)).otherwise(F.transform(places, lambda p: F.get(F.col(TOKS), p["at"])))
    return F.filter(found, lambda t: t["ord"] != anchor["ord"])


def labelled(test) -> Column:
    """The page's tokens that pass ``test``, in reading order."""
    return F.filter(TOKS, test)


def first(values: Column, test) -> Column:
    """First value that passes ``test``, else null."""
    return F.get(F.filter(values, test), F.lit(0))


def per_label(labels: Column, value) -> Column:
    """The arrays ``value(label)`` of all labels, one after the other."""
    return F.flatten(F.transform(labels, value))


def nearest(pairs: Column, value) -> Column:
    """First non-blank ``value(text)`` of (distance, a_ord, ord, text) pairs, nearest first, else null; texts after it are not read."""
    spelled = lambda p: let(value(p["text"]), lambda v: F.when(v != "", v))
    nothing = F.lit(None).cast("string")
    return F.aggregate(F.sort_array(pairs), nothing, lambda found, p: F.when(found.isNotNull(), found).otherwise(spelled(p)))
