"""OCR-token jobs: reading order, identity-card fields, property fields, label records.

A token row has page_id, ord (reading position), text, score, x0, y0, x1, y1. Card and property rules work on the page index
of ``sheets``. ``near_label`` and ``value_tokens`` take pages of any size: they join tokens through (page_id, band), where a band
is a strip of the page as high as its tallest token, so a label meets the tokens near it and not all tokens of its page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import (
    card_address, checksum_holds, comparable, compact_label, field_value_ok, first_valid_id, fold_glyphs, grid_box, id_text, let,
    once, pixel_box, plausible_name,
)
from caseflow.functions.udfs import best_ratios
from caseflow.operators.forms import date_warnings, merge_sources
from caseflow.operators.ranking import numbered, shuffled
from caseflow.operators.sheets import TOKEN, TOKS, first, labelled, near, nearest, page_texts, per_label, sheets

# How far from a label, in token heights, its value may lie, and how distances are weighed.
LABEL_REACH, RIGHT_SLACK, RIGHT_WEIGHT, BELOW_WEIGHT = 3.5, 1.3, 2, 0.4
NAME_SLACK = 0.9
ADDRESS_REACH, ADDRESS_INDENT = 2.6, 0.5
VALUE_REACH, ROW_SLACK, ROW_GAP, LEAST_GAP, UNDER_REACH, UNDER_INDENT = 6.0, 0.9, 0.3, 6.0, 4, 2
WIDE_GAP, WIDE_HEIGHTS = 180.0, 10


def with_geometry(tokens: DataFrame) -> DataFrame:
    return tokens.withColumns(
        {
            "cx": (F.col("x0") + F.col("x1")) / 2,
            "cy": (F.col("y0") + F.col("y1")) / 2,
            "h": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")),
        }
    )


def reading_order(tokens: DataFrame) -> DataFrame:
    """A page is one sheet. Position of each token on its page: rows by centre over height (halves to even), then left to right."""
    order = [F.bround(F.col("cy") / F.col("h")), F.col("cx"), F.col("ord")]
    return numbered(with_geometry(tokens), ["page_id"], order, "reading_no")


def near_pairs(tokens: DataFrame, anchors: DataFrame, reach: float) -> DataFrame:
    """Pairs of an anchor and another token of its page whose centres lie within reach x the taller height.

    ``anchors`` are token rows too; their columns come back with the prefix ``a_``. Tall and flat tokens are
    paired by strips of their page's tallest token, so both sides of the test fall in neighbouring strips.
    """
    strip = tokens.groupBy("page_id").agg((F.max("h") * reach).alias("_strip"))
    band = F.floor(F.col("cy") / F.col("_strip"))
    near = anchors.join(strip, "page_id").select(
        "page_id", *[F.col(c).alias(f"a_{c}") for c in TOKEN], *[c for c in anchors.columns if c not in TOKEN and c != "page_id"],
        F.explode(F.sequence(band - 1, band + 1)).alias("_band"),
    )
    placed = tokens.join(strip, "page_id").select("page_id", *TOKEN, band.alias("_band"))
    return near.join(placed, ["page_id", "_band"]).filter("ord <> a_ord").drop("_band")


def _has_label(text: Column, labels: list[str]) -> Column:
    compact = F.replace(text, F.lit(" "), F.lit(""))
    test = F.lit(False)
    for label in labels:
        test = test | F.contains(compact, F.lit(label))
    return test


def _label_distance(a: dict, t: dict) -> Column:
    """Distance of a token right of a label on its line, or below it within the label's reach; else null."""
    vertical = F.abs(t["cy"] - a["cy"])
    right = (vertical <= F.greatest(a["h"], t["h"]) * RIGHT_SLACK) & (t["cx"] >= a["cx"])
    below = (t["cy"] - a["cy"] > 0) & (t["cy"] - a["cy"] <= a["h"] * LABEL_REACH)
    return F.when(right, t["cx"] - a["cx"] + vertical * RIGHT_WEIGHT).when(
        below, t["cy"] - a["cy"] + F.abs(t["cx"] - a["cx"]) * BELOW_WEIGHT
    )


def _of_row(prefix: str = "") -> dict[str, Column]:
    """The columns of a pair row as the fields of a token."""
    return {c: F.col(prefix + c) for c in TOKEN}


def near_label(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Tokens right of a label on its line, or within 3.5 heights below it, with their distance."""
    anchors = tokens.filter(_has_label(F.col("text"), labels))
    pairs = near_pairs(tokens, anchors, LABEL_REACH)
    return pairs.withColumn("distance", _label_distance(_of_row("a_"), _of_row())).filter("distance IS NOT NULL")


# What a token's text says, as bits, so that rules ask a number and not the text again.
NAME, BIRTH, BIRTH_HEAD, ISSUE, ISSUE_LABEL, HOME, RIVAL = (1 << k for k in range(7))


def _card_sheets(tokens: DataFrame, **extra: Column) -> DataFrame:
    """The page index of cards; each token carries its ``marks``."""
    spellings = F.struct(fold_glyphs("text").alias("folded"), F.replace(F.col("text"), F.lit(" "), F.lit("")).alias("compact"))
    compact, folded, bare = F.col("_s.compact"), F.col("_s.folded"), F.col("_bare")
    tests = {
        NAME: _any_of(compact, ["姓名"]), BIRTH: _any_of(compact, ["出生日期", "出生"]), BIRTH_HEAD: F.contains(folded, F.lit("出生")),
        ISSUE: folded.rlike(vocab.ISSUE_MARKER), ISSUE_LABEL: _any_of(compact, ["發證日期", "發證"]),
        HOME: _any_of(bare, ["住址", "地址"]), RIVAL: _any_of(bare, vocab.ADDRESS_NEIGHBOUR_LABELS),
    }
    marks = sum((F.when(test, bit).otherwise(0) for bit, test in tests.items()), F.lit(0))
    spelled = tokens.withColumn("_s", once(spellings)).withColumn("_bare", once(F.replace(folded, F.lit(" "), F.lit(""))))
    return sheets(spelled.withColumn("marks", once(marks)).drop("_s", "_bare"), "marks", **extra)


def _has(t: Column, mark: int) -> Column:
    return t["marks"].bitwiseAND(mark) != 0


def _label_pairs(mark: int, without: int = 0) -> Column:
    """(distance, a_ord, ord, text) of the tokens near each label of a page."""

    def of(a: Column) -> Column:
        pair = lambda t: F.struct(_label_distance(a, t).alias("distance"), a["ord"].alias("a_ord"), t["ord"].alias("ord"), t["text"].alias("text"))
        around = F.filter(near(a, LABEL_REACH), lambda t: ~_has(t, without)) if without else near(a, LABEL_REACH)
        return F.filter(F.transform(around, pair), lambda p: p["distance"].isNotNull())

    return per_label(labelled(lambda t: _has(t, mark)), of)


# Fixed value: shape of a date on a card; letters O stand for zeros.
CARD_DATE = r"(?:民國)?\s*(\d{2,3})\s*(?:年|[./-])\s*(\d{1,2})\s*(?:月|[./-])\s*(\d{1,2})\s*日?"


def card_date(value: Column) -> Column:
    """Date on a card as YYY/MM/DD; only the ranges are checked."""

    def checked(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, CARD_DATE, i).try_cast("int").alias(f"p{i}")
        return F.when(text.rlike(CARD_DATE), let(F.struct(part(1), part(2), part(3)), spelled)).otherwise("")

    def spelled(p: Column) -> Column:
        good = p["p1"].between(1, 200) & p["p2"].between(1, 12) & p["p3"].between(1, 31)
        padded = lambda i, n: F.lpad(p[f"p{i}"].cast("string"), n, "0")
        return F.when(good, F.concat_ws("/", padded(1, 3), padded(2, 2), padded(3, 2))).otherwise("")

    return let(F.translate(value, "Oo", "00"), checked)


def _page_text(separator: str, spell=lambda t: t["text"]) -> Column:
    """Texts of a page in reading order as one string."""
    return F.array_join(F.transform(TOKS, spell), separator)


def card_id() -> Column:
    """Identity number of a sheet: spaced in the joined texts, else anywhere in their compact form."""

    def of(text: Column) -> Column:
        found = F.regexp_extract_all(id_text(text), F.lit(r"[A-Z][12]\d{8}"), F.lit(0))
        spaced = let(first_valid_id(text), lambda v: F.when(v != "", v))
        return F.coalesce(spaced, first(found, checksum_holds), F.lit(""))

    return let(_page_text(" "), of)


CJK_ONLY = "[^㐀-鿿]"


def card_name() -> Column:
    """Name of a sheet: the label's rest and the tokens right of it, longest plausible 4 to 2 characters;
    else the nearest plausible token."""
    checked = lambda v: F.when(plausible_name(v, vocab.NAME_EXCLUSIONS_TOKENS), v)
    longest = lambda s: F.coalesce(*[F.when(F.length(s) >= n, checked(F.substring(s, 1, n))) for n in (4, 3, 2)])

    def spelled(a: Column) -> Column:
        right = F.filter(
            near(a, LABEL_REACH), lambda t: (t["cx"] > a["cx"]) & (F.abs(t["cy"] - a["cy"]) <= F.greatest(a["h"], t["h"]) * NAME_SLACK)
        )
        row = F.sort_array(F.transform(right, lambda t: F.struct(t["cx"].alias("cx"), t["ord"].alias("ord"), t["text"].alias("text"))))
        rest = F.regexp_replace(F.replace(a["text"], F.lit(" "), F.lit("")), "^.*?姓名[:：]?", "")
        parts = F.concat(F.array(rest), F.transform(row, lambda t: t["text"]))
        return let(F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, CJK_ONLY, "")), ""), longest)

    by_label = first(F.transform(labelled(lambda t: _has(t, NAME)), spelled), lambda v: v.isNotNull())
    nearby = lambda x: let(F.substring(F.regexp_replace(x, CJK_ONLY, ""), 1, 4), lambda v: F.coalesce(checked(v), F.lit("")))
    return F.coalesce(by_label, nearest(_label_pairs(NAME), nearby), F.lit(""))


def card_birth_date() -> Column:
    """Birth date: nearest date to the label, issue-date tokens left out; else the label's next tokens."""
    pairs = _label_pairs(BIRTH, without=ISSUE)

    def window(head: Column) -> Column:
        # A label and its next four tokens in reading order, joined by position.
        following = F.filter(TOKS, lambda t: (t["ord"] >= head["ord"]) & (t["ord"] <= head["ord"] + 4) & ~_has(t, ISSUE))
        return card_date(F.array_join(F.transform(following, lambda t: t["text"]), " "))

    heads = labelled(lambda t: _has(t, BIRTH_HEAD))
    return F.coalesce(nearest(pairs, card_date), first(F.transform(heads, window), lambda v: v != ""), F.lit(""))


def card_issue_date() -> Column:
    """Issue date: the first marked token that holds a date, else the nearest date to the label."""
    value = lambda text: card_date(fold_glyphs(text))
    marked = F.transform(labelled(lambda t: _has(t, ISSUE)), lambda t: value(t["text"]))
    return F.coalesce(first(marked, lambda v: v != ""), nearest(_label_pairs(ISSUE_LABEL), value), F.lit(""))


def card_ids(tokens: DataFrame) -> DataFrame:
    """Identity number of each page; '' where there is none, as with every card field."""
    return page_texts(tokens).select("page_id", card_id().alias("national_id"))


def card_names(tokens: DataFrame) -> DataFrame:
    return _card_sheets(tokens).select("page_id", card_name().alias("name"))


def card_birth_dates(tokens: DataFrame) -> DataFrame:
    return _card_sheets(tokens).select("page_id", card_birth_date().alias("birth_date"))


def card_issue_dates(tokens: DataFrame) -> DataFrame:
    return _card_sheets(tokens).select("page_id", card_issue_date().alias("issue_date"))


# Characters and labels that bound an address on a card.
ADDRESS_CHARS = "[縣市區鄉鎮村里鄰路街段巷弄號樓]"
FOREIGN_FIELD = "|".join(vocab.ADDRESS_NEIGHBOUR_LABELS) + r"|發證日期|[換補初]發|民國\d"


def _trim_foreign(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?s)(?:{FOREIGN_FIELD}).*$", "")


ROWS = "array<struct<y0:double,y1:double,h:double,t:array<struct<cx:double,ord:bigint,compact:string>>>>"


def _rows_as_text(tokens: Column) -> Column:
    """Text of tokens given by top edge: a token joins the first row whose head it overlaps by half, each row
    left to right."""

    def add(rows: Column, t: Column) -> Column:
        overlaps = lambda r: F.least(r["y1"], t["y1"]) - F.greatest(r["y0"], t["y0"]) > 0.5 * F.least(r["h"], t["h"])
        at = F.array_position(F.transform(rows, overlaps), True)
        item = F.array(F.struct(t["cx"].alias("cx"), t["ord"].alias("ord"), t["compact"].alias("compact")))
        row = lambda r, members: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"), r["h"].alias("h"), members.alias("t"))
        joined = F.transform(rows, lambda r, i: F.when(i + 1 == at, row(r, F.concat(r["t"], item))).otherwise(row(r, r["t"])))
        return F.when(at > 0, joined).otherwise(F.concat(rows, F.array(row(t, item))))

    spell = lambda r: F.array_join(F.transform(F.sort_array(r["t"]), lambda x: x["compact"]), "")
    return F.array_join(
        F.aggregate(tokens, F.array().cast(ROWS), add, lambda rows: F.transform(rows, spell)), ""
    )


def card_address_text(most: int | None = None) -> Column:
    """Address of a sheet from the lines around a 住址 label, leaving out lines that a rival label owns.

    ``most`` cuts the address at so many characters; without it nothing is cut.
    """
    folded = lambda text: F.replace(fold_glyphs(text), F.lit(" "), F.lit(""))
    shown = lambda v: (v != "") & ~v.rlike(r"^\d{8,}$") & ~v.rlike("省") & v.rlike(ADDRESS_CHARS)

    def with_rivals(rivals: Column) -> Column:
        def spelled(a: Column) -> Column:
            def owned(t: Column) -> Column:
                closer = lambda r: (r["ord"] != a["ord"]) & (F.abs(t["cy"] - r["cy"]) < F.abs(t["cy"] - a["cy"]))
                return F.exists(rivals, closer)

            beside = F.filter(
                near(a, LABEL_REACH),
                lambda t: (F.abs(t["cy"] - a["cy"]) <= a["h"] * ADDRESS_REACH) & (t["x0"] >= a["x0"] - a["h"] * ADDRESS_INDENT) & ~owned(t),
            )
            line = lambda t: F.struct(*[t[c].alias(c) for c in ("y0", "ord", "y1", "h", "cx")], _trim_foreign(folded(t["text"])).alias("compact"))
            lines = F.sort_array(F.filter(F.transform(beside, line), lambda t: shown(t["compact"])))
            suffix = _trim_foreign(F.regexp_replace(folded(a["text"]), "^.*?(?:住址|地址)[:：]?", ""))
            good = lambda v: F.when((F.length(v) >= 8) & v.rlike("[縣市鄉鎮區路街巷弄號]"), v)
            return let(card_address(F.concat(suffix, _rows_as_text(lines))), good)

        labels = labelled(lambda t: _has(t, HOME))
        return first(F.transform(labels, spelled), lambda v: v.isNotNull())

    value = let(labelled(lambda t: _has(t, RIVAL)), with_rivals)
    return F.coalesce(value if most is None else F.substring(value, 1, most), F.lit(""))


def _any_of(text: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.contains(text, F.lit(word))
    return test


def card_addresses(tokens: DataFrame, most: int | None = None) -> DataFrame:
    return _card_sheets(tokens).select("page_id", card_address_text(most).alias("address"))


def _side_hits(front: list[str] = vocab.FRONT_WORDS, back: list[str] = vocab.BACK_WORDS) -> Column:
    """(front, back): keyword hits of a sheet's whole text for either side."""
    count = lambda text, words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    text = _page_text("", lambda t: F.replace(t["text"], F.lit(" "), F.lit("")))
    return let(text, lambda v: F.struct(count(v, front).alias("front"), count(v, back).alias("back")))


def side_scores(tokens: DataFrame, front: list[str] = vocab.FRONT_WORDS, back: list[str] = vocab.BACK_WORDS) -> DataFrame:
    hits = page_texts(tokens).select("page_id", _side_hits(front, back).alias("_h"))
    return hits.select("page_id", F.col("_h.front").alias("front_hits"), F.col("_h.back").alias("back_hits"))


def side_of(front: Column, back: Column) -> Column:
    return F.when(front == back, "unknown").when(front > back, "front").otherwise("back")


def card_records(tokens: DataFrame, cards: DataFrame) -> DataFrame:
    """One record per card page: fields by side, mean confidence and whether barcode and text ids differ.

    ``cards`` has page_id, requested_side ('front', 'back' or 'auto') and barcode_id ('' without one).
    """
    pages = _card_sheets(with_geometry(tokens), confidence=F.round(F.avg("score"), 4)).select(
        "page_id", "confidence", _side_hits().alias("_h"), card_id().alias("national_id"), card_name().alias("name"),
        card_birth_date().alias("birth_date"), card_issue_date().alias("issue_date"), card_address_text().alias("address"),
    )
    joined = cards.join(shuffled(pages.withColumns({"front_hits": F.col("_h.front"), "back_hits": F.col("_h.back")}).drop("_h")), "page_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    barcode = F.when(F.col("requested_side") == "front", "").otherwise(text("barcode_id"))
    final_id = F.when(barcode != "", barcode).otherwise(text("national_id"))
    front = F.coalesce("front_hits", F.lit(0)) + F.when(final_id != "", 3).otherwise(0)
    back = F.coalesce("back_hits", F.lit(0)) + F.when(text("address") != "", 3).otherwise(0)
    side = F.when(F.col("requested_side").isin("front", "back"), F.col("requested_side")).otherwise(side_of(front, back))
    shown = joined.withColumn("side", side)
    unless = lambda hidden, c: F.when(F.col("side") != hidden, text(c)).otherwise("")
    return shown.select(
        "page_id", "side",
        unless("back", "name").alias("name"),
        final_id.alias("national_id"),
        F.when(barcode != "", "barcode").when(text("national_id") != "", "ocr").otherwise("").alias("national_id_source"),
        ((barcode != "") & (text("national_id") != "") & (barcode != text("national_id"))).alias("national_id_mismatch"),
        unless("back", "birth_date").alias("birth_date"),
        unless("back", "issue_date").alias("issue_date"),
        unless("front", "address").alias("address"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def file_cards(cards: DataFrame, as_of, requested: str = "combined") -> DataFrame:
    """Merged card records per file with warnings; ``cards`` is card_records with file_id and place."""
    # One aggregate, so the records are read once.
    joined = merge_sources(
        cards.filter("file_id IS NOT NULL"), "file_id", "place", ["name", "national_id", "birth_date", "issue_date", "address"],
        card_count=F.count(F.lit(1)), _mismatch=F.max("national_id_mismatch"),
        national_id_source=F.coalesce(
            F.min_by(F.when(F.col("national_id") != "", F.col("national_id_source")), F.when(F.col("national_id") != "", F.col("place"))),
            F.lit(""),
        ),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.lit(requested == "combined") & (F.col("card_count") < 2), "合併頁未穩定偵測到兩張卡片，已使用可用候選或整頁辨識"),
            F.when(F.col("national_id") == "", "未取得通過 checksum 的身分證字號"),
            F.when(F.col("_mismatch"), "背面條碼與正面辨識的身分證字號不一致，已採用條碼值，請人工確認"),
        )
    )
    status = F.when((F.col("national_id") != "") & ((F.col("name") != "") | (F.col("address") != "")), "success").otherwise("review")
    return joined.withColumn("warnings", F.concat(warnings, date_warnings("birth_date", "issue_date", as_of))).withColumn(
        "status", status
    ).drop("_mismatch")


# ---- property fields -------------------------------------------------------------------------------------------


def _with_hits(tokens: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """``tokens`` with ``hits``: (field, match_score) of every field that a token's text is a label of.

    Containment is decided in the JVM; only texts that can still reach the least score go to Python for the difflib ratio.
    """
    bare = {f: [re.sub(r"[\s:：|]", "", label) for label in ls] for f, ls in labels.items()}
    text, a = F.col("_bare"), F.length("_bare")
    contained = {f: _any_of(text, ls) for f, ls in bare.items()}

    def reachable(label: str) -> Column:
        # A ratio is 2M / (a + b); M is at most either length and the text's characters that the label has at all.
        shared = a - F.length(F.translate(text, label, ""))
        enough = lambda m: 2 * F.least(m, F.lit(len(label))) >= (a + len(label)) * vocab.LABEL_MATCH_MINIMUM
        return enough(a) & enough(shared)  # the lengths alone settle most texts

    asked = F.lit(False)
    for field, own in bare.items():
        for label in own:
            asked = asked | (~contained[field] & reachable(label))
    ratios = best_ratios(F.when(asked, text), list(bare.values()))
    spelled = tokens.withColumn("_bare", once(compact_label("text"))).withColumn("_ratios", once(ratios))

    def hit(field: str, k: int) -> Column:
        score = F.when(contained[field], 1.0).otherwise(F.get("_ratios", F.lit(k)))
        return F.when(score >= vocab.LABEL_MATCH_MINIMUM, F.struct(F.lit(field).alias("field"), score.alias("match_score")))

    return spelled.withColumn("hits", F.array_compact(F.array(*[hit(field, k) for k, field in enumerate(bare)]))).drop("_bare", "_ratios")


def _best_labels(labels: dict[str, list[str]]) -> Column:
    """(match_score, score, back, field, l) of the best label token of each field of a sheet: by match, OCR score, position."""

    def best(field: str) -> Column:
        own = lambda t: first(t["hits"], lambda h: h["field"] == field)["match_score"]
        ranked = lambda t: F.struct(own(t).alias("match_score"), t["score"].alias("score"), (-t["ord"]).alias("back"), F.lit(field).alias("field"), t.alias("l"))
        return F.array_max(F.filter(F.transform(TOKS, ranked), lambda r: r["match_score"].isNotNull()))

    return F.array_compact(F.array(*[best(field) for field in labels]))


def _property_sheets(tokens: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    return sheets(_with_hits(tokens, labels), "hits")


def find_labels(tokens: DataFrame, labels: dict[str, list[str]] = vocab.FIELD_LABELS) -> DataFrame:
    """Best label token per page and field by match score, then by OCR score, then by position."""
    found = _property_sheets(tokens, labels).select("page_id", F.inline(_best_labels(labels)))
    return found.select("page_id", "field", "match_score", *[F.col(f"l.{c}").alias(c) for c in TOKEN])


def _in_row(a: dict, t: dict) -> Column:
    return (F.abs(a["cy"] - t["cy"]) <= F.greatest(a["h"], t["h"]) * ROW_SLACK) & (
        t["x0"] >= a["x1"] - F.greatest(F.lit(LEAST_GAP), a["h"] * ROW_GAP)
    )


def _under(a: dict, t: dict) -> Column:
    return (t["cy"] > a["y1"]) & (t["cy"] <= a["y1"] + a["h"] * UNDER_REACH) & (t["x0"] >= a["x0"] - a["h"] * UNDER_INDENT)


def _value_line(a: Column) -> Column:
    """(x0, ord, t) of the tokens that spell a label's value: right of it on its row, else the first row below it, left to
    right up to the first wide gap."""
    where = lambda t: F.struct(F.when(_in_row(a, t), 0).when(_under(a, t), 1).alias("side"), t.alias("t"))
    item = lambda p: F.struct(p["t"]["x0"].alias("x0"), p["t"]["ord"].alias("ord"), p["t"].alias("t"))

    def row(placed: Column) -> Column:
        use = F.array_min(F.transform(placed, lambda p: p["side"]))
        top = F.array_min(F.transform(F.filter(placed, lambda p: p["side"] == 1), lambda p: p["t"]["cy"]))

        def chosen(u: Column) -> Column:
            level = lambda p: (u["use"] == 0) | (F.abs(p["t"]["cy"] - u["top"]) <= F.greatest(p["t"]["h"], a["h"]))
            return F.sort_array(F.transform(F.filter(placed, lambda p: (p["side"] == u["use"]) & level(p)), item))

        return let(F.struct(use.alias("use"), top.alias("top")), chosen)

    def up_to_gap(line: Column) -> Column:
        wide = lambda i: F.get(line, i)["x0"] - F.get(line, i - 1)["t"]["x1"] > F.greatest(F.lit(WIDE_GAP), a["h"] * WIDE_HEIGHTS)
        gaps = F.filter(F.transform(line, lambda _, i: F.when((i > 0) & wide(i), i)), lambda g: g.isNotNull())
        return F.slice(line, F.lit(1), F.coalesce(F.get(gaps, F.lit(0)), F.size(line)))

    placed = F.filter(F.transform(near(a, VALUE_REACH), where), lambda p: p["side"].isNotNull())
    return let(let(placed, row), up_to_gap)


def value_tokens(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens that spell the value of each label: right of it on its row, else the first row below it,
    left to right up to the first wide gap."""
    anchors = labels.select("page_id", "field", "match_score", *TOKEN)
    pairs = near_pairs(tokens, anchors, VALUE_REACH)
    in_row, under = _in_row(_of_row("a_"), _of_row()), _under(_of_row("a_"), _of_row())
    placed = pairs.withColumn("_where", F.when(in_row, 0).when(under, 1)).filter("_where IS NOT NULL")
    line = placed.groupBy("page_id", "field").agg(
        F.min("_where").alias("_use"), F.min(F.when(F.col("_where") == 1, F.col("cy"))).alias("_first_y")
    )
    chosen = placed.join(line, ["page_id", "field"]).filter(
        (F.col("_where") == F.col("_use"))
        & ((F.col("_use") == 0) | (F.abs(F.col("cy") - F.col("_first_y")) <= F.greatest("h", "a_h")))
    )
    # One line of text beside one label.
    row = Window.partitionBy("page_id", "field").orderBy("x0", "ord")
    wide = F.col("x0") - F.lag("x1").over(row) > F.greatest(F.lit(WIDE_GAP), F.col("a_h") * WIDE_HEIGHTS)
    gaps = chosen.withColumn("_gap", F.coalesce(wide, F.lit(False)).cast("int"))
    cut = F.max("_gap").over(row.rowsBetween(Window.unboundedPreceding, 0))
    return gaps.withColumn("_cut", cut).filter("_cut = 0").select(
        "page_id", "field", "match_score", *[f"a_{c}" for c in ("x0", "y0", "x1", "y1")], *TOKEN
    )


def property_fields(tokens: DataFrame, labels: dict[str, list[str]] = vocab.FIELD_LABELS, value_ok=field_value_ok) -> DataFrame:
    """Field values per page with label and value boxes, mean confidence and label match score."""
    line = lambda a: F.struct(a["field"].alias("field"), a["match_score"].alias("match_score"), a["l"].alias("l"), _value_line(a["l"]).alias("line"))
    # Computed once: what a generator unfolds, Spark also asks beforehand whether it is empty.
    read = _property_sheets(with_geometry(tokens), labels).select("page_id", once(F.transform(_best_labels(labels), line)).alias("_found"))
    found = read.select("page_id", F.inline("_found"))
    every = lambda c: F.transform("line", lambda p: p["t"][c])
    mean = F.aggregate(F.filter(every("score"), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v) / F.size(
        F.filter(every("score"), lambda v: v.isNotNull())
    )
    spelled = found.filter(F.size("line") > 0).select(
        "page_id", "field",
        F.round(mean, 4).alias("ocr_confidence"), F.round("match_score", 4).alias("label_match_score"),
        F.array(F.array_min(every("x0")), F.array_min(every("y0")), F.array_max(every("x1")), F.array_max(every("y1"))).alias("value_box"),
        F.array(*[F.col(f"l.{c}") for c in ("x0", "y0", "x1", "y1")]).alias("label_box"),
        F.array_join(every("text"), "").alias("value_text"),
    )
    return spelled.filter(value_ok(F.col("field"), F.col("value_text"))).withColumn("value", compact_label("value_text"))


def keep_region(tokens: DataFrame, pages: DataFrame, ratios: dict[str, float] = vocab.BOTTOM_RATIOS) -> DataFrame:
    """Tokens in the upper part of the page that their category is read in; ``pages`` has page_id and category.

    A page of a category without a ratio is read whole.
    """
    limit = F.create_map(*[F.lit(x) for pair in ratios.items() for x in pair])[F.col("category")]
    inside = F.coalesce((F.col("y0") + F.col("y1")) / 2 <= limit * 1000, F.lit(True))
    return tokens.join(shuffled(pages), "page_id").filter(inside).select(*tokens.columns)


def boxes_kept(records: DataFrame, ratios: dict[str, float] = vocab.BOTTOM_RATIOS) -> DataFrame:
    """Box counts per page before and after the region rule, on the array column det_boxes_1000."""
    limit = F.create_map(*[F.lit(x) for pair in ratios.items() for x in pair])[F.col("category")]
    inside = F.filter("det_boxes_1000", lambda b: F.coalesce((b[1] + b[3]) / 2 <= limit * 1000, F.lit(True)))
    return records.select(
        "page_id", "category", F.size("det_boxes_1000").alias("all_boxes"), F.size(inside).alias("selected_boxes")
    )


def pseudo_labels(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Label rows for review; ``pages`` has page_id, source_path, category, page, width and height."""
    joined = fields.join(shuffled(pages), "page_id")
    return joined.select(
        "page_id", "source_path", "category", "page", "field",
        grid_box(F.col("label_box"), "width", "height").alias("label_box_1000"),
        grid_box(F.col("value_box"), "width", "height").alias("value_box_1000"),
        "value_text", "ocr_confidence", "label_match_score", F.lit("pending_review").alias("annotation_status"),
    )


def label_records(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """One JSON record of shapes per page; fields are on the 0..1000 grid. Pages without shapes are kept."""
    joined = fields.join(shuffled(pages), "page_id").withColumn("_p", pixel_box(F.col("value_box"), "width", "height"))
    shape = F.struct(
        F.col("field").alias("label"),
        F.array(F.array(F.col("_p")[0], F.col("_p")[1]), F.array(F.col("_p")[2], F.col("_p")[3])).alias("points"),
        F.lit("rectangle").alias("shape_type"), F.struct(F.lit(True).alias("needs_review")).alias("flags"),
    )
    # At most one shape per field.
    shapes = joined.groupBy("page_id").agg(F.sort_array(F.collect_list(shape)).alias("shapes"))
    every = pages.join(shuffled(shapes), "page_id", "left").withColumn("shape_count", F.coalesce(F.size("shapes"), F.lit(0)))
    none = F.array().cast(dict(shapes.dtypes)["shapes"])
    body = F.to_json(
        F.struct(
            F.coalesce("shapes", none).alias("shapes"), F.col("image_file").alias("imagePath"),
            F.col("height").alias("imageHeight"), F.col("width").alias("imageWidth"),
        )
    )
    return every.select("page_id", F.greatest("shape_count", F.lit(0)).alias("shape_count"), body.alias("record"))


def compare_fields(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """Baseline fields with whether the variant read a comparable value."""
    other = variant.select("page_id", "field", F.col("value").alias("_variant"))
    joined = baseline.join(shuffled(other), ["page_id", "field"], "left")
    return joined.withColumn("matched", comparable("value", "_variant")).drop("_variant")
