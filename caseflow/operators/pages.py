"""Page-text jobs: address candidates, document types, page ranges, labelled fields, certificates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import (
    block_window, col, digits, document_address, first_valid_id, fold_width, if_filled, let, match_places, once, plausible_name,
    precheck_ok, roc_date, text_blocks,
)
from caseflow.operators.ranking import first_row, numbered

SPACES = r"[\s　]+"
# The intake refuses longer files; ``ocr_routing`` tells them, no text is cut.
PAGE_LIMIT = 25

# Points of an address candidate, and the scores from which it is trusted.
BASE_POINTS, MOST_LENGTH_POINTS, TARGET_POINTS, NEGATIVE_POINTS, NUMBERED_POINTS, PERSON_POINTS = 35, 20, 35, 42, 12, 35
HIGH_SCORE, MIDDLE_SCORE = 85, 55


def address_candidates(
    pages: DataFrame,
    pattern: str = vocab.ADDRESS_PATTERN,
    targets: list[str] = vocab.ADDRESS_TARGET_CONTEXTS,
    negatives: list[str] = vocab.ADDRESS_NEGATIVE_CONTEXTS,
    person_terms: str = vocab.ADDRESS_PERSON_TERMS,
    numbered_part: str = r"\d+(?:號|樓)",
    normalise: Callable[[Column], Column] = document_address,
    min_length: int = 8,
) -> DataFrame:
    """Every address-like match of every page with its evidence window, score and confidence.

    Matches and windows are cut from the page before it is taken apart, so no match row carries the page's text.
    """
    around = vocab.ADDRESS_CONTEXT_CHARS

    def cut(page: Column) -> Column:
        item = lambda blocks: F.transform(
            match_places(page, pattern),
            lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), block_window(blocks, m["start"] - around, m["stop"] + around).alias("window")),
        )
        return let(text_blocks(page), item)

    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\r"), F.lit("\n"))
    hits = pages.filter(text.rlike(pattern)).select("file_id", "page", F.explode(let(text, cut)).alias("_m"))
    found = hits.select(
        "file_id", "page", F.col("_m.start").alias("start"), once(normalise(F.col("_m.text"))).alias("address"),
        F.trim(F.regexp_replace("_m.window", SPACES, " ")).alias("evidence"),
    )
    found = found.filter((F.length("address") >= min_length) & ~F.col("address").rlike(r"[A-Z][12]\d{8}"))
    count_of = lambda words: sum((F.contains("evidence", F.lit(w)).cast("int") for w in words), F.lit(0))
    score = (
        BASE_POINTS + F.least(F.lit(MOST_LENGTH_POINTS), F.length("address")) + count_of(targets) * TARGET_POINTS - count_of(negatives) * NEGATIVE_POINTS
        + F.when(F.col("address").rlike(numbered_part), NUMBERED_POINTS).otherwise(0)
        - F.when(F.col("evidence").rlike(person_terms), PERSON_POINTS).otherwise(0)
    )
    confidence = F.when(F.col("score") >= HIGH_SCORE, "高").when(F.col("score") >= MIDDLE_SCORE, "中").otherwise("低")
    return found.withColumn("score", score).withColumn("confidence", confidence)


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Best-scored occurrence of each address of a file, the earliest on a tie."""
    return first_row(candidates, ["file_id", "address"], [-F.col("score"), F.col("page"), F.col("start")])


def candidate_rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("page"), F.col("start"), F.col("address")]


def replace_by_source(current: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Rows of the re-read sources give way to their new rows; other sources stay."""
    read_again = fresh.select(source).distinct()
    return current.join(read_again, source, "left_anti").unionByName(fresh)


def detect_page_types(
    pages: DataFrame,
    definitions: list[tuple[str, str, list[str]]] = vocab.DOCUMENT_TYPES,
    checklist: str = vocab.CHECKLIST_PATTERN,
    exempt: str = vocab.CHECKLIST_EXEMPT_KEY,
) -> DataFrame:
    """Document types whose keywords a page holds; on a checklist page only the exempt type counts."""
    is_checklist = F.coalesce(F.col("text").rlike(checklist), F.lit(False))

    def hit(place: int, key: str, label: str, keywords: list[str]) -> Column:
        matched = F.filter(F.array(*map(F.lit, keywords)), lambda w: F.contains(F.col("text"), w))
        allowed = F.lit(True) if key == exempt else ~is_checklist
        return F.when(
            allowed,
            F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit(label).alias("label"), matched.alias("matched")),
        )

    hits = F.array_compact(F.array(*[hit(i, *d) for i, d in enumerate(definitions)]))
    found = pages.select("file_id", "page", F.explode(F.filter(hits, lambda h: F.size(h["matched"]) > 0)).alias("h"))
    return found.select(
        "file_id", "page", "h.place", "h.key", "h.label", "h.matched",
        F.least(F.lit(100), F.size("h.matched") * 35).alias("score"),
        F.when(F.size("h.matched") >= 2, "高").otherwise("低").alias("confidence"),
    )


def page_ranges(pages: DataFrame, keys: list[str], page: str = "page", slice_pages: int = 100_000) -> DataFrame:
    """Page numbers of each group as a range text such as ``1-2,5``.

    Runs are found on distinct pages; only the runs of a group meet, not its pages.
    """
    distinct = pages.select(*keys, page).distinct()
    placed = numbered(distinct, keys, [F.col(page)], "_no", F.floor(F.col(page) / slice_pages))
    runs = placed.groupBy(*keys, (F.col(page) - F.col("_no")).alias("_run")).agg(
        F.min(page).alias("_from"), F.max(page).alias("_to")
    )
    text = F.when(F.col("_from") == F.col("_to"), F.col("_from").cast("string")).otherwise(
        F.concat(F.col("_from").cast("string"), F.lit("-"), F.col("_to").cast("string"))
    )
    listed = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_from", text.alias("t")))).alias("_runs"))
    return listed.select(*keys, F.array_join(F.transform("_runs", lambda r: r["t"]), ",").alias("page_range"))


def document_types(pages: DataFrame, **settings) -> DataFrame:
    """Document types of each file: best score, page range and the distinct keywords seen, in order."""
    hits = detect_page_types(pages, **settings)
    words = (
        hits.select("file_id", "key", "page", F.posexplode("matched").alias("nth", "word"))
        .groupBy("file_id", "key", "word")
        .agg(F.min(F.struct("page", "nth")).alias("first"))
        .groupBy("file_id", "key")
        .agg(F.sort_array(F.collect_list(F.struct("first", "word"))).alias("w"))
        .select("file_id", "key", F.array_join(F.transform("w", lambda x: x["word"]), "、").alias("evidence"))
    )
    scores = hits.groupBy("file_id", "key").agg(
        F.max("score").alias("score"), F.first("label").alias("label"), F.first("place").alias("place")
    )
    ranges = page_ranges(hits, ["file_id", "key"])
    return scores.join(words, ["file_id", "key"]).join(ranges, ["file_id", "key"]).withColumn(
        "confidence", F.when(F.col("score") >= 70, "高").otherwise("低")
    )


def parse_page_range(value, page_count) -> Column:
    """Struct(pages, error) of a range text: each segment is checked before it is expanded."""
    shape = r"^(\d+)(?:-(\d+))?$"
    text, limit = F.coalesce(col(value), F.lit("")), col(page_count).cast("long")
    segments = F.transform(F.split(text, ","), lambda s: F.trim(s))
    bounds_of = lambda segments: F.transform(
        segments,
        lambda s: F.struct(
            F.regexp_extract(s, shape, 1).try_cast("long").alias("a"),
            F.coalesce(F.regexp_extract(s, shape, 2).try_cast("long"), F.regexp_extract(s, shape, 1).try_cast("long")).alias("b"),
        ),
    )
    in_range = lambda s: (s["a"] >= 1) & (s["b"] >= s["a"]) & (s["b"] <= limit)

    def checked(r: Column) -> Column:
        return F.struct(
            r["bounds"].alias("bounds"),
            F.when(F.trim(text) == "", "blank")
            .when(~F.forall(r["segments"], lambda s: s.rlike(shape)), "format")
            .when(~F.forall(r["bounds"], lambda s: F.coalesce(in_range(s), F.lit(False))), "range").alias("error"),
        )

    def expanded(r: Column) -> Column:
        pages = F.sort_array(F.array_distinct(F.flatten(F.transform(r["bounds"], lambda s: F.sequence(s["a"], s["b"])))))
        return F.struct(F.when(r["error"].isNull(), pages).alias("pages"), r["error"].alias("error"))

    parts = let(segments, lambda s: F.struct(s.alias("segments"), bounds_of(s).alias("bounds")))
    return let(let(parts, checked), expanded)


def ocr_routing(files: DataFrame, pages: DataFrame, best_scores: DataFrame, purpose: str = "address") -> DataFrame:
    """What to do with each file: review, an error, OCR or the text layer alone.

    ``files`` has file_id, suffix, size_bytes and page_count; ``best_scores`` has file_id and best_score.
    """
    lengths = pages.groupBy("file_id").agg(F.sum(F.length(F.trim("text"))).alias("text_length"))
    joined = files.join(lengths, "file_id", "left").join(best_scores, "file_id", "left")
    found = F.coalesce(F.col("best_score") >= 55, F.lit(False))
    need = (F.coalesce("text_length", F.lit(0)) < 80) | (F.lit(purpose == "address") & ~found)
    route = (
        F.when(F.col("suffix").isin("doc", "docx"), "manual")
        .when(F.col("size_bytes") > 25 * 1024 * 1024, "too_large")
        .when((F.col("suffix") == "pdf") & (F.col("page_count") > PAGE_LIMIT), "too_many_pages")
        .when(F.col("suffix") != "pdf", "ocr")
        .when(need, "ocr")
        .otherwise("text_layer")
    )
    return joined.select("file_id", "text_length", route.alias("route"))


def needs_ocr(pages: DataFrame, skipped: list[str] = vocab.SKIPPED_CATEGORIES, max_pages: int = 0, min_chars: int = 120) -> DataFrame:
    """Outcome per page: skipped category, beyond the page limit, usable text layer, or OCR."""
    chars = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, ""))
    outcome = F.when(F.col("category").isin(skipped), "skipped_category")
    if max_pages:
        outcome = outcome.when(F.col("page") > max_pages, "beyond_limit")
    return pages.withColumn("outcome", outcome.when(chars >= min_chars, "text_layer").otherwise("ocr"))


def export_plan(detections: DataFrame, decisions: DataFrame, files: DataFrame) -> DataFrame:
    """What a batch download holds per file: split parts of approved detections, and the original where needed.

    The original stays when nothing was split off, or a low-confidence detection is still open.
    """
    keys = ["file_id", "key", "page_range"]
    judged = detections.join(decisions, keys, "left").filter("decision IS NULL OR decision <> 'dismissed'")
    approved = (F.col("confidence") == "高") | F.coalesce(F.col("decision") == "confirmed", F.lit(False))
    judged = judged.withColumn("approved", approved).join(files, "file_id")
    splits = judged.filter("approved AND suffix = 'pdf' AND page_count > 0").select(
        "file_id", F.concat("label", F.lit(".pdf")).alias("name"), "page_range"
    )
    state = judged.groupBy("file_id").agg(
        F.bool_or(F.expr("approved AND suffix = 'pdf' AND page_count > 0")).alias("_split"),
        F.bool_or(F.expr("confidence = '低' AND NOT approved")).alias("_open"),
    )
    kept = files.join(state, "file_id", "left").filter("NOT coalesce(_split, FALSE) OR coalesce(_open, FALSE)")
    originals = kept.select(
        "file_id", F.concat(F.col("file_id").cast("string"), F.lit("."), "suffix").alias("name"), F.lit("").alias("page_range")
    )
    return splits.unionByName(originals)


# ---- labelled fields -------------------------------------------------------------------------------------------

# Labels and shapes of a pre-check certificate.
PRECHECK_LABEL = r"(?:公司\s*名稱\s*)?預\s*查\s*(?:核\s*定\s*)?(?:編\s*號|案\s*號|號\s*碼)"
APPROVAL_LABEL = r"(?:核\s*准|核\s*定|發\s*文)\s*日\s*期"
EXPIRY_LABEL = r"(?:核\s*准\s*)?(?:名\s*稱\s*)?保\s*留\s*(?:期\s*限|至)"
COMPANY_LABEL = r"(?:核\s*准\s*(?:之\s*)?|預\s*查\s*)?公\s*司\s*名\s*稱"
DATE_FRAGMENT = (
    r"(?:中\s*華\s*民\s*國\s*|民\s*國\s*)?(?:(?:\d[\s　]*){2,4}\s*(?:年|[/.\-])\s*(?:\d[\s　]*){1,2}\s*(?:月|[/.\-])"
    r"\s*(?:\d[\s　]*){1,2}\s*日?|(?:\d[\s　]*){7,8})"
)
COMPANY_SHAPE = r"^([㐀-鿿A-Za-z0-9（）()·]{2,40}(?:股份)?有限公司)"
COMPANY_FORM_TITLES = "預查核定書|申請書|登記表"
# The end of a code is a boundary between ASCII word characters and others; CJK text is not a word here.
CODE_SHAPE = (
    r"(?<![A-Za-z0-9_])[A-Z]{1,2}[\s.\-]*(?:\d[\s.\-]*){5,6}"
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
BUSINESS_NAME_SHAPE = "^([㐀-鿿，、（）()]{1,59}業務?)"


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(F.regexp_replace(x, "^[\\s　]+|[\\s　]+$", ""))), lambda x: x != "")


def labelled_line(lines: Column, label: str, extract: Callable[[Column], Column]) -> Column:
    """First non-blank value after a label: on the label's line, else on the line below it."""

    def at(line: Column, i: Column) -> Column:
        rest = F.regexp_replace(line, f"^.*?(?:{label})", "")
        below = F.coalesce(F.get(lines, i + 1), F.lit(""))
        return F.when(line.rlike(label), F.coalesce(if_filled(extract(rest)), if_filled(extract(below))))

    return F.get(F.filter(F.transform(lines, at), lambda v: v.isNotNull()), F.lit(0))


def labelled_text(text: Column, label: str, extract: Callable[[Column], Column], reach: int = 120) -> Column:
    """First non-blank value within ``reach`` characters after any occurrence of a label."""
    tails = F.regexp_extract_all(text, F.lit(f"(?s)(?:{label})(?=(.{{0,{reach}}}))"), F.lit(1))
    return F.get(F.filter(F.transform(tails, extract), lambda v: v != ""), F.lit(0))


def _number(value: Column) -> Column:
    return let(digits(F.regexp_extract(value, r"(?:\d[\s　.\-/]*){9}", 0)), lambda n: F.when(precheck_ok(n), n).otherwise(""))


def _date(value: Column) -> Column:
    return roc_date(F.regexp_extract(value, DATE_FRAGMENT, 0))


def _company(value: Column, titles: bool = True) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(fold_width(value), r"^[\s　:：;；,，.。\-_=]+", ""), SPACES, "")
    name = F.regexp_extract(cleaned, COMPANY_SHAPE, 1)
    return let(name, lambda n: F.when(n.rlike(COMPANY_FORM_TITLES), "").otherwise(n)) if titles else name


def _business_name(value: Column) -> Column:
    text = F.regexp_replace(fold_width(value), r"^[\s　:：;；,，、.。\-_=()（）\d]+", "")
    text = F.replace(F.regexp_replace(text, SPACES, ""), F.lit(","), F.lit("，"))
    return F.regexp_extract(text, BUSINESS_NAME_SHAPE, 1)


def _first_of_each_code(items: Column) -> Column:
    """Items without those whose code came before, in their order; sorted twice, so long lists stay cheap."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(x["code"].alias("code"), i.alias("i"), x["name"].alias("name"))))
    firsts = let(
        placed, lambda p: F.filter(p, lambda x, j: (j == 0) | (F.coalesce(F.get(p, j - 1)["code"], F.lit("")) != x["code"]))
    )
    ordered = F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"], x["code"], x["name"])))
    return F.transform(ordered, lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name")))


def business_items(lines: Column) -> Column:
    """Coded business items: the name follows the code or opens the next line; the first of a code is kept."""

    def on_line(line: Column, i: Column) -> Column:
        upper = F.upper(line)
        codes = F.transform(F.regexp_extract_all(upper, F.lit(CODE_SHAPE), F.lit(0)), lambda c: F.regexp_replace(c, "[^A-Z0-9]", ""))
        after = let(F.split(upper, CODE_SHAPE), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))
        below = F.get(F.split(F.coalesce(F.get(lines, i + 1), F.lit("")), CODE_SHAPE), F.lit(0))
        return F.zip_with(
            codes, after,
            lambda c, rest: F.struct(
                c.alias("code"), F.coalesce(if_filled(_business_name(rest)), _business_name(below)).alias("name")
            ),
        )

    found = F.filter(
        F.flatten(F.transform(lines, on_line)),
        lambda x: x["code"].rlike(r"^(?:[A-Z]\d{6}|[A-Z]{2}\d{5})$") & (F.coalesce(x["name"], F.lit("")) != ""),
    )
    return let(found, _first_of_each_code)


def precheck_records(files: DataFrame) -> DataFrame:
    """Number, dates, company and business items of pre-check certificates; ``files`` has file_id and text.

    A text is searched line by line only for the labels that it has anywhere.
    """
    folded = files.withColumn("_folded", once(fold_width("text")))
    with_lines = folded.withColumn("_lines", once(text_lines(F.col("_folded"))))
    lines, text = F.col("_lines"), F.col("text")

    def either(label: str, extract: Callable[[Column], Column], loose: Callable[[Column], Column] | None = None) -> Column:
        found = F.coalesce(labelled_line(lines, label, extract), labelled_text(text, label, loose or extract), F.lit(""))
        return F.when(F.col("_folded").rlike(label) | text.rlike(label), found).otherwise("")

    none = F.array().cast("array<struct<code:string,name:string>>")
    has_code = F.upper("_folded").rlike(CODE_SHAPE)
    return with_lines.select(
        "file_id",
        either(PRECHECK_LABEL, _number).alias("precheck_number"),
        either(APPROVAL_LABEL, _date).alias("approval_date"),
        either(EXPIRY_LABEL, _date).alias("expiry_date"),
        either(COMPANY_LABEL, _company, lambda v: _company(v, False)).alias("company_name"),
        F.when(has_code, business_items(lines)).otherwise(none).alias("business_items"),
    )


def identity_records(files: DataFrame) -> DataFrame:
    """First valid identity number and labelled name of each file's text."""
    lines = text_lines(F.replace(F.col("text"), F.lit("\r"), F.lit("\n")))
    only_cjk = lambda v: F.regexp_replace(v, "[^㐀-鿿]", "")

    def name_at(line: Column, i: Column, every: Column) -> Column:
        value = F.regexp_replace(line, r"^.*?姓\s*名\s*[:：]?\s*", "")
        value = F.regexp_replace(value, "(?:身分證|國籍|出生|民國|發證|住址|地址).*$", "")
        same = F.substring(only_cjk(value), 1, 4)
        below = only_cjk(F.coalesce(F.get(every, i + 1), F.lit("")))
        plausible = lambda v: plausible_name(v, vocab.NAME_EXCLUSIONS_TEXT)
        usable = line.rlike(r"姓\s*名") & ~line.rlike(r"^(?:(?!姓\s*名).)*(?:地址|住址).*?姓\s*名")
        checked = lambda v: let(v, lambda x: F.when(plausible(x), x))
        return F.when(usable, F.coalesce(checked(same), checked(below)))

    name = let(
        lines,
        lambda every: F.get(F.filter(F.transform(every, lambda x, i: name_at(x, i, every)), lambda v: v.isNotNull()), F.lit(0)),
    )
    return files.select(
        "file_id", first_valid_id("text").alias("national_id"), F.coalesce(name, F.lit("")).alias("name")
    )


def approval_fields(text: Column) -> Column:
    """Document number and first date of an approval letter."""
    chinese = r"(?:中華民國\s*)?(\d{2,4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    numeric = r"(?<![A-Za-z0-9_])(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?![A-Za-z0-9_])"

    def iso(form: str) -> Column:
        part = lambda i: F.regexp_extract(text, form, i).try_cast("int")
        year = F.when(part(1) < 1911, part(1) + 1911).otherwise(part(1))
        day = F.try_make_timestamp(year, part(2), part(3), F.lit(0), F.lit(0), F.lit(0))
        return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))

    number = F.regexp_extract(text, r"(?:發文字號|文號)\s*[:：]?\s*([^\s　，。]{3,60})", 1)
    date = F.when(text.rlike(chinese), iso(chinese)).when(text.rlike(numeric), iso(numeric)).otherwise("")
    return F.struct(number.alias("document_number"), date.alias("approval_date"))


def provided_pages(files: DataFrame, read_pages: Callable, key: str = "file_id") -> DataFrame:
    """Page texts of files by a caller's reader: ``read_pages(row)`` yields (page, text) of one file.

    The reader runs inside the tasks that hold the files; one file's pages are in memory at a time.
    """
    import pandas as pd

    def read(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = list(read_pages(row))
                yield pd.DataFrame(
                    {key: [getattr(row, key)] * len(found), "page": [p for p, _ in found], "text": [x for _, x in found]}
                )

    kind = dict(files.dtypes)[key]
    return files.mapInPandas(read, f"{key} {kind}, page long, text string")
