"""Landed-HTML jobs: plain text, table rows, label/value pairs, detail records, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import (
    app_status, block_window, clean_text, col, filled, first_filled, let, match_places, once, text_blocks, text_cut,
)
from caseflow.operators.ranking import first_row

LINK_CONTEXT_CHARS = 900


def _decode_numeric(text: Column, form: str, base: int) -> Column:
    """Numeric entities as their characters, in one pass: what a replacement gives is not read again."""

    def char(entity: Column) -> Column:
        code = F.regexp_extract(entity, form, 1)
        number = F.conv(code, base, 10).try_cast("bigint")
        decoded = F.decode(F.unhex(F.lpad(F.conv(code, base, 16), 8, "0")), "UTF-32")
        return F.when(number.between(1, 0x10FFFF), F.coalesce(decoded, entity)).otherwise(entity)

    def joined(t: Column) -> Column:
        entities = F.transform(F.regexp_extract_all(t, F.lit(form), F.lit(0)), char)
        return F.array_join(F.zip_with(F.split(t, form, -1), entities, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(text, joined)


def decode_entities(value) -> Column:
    both = lambda t: F.when(
        t.rlike("&#"), _decode_numeric(_decode_numeric(t, r"&#(\d+);", 10), r"(?i)&#x([\da-f]+);", 16)
    ).otherwise(t)
    text = let(col(value), both)
    for form, char in [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&apos;|&#39;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")]:
        text = F.regexp_replace(text, form, char)
    return text


def plain_text(html) -> Column:
    """Text of HTML: no scripts or styles, block ends as line breaks, entities decoded, spaces folded."""
    text = F.coalesce(col(html), F.lit(""))
    text = F.regexp_replace(text, r"(?is)<script(?![A-Za-z0-9_])[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style(?![A-Za-z0-9_])[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|li|tr|th|td|h\d)>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = decode_entities(text)
    text = F.regexp_replace(text, r"[\t\r ]+", " ")
    text = F.regexp_replace(text, r" *\n+ *", "\n")
    return F.regexp_replace(text, r"^[\s　\x{a0}]+|[\s　\x{a0}]+$", "")


def flat_text(html) -> Column:
    return F.regexp_replace(F.regexp_replace(plain_text(html), r"[\s　\x{a0}]+", " "), "^ | $", "")


def row_cells(html: Column, row_tag: str = "tr", cell_tags: str = "th|td") -> Column:
    """Cells of every table row that has any, as an array of arrays of text."""
    rows = F.regexp_extract_all(html, F.lit(rf"(?is)<{row_tag}(?![A-Za-z0-9_])[^>]*>(.*?)</{row_tag}>"), F.lit(1))
    cell = rf"(?is)<(?:{cell_tags})(?![A-Za-z0-9_])[^>]*>(.*?)</(?:{cell_tags})>"
    cells = F.transform(
        rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(1)), lambda c: flat_text(c))
    )
    return F.filter(cells, lambda r: F.size(r) > 0)


def table_rows(pages: DataFrame, key: str, row_tag: str = "tr", cell_tags: str = "th|td") -> DataFrame:
    rows = pages.select(key, F.posexplode(row_cells(F.col("html"), row_tag, cell_tags)).alias("row_no", "cells"))
    return rows.select(key, F.col("row_no"), F.posexplode("cells").alias("cell_no", "cell"))


def label_pairs(rows: Column) -> Column:
    """(label, value) of alternating cells of every row; a label's closing colon goes."""
    of_row = lambda r: F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0)), F.lit(2)), lambda i: i + 1 < F.size(r)),
        lambda i: F.struct(
            F.trim(F.regexp_replace(F.get(r, i), "[：:]$", "")).alias("label"), F.trim(F.get(r, i + 1)).alias("value")
        ),
    )
    return F.filter(F.flatten(F.transform(rows, of_row)), lambda p: p["label"] != "")


def pick_field(pairs: Column, pattern: str) -> Column:
    """Value of the first pair whose label matches and whose value is not blank, else ''."""
    hits = F.filter(pairs, lambda p: p["label"].rlike(pattern) & (p["value"] != ""))
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


# Label patterns of a progress page.
DETAIL_LABELS = {
    "official_status": r"^(?:目前.*辦理(?:情形)?|辦理情形|處理情形|處理進度(?:\s*[（(]註[）)])?|目前進度|案件狀態)$",
    "receipt_no": "^收文號|收件文號",
    "company_name": "商業名稱|公司名稱|申請人公司名稱",
    "authority": "申登機關|登記機關|受理機關",
    "received_date": "收文日期|收件日期|收件時間",
    "outgoing_no": "發文文號",
    "outgoing_date": "發文日期",
    "subject": "^主旨",
}


def detail_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Progress record per landed detail page, and the pages whose status field was not found.

    ``pages`` has page_id, url, html and fallback_name.
    """
    pairs = pages.withColumn("_pairs", once(label_pairs(row_cells(F.col("html")))))
    read = pairs.select(
        "page_id", "url", "fallback_name", *[pick_field(F.col("_pairs"), p).alias(c) for c, p in DETAIL_LABELS.items()]
    )
    param = lambda name: F.coalesce(F.url_decode(F.try_parse_url("url", F.lit("QUERY"), F.lit(name))), F.lit(""))
    receipt = first_filled("receipt_no", param("receiveNo"), param("rcvNo"), param("caseNo"))
    good = read.filter("official_status <> ''").select(
        "page_id",
        F.regexp_replace(receipt, r"[^\dA-Za-z-]", "").alias("receipt_no"),
        first_filled("company_name", flat_text("fallback_name")).alias("company_name"),
        "authority", "received_date", "official_status",
        app_status("official_status").alias("app_status"),
        "outgoing_no", "outgoing_date", "subject", F.col("url").alias("progress_url"),
        param("agency").alias("agency_code"), param("regUnitCode").alias("reg_unit_code"), param("subAcptNo").alias("sub_case_no"),
    )
    return good, read.filter("official_status = ''").select("page_id", "url")


ATTRIBUTE = r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""


def tag_attributes(tag: Column) -> Column:
    """Attributes of a tag's inside as a map of lower-case names; the last of a repeated name wins."""
    group = lambda i: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(i))
    values = F.zip_with(F.zip_with(group(2), group(3), lambda a, b: F.concat(a, b)), group(4), lambda a, b: F.concat(a, b))
    named = F.zip_with(group(1), values, lambda k, v: F.struct(F.lower(k).alias("k"), decode_entities(v).alias("v")))
    keep_last = lambda e: F.filter(
        e, lambda x, i: F.array_position(F.transform(e, lambda y: y["k"]), x["k"]) == i + 1
    )
    return F.map_from_entries(let(F.reverse(named), keep_last))


LINK_PATTERN = r"""(?i)(?:https?://[^\s"']+|(?:/|\.\.?/)[^\s"']*detail/Query[^\s"']+\.do(?:\?[^\s"']*)?)"""


def resolve_url(link: Column, base: Column) -> Column:
    """Absolute form of a link found on the page at ``base``."""
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+((?:/[^/?#]*)*/)?", 1)
    path = F.when(link.startswith("/"), link).otherwise(F.concat(first_filled(folder, F.lit("/")), link))

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    def resolved(p: Column) -> Column:
        # The first part is the nothing before the first slash; a last . or .. leaves a folder.
        plain = F.regexp_replace(F.regexp_extract(p, r"^[^?#]*", 0), r"/(\.\.?)$", "/$1/")
        parts = let(F.split(plain, "/", -1), lambda s: F.slice(s, F.lit(2), F.size(s)))
        folded = F.aggregate(parts, F.array().cast("array<string>"), step)
        return F.concat(site, F.lit("/"), F.array_join(folded, "/"), F.regexp_extract(p, r"[?#].*$", 0))

    return F.when(link.rlike("(?i)^https?://"), link).otherwise(let(path, resolved))


def detail_link(raw: Column, base: Column, entity: Column, pattern: str = LINK_PATTERN) -> Column:
    """Detail page address named in raw attributes: a path, or the quoted arguments of a script call."""
    text = F.replace(decode_entities(raw), F.lit("\\/"), F.lit("/"))

    def found(source: Column) -> Column:
        path = F.regexp_extract(source, pattern, 0)
        quoted = F.regexp_extract_all(source, F.lit("""['"]([^'"]+)['"]"""), F.lit(1))
        first = lambda form: F.get(F.filter(quoted, lambda q: q.rlike(form)), F.lit(0))
        numbers = F.filter(quoted, lambda q: q.rlike(r"^\d{9,12}$"))
        agency, case_no = first(r"(?i)^\d{9}[A-Z]$"), F.get(numbers, F.lit(0))
        business = F.concat(
            F.lit(vocab.BUSINESS_DETAIL_URL + "?caseNo="), case_no, F.lit("&agency="), agency, F.lit("&receiveNo="),
            F.coalesce(F.get(numbers, F.lit(1)), case_no), F.lit("&subAcptNo="), F.coalesce(first(r"^\d{2}$"), F.lit("01")),
        )
        company = F.concat(
            F.lit(vocab.COMPANY_DETAIL_URL + "?rcvNo="), case_no, F.lit("&regUnitCode="),
            F.coalesce(first(r"^\d{1,4}$"), F.lit("17")), F.lit("&showPreRegNo=0"),
        )
        by_call = F.when(entity == "行號", business).otherwise(company)
        return F.when(path != "", resolve_url(path, base)).otherwise(F.coalesce(by_call, F.lit("")))

    return let(text, found)


ANCHOR = r"(?is)<(?:a|button)\b([^>]*)>(.*?)</(?:a|button)>"


def link_candidates(pages: DataFrame, pattern: str = LINK_PATTERN, row_tag: str = "tr", cell_tags: str = "th|td") -> DataFrame:
    """Detail links per result page with a score from the text around them; one row per distinct address.

    ``pages`` has page_id, url, html, entity_type, tax_id and company_name. Pages without any link fall back
    to the rows that name the tax id or the company.
    """
    tag = r"(?is)^<(?:a|button)(?![A-Za-z0-9_])([^>]*)>"
    url, entity = F.col("url"), F.col("entity_type")
    has_anchor = F.col("html").rlike(r"(?i)<(?:a|button)(?![A-Za-z0-9_])")
    anchored = F.when(has_anchor, F.col("html"))
    spanned = pages.withColumn("_spans", once(match_places(anchored, ANCHOR))).withColumn("_blocks", once(text_blocks(anchored)))

    def link_of(inside: Column) -> Column:
        raw = let(
            tag_attributes(inside),
            lambda m: F.concat_ws(" ", *[filled(m[name]) for name in ("href", "onclick", "data-href")], filled(inside)),
        )
        return detail_link(raw, url, entity, pattern)

    def context_of(m: Column) -> Column:
        return flat_text(block_window(F.col("_blocks"), m["start"] - LINK_CONTEXT_CHARS, m["stop"] + LINK_CONTEXT_CHARS))

    found = lambda link, score, place: F.struct(link.alias("link"), score.alias("score"), place.alias("place"))
    holds = lambda text, c: (F.col(c) != "") & F.contains(text, F.col(c))
    points = lambda text: 1 + F.when(holds(text, "tax_id"), 12).otherwise(0) + F.when(holds(text, "company_name"), 8).otherwise(0)
    links = F.transform(
        "_spans", lambda m: F.struct(let(F.regexp_extract(m["text"], tag, 1), link_of).alias("link"), m.alias("m"))
    )
    by_anchor = F.transform(
        F.filter(links, lambda x: x["link"] != ""), lambda x: found(x["link"], let(context_of(x["m"]), points), x["m"]["start"])
    )
    row_html = rf"(?is)<{row_tag}(?![A-Za-z0-9_])[^>]*>.*?</{row_tag}>"
    unnamed = lambda text, c: (F.col(c) != "") & ~F.contains(text, F.col(c))
    row_link = lambda r: F.when(
        let(
            F.array_join(F.flatten(row_cells(r, row_tag, cell_tags)), " "),
            lambda text: (text != "") & ~(unnamed(text, "tax_id") & unnamed(text, "company_name")),
        ),
        detail_link(r, url, entity, pattern),
    ).otherwise("")
    by_row = F.filter(
        F.transform(F.regexp_extract_all("html", F.lit(row_html), F.lit(0)), lambda r, i: found(row_link(r), F.lit(5), i)),
        lambda x: x["link"] != "",
    )
    read = spanned.withColumn("_links", once(by_anchor))
    kept = read.select("page_id", F.explode(F.when(F.size("_links") > 0, F.col("_links")).otherwise(by_row)).alias("k"))
    return first_row(kept.select("page_id", "k.*"), ["page_id", "link"], [-F.col("score"), F.col("place")])


# The places of a tax response row, and how long its stored columns are.
TAX_COLUMNS = {"tax_id": 8, "business_name": 200, "received_date": 30, "receipt_no": 100, "case_type": 200, "official_status": 100}


def tax_payload_rows(payloads: DataFrame, key: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Typed rows of a landed tax response: positional arrays; "N" or nothing means no rows.

    Texts are whole unless ``limits`` (characters by column, such as ``TAX_COLUMNS``) cut them; ``truncated`` tells where they did.
    """
    limits = limits or {}
    rows = payloads.select(key, F.posexplode(F.from_json("payload", "array<array<string>>")).alias("row_no", "r"))
    item = lambda i: F.get("r", F.lit(i))
    cut = F.lit(False)
    for i, name in enumerate(TAX_COLUMNS):
        cut = cut | text_cut(item(i), limits.get(name))
    texts = [clean_text(item(i), limits.get(name)).alias(name) for i, name in enumerate(TAX_COLUMNS)]
    return rows.select(key, "row_no", *texts, cut.alias("truncated")).filter("receipt_no <> '' OR received_date <> '' OR official_status <> ''")
