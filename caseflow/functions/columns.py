"""Column expressions: blanks, dates, numbers, identifiers, addresses and status words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions import vocab

FULL_WIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ／－．：（）　"
HALF_WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/-.:() "
# Java's \s leaves out the ideographic space; the sources this runs on use both.
SPACE = r"[\s　]"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where Spark would copy it into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """A column for ``withColumn`` that is computed once per row.

    Spark copies a plain column into every later filter and projection that names it; it does not look into
    a generated one.
    """
    return F.explode(F.array(value))


def running_sums(numbers: Column, step: int = 64) -> Column:
    """Running sums of an array of whole numbers, by groups of ``step``, so that the work stays far below the square of its size."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)

    def with_groups(sums: Column) -> Column:
        before = F.transform(sums, lambda _, g: total(F.slice(sums, F.lit(1), g)))
        own = lambda bases: F.transform(numbers, lambda _, i: F.get(bases, (i / step).cast("int")) + total(F.slice(numbers, i - i % step + 1, i % step + 1)))
        return let(before, own)

    firsts = F.filter(numbers, lambda _, i: i % step == 0)  # one element for each group
    return let(F.transform(firsts, lambda _, g: total(F.slice(numbers, g * step + 1, F.lit(step)))), with_groups)


def match_places(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and non-overlapping: array of (text, start, stop), 0-based, in characters.

    The places are summed up from the gaps between the matches. A pattern that matches the empty text is not for this.
    """

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        item = lambda stops: F.transform(
            found, lambda m, i: F.struct(m.alias("text"), (F.get(stops, i) - F.length(m)).cast("int").alias("start"), F.get(stops, i).cast("int").alias("stop"))
        )
        return let(steps, lambda lengths: let(running_sums(lengths), item))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


BLOCK_CHARS = 2048


def text_blocks(text: Column) -> Column:
    """The text in blocks, for ``block_window``: a substring far into a long text is found by walking it from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def block_window(blocks: Column, begin: Column, end: Column) -> Column:
    """Characters ``begin`` (0-based) to ``end`` of a text given by its blocks; the ends may lie outside."""
    first = lambda b: F.floor(b / BLOCK_CHARS).cast("int")
    cut = lambda b: F.substr(
        F.array_join(F.slice(blocks, first(b) + 1, first(end) - first(b) + 1), ""), (b - first(b) * BLOCK_CHARS + 1).cast("int"), (end - b).cast("int")
    )
    return let(F.greatest(begin, F.lit(0)), cut)


def if_filled(value: Column) -> Column:
    """The value, or null when it is blank; for values that are costly to compute."""
    return let(value, lambda v: F.when(v != "", v))


def filled(value) -> Column:
    """The value, or null when it is blank."""
    return F.nullif(col(value), F.lit(""))


def first_filled(*values) -> Column:
    """First non-blank value, else ''."""
    return F.coalesce(*[filled(v) for v in values], F.lit(""))


def clean_text(value, length: int | None = None) -> Column:
    """Trimmed text, '' for null; cut at ``length`` characters only where one is given."""
    text = F.coalesce(F.trim(col(value)), F.lit(""))
    return text if length is None else F.substring(text, 1, length)


def text_cut(value, length: int | None) -> Column:
    """Whether ``clean_text`` with this length drops anything."""
    return F.lit(False) if length is None else F.coalesce(F.length(F.trim(col(value))) > length, F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, never below 0; 0 when either is missing."""
    return F.coalesce(F.greatest(F.datediff(end, start), F.lit(0)), F.lit(0))


def fold_width(value) -> Column:
    return F.translate(col(value), FULL_WIDTH, HALF_WIDTH)


def fold_glyphs(value) -> Column:
    """Half-width letters and digits, then traditional for the listed simplified glyphs."""
    return F.translate(col(value), FULL_WIDTH + vocab.SIMPLIFIED, HALF_WIDTH + vocab.TRADITIONAL)


def padded(number: Column, width: int) -> Column:
    """Zero-padded to at least width digits; longer numbers keep all digits."""
    return F.format_string(f"%0{width}d", number)


def roc_date(value) -> Column:
    """ROC or Western date text as ``YYY/MM/DD``, '' unless it is a real day of ROC year 1 to 199."""
    text = F.regexp_replace(fold_width(F.coalesce(col(value), F.lit(""))), SPACE + "+", "")
    text = F.regexp_replace(text, "^中華民國", "")
    text = F.regexp_replace(text, "^民國", "")
    text = F.regexp_replace(text, r"[年月.\-]", "/")
    text = F.regexp_replace(text, "日$", "")
    text = F.regexp_replace(text, "/{2,}", "/")
    text = F.regexp_replace(text, "^/+|/+$", "")
    text = F.regexp_replace(text, r"^(\d{3})(\d{2})(\d{2})$", "$1/$2/$3")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1/$2/$3")
    return let(text, _checked_roc_date)


def _checked_roc_date(text: Column) -> Column:
    shape = r"^(\d{2,4})/(\d{1,2})/(\d{1,2})$"
    part = lambda i: F.regexp_extract(text, shape, i).try_cast("int")
    year = F.when(part(1) >= 1912, part(1)).otherwise(part(1) + 1911)
    real_day = F.try_make_timestamp(year, part(2), part(3), F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    good = text.rlike(shape) & real_day & (year - 1911).between(1, 199)
    return F.when(
        good, F.concat_ws("/", padded(year - 1911, 3), padded(part(2), 2), padded(part(3), 2))
    ).otherwise("")


# Year, then month and day in groups 2 and 3, 4 and 5, or 6 and 7.
ROC_LOOSE_FORM = r"(?s)^(\d{2,3})(?:[/.\-](\d{1,2})[/.\-](\d{1,2})|年(\d{1,2})月(\d{1,2})日|(\d{2})(\d{2})$).*"


def roc_to_iso(value) -> Column:
    """ISO text of a ROC date at the start of the text; shape is checked, the calendar is not."""
    text = clean_text(value, 30)
    year = F.regexp_extract(text, ROC_LOOSE_FORM, 1).try_cast("int") + 1911
    rest = F.regexp_replace(F.regexp_replace(text, ROC_LOOSE_FORM, "-0$2$4$6-0$3$5$7"), r"-0(\d\d)", "-$1")
    return F.when(text.rlike(ROC_LOOSE_FORM), F.concat(year.cast("string"), rest)).otherwise("")


def roc_rank(value) -> Column:
    """Sortable number of a ROC date at the start of the text, 0 when there is none."""
    form = "^" + SPACE + r"*(\d{2,3})(?:年|[/.\-])(\d{1,2})(?:月|[/.\-])(\d{1,2})"
    part = lambda i: F.regexp_extract(col(value), form, i).try_cast("long")
    return F.when(col(value).rlike(form), (part(1) + 1911) * 10000 + part(2) * 100 + part(3)).otherwise(0).cast("long")


def roc_parts(day) -> Column:
    """ROC year, month and day of a date as text, blank when it is missing."""
    day = col(day)
    text = lambda n: F.coalesce(n.cast("string"), F.lit(""))
    return F.struct(
        text(F.year(day) - 1911).alias("roc_year"), text(F.month(day)).alias("roc_month"), text(F.dayofmonth(day)).alias("roc_day")
    )


def roc_part_ok(value, low: int, high: int, required: bool = False) -> Column:
    text = clean_text(value, 3)
    number = text.try_cast("int")
    good = text.rlike(r"^\d{1,3}$") & number.between(low, high)
    return F.coalesce(good, F.lit(False)) if required else ((text == "") | F.coalesce(good, F.lit(False)))


def id_text(value) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col(value), F.lit(""))), "[^A-Z0-9]", "")


def national_id_ok(value) -> Column:
    """Letter, 1 or 2, eight digits, and a weighted sum divisible by ten."""
    return let(id_text(value), checksum_holds)


def checksum_holds(text: Column) -> Column:
    """``national_id_ok`` of a text that ``id_text`` leaves as it is."""
    letters = F.create_map(*[F.lit(x) for pair in vocab.ID_LETTER_VALUES.items() for x in pair])
    letter = letters[F.substring(text, 1, 1)]
    digit = lambda at: F.ascii(F.substring(text, at, 1)) - 48
    total = F.floor(letter / 10) + letter % 10 * 9 + digit(10)
    for at in range(2, 10):
        total = total + digit(at) * (10 - at)
    return text.rlike(r"^[A-Z][12]\d{8}$") & F.coalesce(total % 10 == 0, F.lit(False))


SPACED_ID = r"[A-Z](?:[\s\-_.:：]*\d){9}"


def first_valid_id(text) -> Column:
    """First spaced or punctuated identity number in the text whose checksum holds, else ''."""
    found = F.regexp_extract_all(F.upper(col(text)), F.lit(SPACED_ID), F.lit(0))
    bare = F.transform(found, lambda v: F.regexp_replace(v, "[^A-Z0-9]", ""))  # upper-cased before, which costs more than all else here
    return F.coalesce(F.get(F.filter(bare, checksum_holds), F.lit(0)), F.lit(""))


def digits(value) -> Column:
    return F.regexp_replace(fold_width(F.coalesce(col(value), F.lit(""))), "[^0-9]", "")


def precheck_ok(value) -> Column:
    def good(text: Column) -> Column:
        year = F.substring(text, 1, 3).try_cast("int")
        return text.rlike(r"^\d{9}$") & F.coalesce(year.between(80, 199), F.lit(False)) & (F.substring(text, 4, 6) != "000000")

    return let(digits(value), good)


def amount(value) -> Column:
    """Whole amount of a number with optional commas; null when it is no number or out of range."""
    number = F.regexp_replace(col(value), ",", "").try_cast("double")
    good = F.round(F.when(number.between(0, 1e12), number)).cast("long")
    return F.when(F.coalesce(col(value), F.lit("")) == "", F.lit(0).cast("long")).otherwise(good)


def loose_amount(value) -> Column:
    return F.coalesce(F.regexp_replace(col(value), r"[^\d]", "").try_cast("long"), F.lit(0).cast("long"))


def tax_address(value) -> Column:
    """Address for jurisdiction lookups: every 台 becomes 臺, no spaces."""
    text = F.translate(F.coalesce(col(value), F.lit("")), "台巿", "臺市")
    return F.regexp_replace(text, SPACE + "+", "")


def _city_names(text: Column) -> Column:
    for old, new in [("台北市", "臺北市"), ("台中市", "臺中市"), ("台南市", "臺南市"), ("台東縣", "臺東縣")]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def document_address(value) -> Column:
    """Address found in a document: no postal code, city names in traditional form, cut at punctuation."""
    text = F.regexp_replace(F.coalesce(col(value), F.lit("")), SPACE + "+", "")
    text = F.regexp_replace(text, r"^\d{3,5}", "")
    text = _city_names(F.replace(text, F.lit("臺灣省"), F.lit("")))
    text = F.regexp_replace(text, r"[，,。；;：:].*$", "")
    return F.trim(F.regexp_replace(text, r"[（(].*$", ""))


def card_address(value) -> Column:
    """Address read from a card: glyphs folded, label and barcode digits removed."""
    text = F.regexp_replace(fold_glyphs(F.coalesce(col(value), F.lit(""))), SPACE + "+", "")
    text = F.regexp_replace(text, "^(?:戶籍)?(?:住址|地址)[:：]?", "")
    text = _city_names(F.regexp_replace(text, r"\d{8,}$", ""))
    return F.trim(F.regexp_replace(text, "[，,。；;].*$", ""))


def postal_key(value) -> Column:
    text = F.regexp_replace(F.coalesce(col(value), F.lit("")), SPACE + "+", "")
    return F.trim(F.regexp_replace(text, r"\d{8,}$", ""))


def app_status(value) -> Column:
    """Case status for an external progress text; the first rule that matches wins."""
    result = F.lit(vocab.OFFICIAL_STATUS_DEFAULT)
    for pattern, status in reversed(vocab.OFFICIAL_STATUS_RULES):
        result = F.when(col(value).rlike(pattern), status).otherwise(result)
    return result


def plausible_name(value, exclusions: list[str]) -> Column:
    text = F.regexp_replace(F.coalesce(col(value), F.lit("")), SPACE + "+", "")
    return let(
        text, lambda t: t.rlike("^[㐀-鿿]{2,4}$") & ~t.isin(exclusions) & ~t.rlike(vocab.NAME_STOP_TERMS)
    )


BARE = "[^A-Za-z0-9一-鿿]"


def comparable(left, right) -> Column:
    """Both non-empty once punctuation is gone, and one contains the other."""
    a = F.regexp_replace(F.coalesce(col(left), F.lit("")), BARE, "")
    b = F.regexp_replace(F.coalesce(col(right), F.lit("")), BARE, "")
    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda p: (p["a"] != "") & (p["b"] != "") & (F.contains(p["a"], p["b"]) | F.contains(p["b"], p["a"])),
    )


def compact_label(value) -> Column:
    return F.regexp_replace(col(value), r"[\s　:：|]", "")


def field_value_ok(field: Column, text: Column) -> Column:
    compact = compact_label(text)
    return F.when(field == "tax_registration_number", compact.rlike(r"\d{7,}")).otherwise(
        (F.length(compact) >= 6) & compact.rlike("縣|市|區|鄉|鎮|路|街|巷|弄|號")
    )


def chinese_number(value: Column) -> Column:
    """Chinese numeral of a number below 100; longer ones digit by digit."""
    glyphs = lambda n: F.translate(n.cast("string"), "0123456789", "〇一二三四五六七八九")
    ones = F.when(value % 10 == 0, "").otherwise(glyphs((value % 10).cast("int")))
    return (
        F.when(value < 10, glyphs(value))
        .when(value < 20, F.concat(F.lit("十"), ones))
        .when(value < 100, F.concat(glyphs(F.floor(value / 10).cast("int")), F.lit("十"), ones))
        .otherwise(glyphs(value))
    )


def chinese_date(year, month, day) -> Column:
    """中華民國…年…月…日; a missing month or day stays an ideographic space."""
    by_digit = F.translate(F.coalesce(col(year).cast("string"), F.lit("")), "0123456789", "〇一二三四五六七八九")
    part = lambda v: F.coalesce(chinese_number(col(v)), F.lit("　"))
    return F.concat(F.lit("中華民國"), by_digit, F.lit("年"), part(month), F.lit("月"), part(day), F.lit("日"))


def progress_url(receipt, unit, entity, agency, sub_case) -> Column:
    receipt, unit, entity, agency, sub_case = map(col, (receipt, unit, entity, agency, sub_case))
    enc = F.url_encode
    business = F.when(agency == "", F.lit(vocab.BUSINESS_LIST_URL)).otherwise(
        F.concat(
            F.lit(vocab.BUSINESS_DETAIL_URL + "?caseNo="), enc(receipt), F.lit("&agency="), enc(agency), F.lit("&receiveNo="),
            enc(receipt), F.lit("&subAcptNo="), enc(first_filled(sub_case, F.lit("01"))),
        )
    )
    company = F.concat(
        F.lit(vocab.COMPANY_DETAIL_URL + "?rcvNo="), enc(receipt), F.lit("&regUnitCode="),
        enc(first_filled(unit, F.lit("17"))), F.lit("&showPreRegNo=0"),
    )
    return F.when(receipt == "", "").when(entity == "行號", business).otherwise(company)


def stored_array(value) -> Column:
    """JSON text as an array of strings; anything else is an empty array."""
    return F.coalesce(F.from_json(col(value), "array<string>"), F.array().cast("array<string>"))


def stored_map(value) -> Column:
    """JSON text as a map; anything else is an empty map."""
    return F.coalesce(F.from_json(col(value), "map<string,string>"), F.create_map().cast("map<string,string>"))


def clean_strings(values, items: int | None = None, length: int | None = None) -> Column:
    """Cleaned texts without blank ones; only the first ``items`` and their first ``length`` characters where such are given."""
    kept = col(values) if items is None else F.slice(col(values), 1, items)
    return F.filter(F.transform(kept, lambda v: clean_text(v, length)), lambda v: v != "")


def strings_cut(values, items: int | None = None, length: int | None = None) -> Column:
    """Whether ``clean_strings`` with these limits drops anything but blanks."""
    more = F.lit(False) if items is None else F.exists(F.filter(col(values), lambda _, i: i >= items), lambda v: clean_text(v) != "")
    kept = col(values) if items is None else F.slice(col(values), 1, items)
    return F.coalesce(more | F.exists(kept, lambda v: text_cut(v, length)), F.lit(False))


def grid_box(box: Column, width, height) -> Column:
    """Box in pixels -> 0..1000 grid, halves to even."""
    scale = lambda i, side: F.bround(box[i] / col(side) * 1000).cast("int")
    return F.array(scale(0, width), scale(1, height), scale(2, width), scale(3, height))


def pixel_box(box: Column, width, height) -> Column:
    scale = lambda i, side: F.bround(box[i] / 1000 * col(side)).cast("int")
    return F.array(scale(0, width), scale(1, height), scale(2, width), scale(3, height))


def page_key(path, size, modified, page) -> Column:
    identity = F.concat_ws("|", col(path), col(size).cast("string"), col(modified).cast("string"), col(page).cast("string"))
    return F.substring(F.sha2(identity, 256), 1, 24)
