"""OCR-token jobs on measured-like boxes, and against brute force over all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import layout

SCHEMA = "page_id string, ord long, text string, score double, x0 double, y0 double, x1 double, y1 double"


def tokens(spark, *sheets):
    rows = [
        (f"p{s}", i, text, 0.9, *map(float, box)) for s, sheet in enumerate(sheets) for i, (text, box) in enumerate(sheet)
    ]
    return layout.with_geometry(spark.createDataFrame(rows, SCHEMA))


def by_page(df, column):
    return [r[column] for r in df.orderBy("page_id").collect()]


def test_birth_date(spark):
    card = [("出生日期", (0, 0, 80, 20)), ("民國080年05月06日", (100, 2, 260, 22))]
    crossed = [
        ("出生", (0, 0, 60, 20)), ("發證日期 民國115年1月9日(北市)换發", (70, 22, 300, 42)), ("年月日", (400, 0, 450, 20)), ("民國82年10月12日", (900, 400, 990, 420)),
    ]
    got = by_page(layout.card_birth_dates(tokens(spark, card, crossed)), "birth_date")
    assert got == ["080/05/06", "082/10/12"]


def test_issue_date(spark):
    marked = [("民國082年10月12日", (0, 0, 100, 20)), ("民國115年1月9日(北市)换發", (0, 30, 200, 50))]
    below = [("發證日期", (0, 0, 80, 20)), ("115/1/9", (10, 25, 100, 45))]
    assert by_page(layout.card_issue_dates(tokens(spark, marked, below)), "issue_date") == ["115/01/09", "115/01/09"]


def test_names(spark):
    split = [("姓名", (0, 0, 40, 20)), ("俞", (120, 1, 140, 21)), ("陳", (80, 1, 100, 21)), ("欣", (160, 1, 180, 21))]
    suffix = [("姓名：王小明", (0, 0, 120, 20))]
    below = [("姓名", (0, 0, 40, 20)), ("林大文", (0, 40, 60, 60))]
    assert by_page(layout.card_names(tokens(spark, split, suffix, below)), "name") == ["陳俞欣", "王小明", "林大文"]


def test_ids(spark):
    spaced = [("A 1234", (0, 0, 1, 1)), ("56789", (2, 0, 3, 1))]
    wrong = [("A123456788", (0, 0, 1, 1))]
    assert by_page(layout.card_ids(tokens(spark, spaced, wrong)), "national_id") == ["A123456789", ""]


def test_addresses(spark):
    two_lines = [("住址", (0, 50, 40, 70)), ("臺北市中正區", (60, 38, 160, 58)), ("測試路一段12號3樓", (60, 62, 200, 82)), ("0181691323", (60, 90, 160, 108))]
    above = [("住址", (0, 52, 40, 72)), ("測試路一段133號", (60, 64, 200, 84)), ("臺中市南屯區範例里9鄰", (60, 36, 220, 56))]
    birthplace = [
        ("出生地", (0, 0, 60, 20)), ("臺北市", (80, 0, 140, 20)), ("住址", (0, 40, 40, 60)), ("新北市汐止區", (80, 31, 180, 51)), ("測試街8號", (80, 53, 160, 73)),
    ]
    merged = [("住址臺中市東區", (0, 40, 120, 60)), ("測試街４０２號民國80年", (130, 41, 260, 61))]
    got = by_page(layout.card_addresses(tokens(spark, two_lines, above, birthplace, merged)), "address")
    assert got == ["臺北市中正區測試路一段12號3樓", "臺中市南屯區範例里9鄰測試路一段133號", "新北市汐止區測試街8號", "臺中市東區測試街402號"]


def test_rows_of_differing_heights_keep_their_order(spark):
    sheet = [
        ("住址", (0, 60, 40, 78)), ("臺中市梧棲區", (60, 44, 140, 60)), ("範例里9鄰", (150, 40, 240, 66)), ("測試路9號二十四樓之9", (60, 70, 240, 90)),
    ]
    assert by_page(layout.card_addresses(tokens(spark, sheet)), "address") == ["臺中市梧棲區範例里9鄰測試路9號二十四樓之9"]


def random_sheet(seed, n=60):
    rnd = random.Random(seed)
    sheet = []
    for i in range(n):
        x, y, h = rnd.randint(0, 900), rnd.randint(0, 900), rnd.choice([10, 14, 20, 45])
        sheet.append((rnd.choice(["label", "value", "other"]), (x, y, x + rnd.randint(10, 120), y + h)))
    return sheet


def test_near_label_equals_all_pairs(spark):
    sheets = [random_sheet(s) for s in range(4)]
    got = {
        (r["page_id"], r["a_ord"], r["ord"]): round(r["distance"], 6) for r in layout.near_label(tokens(spark, *sheets), ["label"]).collect()
    }
    expected = {}
    for s, sheet in enumerate(sheets):
        box = [(t, (x0 + x1) / 2, (y0 + y1) / 2, max(1.0, y1 - y0)) for t, (x0, y0, x1, y1) in sheet]
        for (i, a), (j, t) in itertools.permutations(enumerate(box), 2):
            if a[0] != "label":
                continue
            v = abs(t[2] - a[2])
            if v <= max(a[3], t[3]) * 1.3 and t[1] >= a[1]:
                expected[f"p{s}", i, j] = round(t[1] - a[1] + v * 2, 6)
            elif 0 < t[2] - a[2] <= a[3] * 3.5:
                expected[f"p{s}", i, j] = round(t[2] - a[2] + abs(t[1] - a[1]) * 0.4, 6)
    assert got == expected


def test_property_fields_and_labels(spark):
    sheet = [
        ("房屋坐落：", (50, 100, 150, 120)), ("臺北市信義區", (170, 101, 300, 121)), ("路8號", (310, 101, 360, 121)), ("印", (900, 100, 950, 120)),
        ("稅籍編虎", (50, 600, 150, 620)), ("1234567", (60, 640, 200, 660)),
    ]
    fields = layout.property_fields(tokens(spark, sheet).select(*SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")))
    got = {r["field"]: r for r in fields.collect()}
    assert got["property_address"]["value"] == "臺北市信義區路8號" and got["property_address"]["label_match_score"] == 1.0
    assert got["tax_registration_number"]["value"] == "1234567"
    assert got["tax_registration_number"]["label_match_score"] == pytest.approx(0.75)
    pages = spark.createDataFrame([("p0", 1000, 500, "p0.jpg"), ("p1", 10, 10, "p1.jpg")], "page_id string, width int, height int, image_file string")
    records = {r["page_id"]: r for r in layout.label_records(fields, pages).collect()}
    assert records["p0"]["shape_count"] == 2 and '"points":[[170,50],[360,60]]' in records["p0"]["record"]
    assert records["p1"]["shape_count"] == 0 and '"shapes":[]' in records["p1"]["record"]


def test_region_rule(spark):
    table = tokens(spark, [("top", (0, 100, 10, 120)), ("bottom", (0, 900, 10, 920))])
    pages = spark.createDataFrame([("p0", "house_tax")], "page_id string, category string")
    assert [r["text"] for r in layout.keep_region(table, pages).collect()] == ["top"]


def test_large_pages_are_searched_as_small_ones_are_scanned(spark, monkeypatch):
    from caseflow.operators import sheets

    words = ["姓名", "王小明", "出生", "民國80年5月6日", "發證日期", "115/1/9", "住址", "臺北市中正區", "測試路一段12號", "x"]
    pages = [[(random.Random(s * 100 + i).choice(words), box) for i, (_, box) in enumerate(random_sheet(s, 120))] for s in range(6)]
    table = tokens(spark, *pages)
    rules = (layout.card_names, layout.card_birth_dates, layout.card_issue_dates, layout.card_addresses)
    searched = [sorted(map(tuple, rule(table).collect())) for rule in rules]
    monkeypatch.setattr(sheets, "FEW", 1000)
    assert searched == [sorted(map(tuple, rule(table).collect())) for rule in rules]
    assert all(any(value for _, value in found) for found in searched)


def test_plan_of_the_card_rules_has_one_exchange_of_tokens(spark):
    table = tokens(spark, random_sheet(1)).select(*SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", "))
    cards = spark.createDataFrame([("p0", "auto", "")], "page_id string, requested_side string, barcode_id string").hint("merge")
    plan = layout.card_records(table, cards)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the tokens and the cards
    plan = layout.property_fields(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_address_limit_is_the_callers(spark):
    long = [("住址", (0, 50, 40, 70)), ("臺北市中正區" + "測試路一段" * 30 + "12號", (60, 50, 900, 70))]
    full, cut = (by_page(layout.card_addresses(tokens(spark, long), most=most), "address")[0] for most in (None, 80))
    assert len(full) == 159 and cut == full[:80]


def test_nearest_value_is_found_without_reading_the_texts_after_it(spark):
    """The nearest non-blank text counts, of equal distances the earlier label and token; costly rules don't run on those after it."""
    from caseflow.operators.sheets import nearest

    value = lambda t: F.when(t == "far", F.raise_error(F.lit("a text beyond the nearest was read"))).when(t == "blank", "").otherwise(F.upper(t))
    pairs = "array<struct<distance:double,a_ord:bigint,ord:bigint,text:string>>"
    rows = [
        (1, [(9.0, 1, 5, "far"), (1.0, 2, 3, "blank"), (1.5, 2, 2, "b"), (1.5, 1, 7, "a"), (0.5, 1, 1, None)]),
        (2, [(2.0, 1, 1, "blank")]), (3, []), (4, None),
    ]
    found = spark.createDataFrame(rows, f"id int, pairs {pairs}").select("id", nearest(F.col("pairs"), value).alias("v"))
    assert dict(found.collect()) == {1: "A", 2: None, 3: None, 4: None}
