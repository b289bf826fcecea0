"""Plans that must hold on tables far larger than these: no side that grows with the input goes through the driver, one exchange per sheet."""

import datetime

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries  # noqa: F401
from caseflow.functions import columns
from caseflow.operators import dims, layout
from caseflow.plans.registry import QUERIES

TOKENS = "page_id string, ord long, text string, score double, x0 double, y0 double, x1 double, y1 double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def page(spark):
    rows = [("p", 0, "課稅房屋坐落：", 0.9, 0.0, 100.0, 200.0, 120.0), ("p", 1, "臺北市信義區8號", 0.9, 220.0, 101.0, 400.0, 121.0), (None, 0, "頁", 0.9, 0.0, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, TOKENS)


def test_region_and_agreement_broadcast_nothing(spark, page):
    pages = spark.createDataFrame([("p", "house_tax"), ("q", "house_tax")], "page_id string, category string")
    region = layout.keep_region(page, pages)
    fields = lambda tokens: layout.property_fields(tokens).select("page_id", "field", "value")
    compared = layout.compare_fields(fields(page), fields(region))
    assert "Broadcast" not in plan(region) and "Broadcast" not in plan(compared)
    assert [(r.page_id, r.field, r.matched) for r in compared.collect()] == [("p", "property_address", True)]


def test_catalogue_search_broadcasts_nothing_and_meets_codes_by_long_pieces(spark):
    catalogue = spark.range(300).select(
        F.format_string("E%06d", "id").alias("code"), F.lit("LARGERING").alias("name"), F.lit("C").alias("category"), F.lit("large").alias("category_name")
    )
    held = {r._gram: r["count"] for r in dims.gram_index(catalogue).groupBy("_gram").count().collect()}
    assert held["E000017"[1:]] == 1 and held["0017"] == 11 and held["E00"] == 300
    found = dims.search_catalogue(catalogue, catalogue.select(F.explode(F.array("code", F.substring("code", 3, 4))).alias("query")), 20)
    assert "Broadcast" not in plan(found)
    rows = {(r.query, r.code, r.place) for r in found.collect()}
    assert len([r for r in rows if r[0] == "E000017"]) == 1 and ("0001", "E000010", 2) in rows and ("0001", "E000001", 1) in rows


def test_branches_keep_a_name_once_and_broadcast_nothing(spark):
    listed = spark.range(400).select(
        F.lit("A").alias("bureau_code"), F.lit("市").alias("county"), F.concat(F.lit("所"), (F.col("id") % 4).cast("string")).alias("office_name"),
        F.when(F.col("id") != 7, F.col("id")).alias("ordinal"), F.when(F.col("id") % 4 == 3, "中山區").otherwise("東區").alias("district"),
        F.lit("east").alias("boundary"),
    )
    asked = [(1, "A", "市", "東區1號"), (2, "A", "市", "中山區松江路以西"), (3, "A", "市", "東區中山區"), (4, None, "市", "東區")]
    found = dims.resolve_branch(spark.createDataFrame(asked, "id long, bureau_code string, county string, address string"), F.col("address"), listed)
    assert "Broadcast" not in plan(found)
    # Several rows of one name are several hits at the boundary, and a missing ordinal comes first.
    assert {r.id: r.branch_candidates for r in found.collect()} == {1: ["所0", "所1", "所2"], 2: [], 3: ["所3", "所0", "所1", "所2"], 4: []}


def test_side_and_id_of_a_card_share_one_exchange_of_texts(spark, page):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = layout.with_geometry(page)
        shown = plan(layout.side_scores(placed).join(layout.card_ids(placed), "page_id"))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert shown.count("ReusedExchange") == 1 and shown.count("+- Exchange hashpartitioning") == 1 and "x0" not in shown.split("Scan")[0]


def test_card_records_of_a_file_are_read_once(spark):
    k = F.col("id")
    cards = spark.range(4).select(
        F.when(k < 3, F.floor(k / 2)).alias("file_id"), k.alias("place"), F.concat(F.lit("王小"), k.cast("string")).alias("name"),
        F.lit("A123456789").alias("national_id"), F.lit("ocr").alias("national_id_source"), F.lit(False).alias("national_id_mismatch"),
        *[F.lit("").alias(c) for c in ("birth_date", "issue_date", "address")], F.lit(0.5).alias("confidence"),
    )
    found = layout.file_cards(cards, datetime.date(2001, 12, 31))
    assert plan(found).count("Range (") == 1
    assert {(r.file_id, r.card_count, r.name, r.national_id_source, r.status) for r in found.collect()} == {(0, 2, "王小0", "ocr", "success"), (1, 1, "王小2", "ocr", "success")}


def test_fields_of_a_sheet_are_read_once(page):
    asked = [line for line in plan(layout.property_fields(page)).splitlines() if line.lstrip(" :+-*()0123456789").startswith("Filter")]
    assert not [line for line in asked if "toks" in line]


def test_wide_inputs_are_dealt_over_tasks_and_lists_read_once(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).select(F.col("id").alias("o_orderkey"), F.lit("1998-01-05").cast("timestamp").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("h12_shareholders", "j6_card_records", "j9_pseudo_labels"):
        shown = plan(QUERIES[name](spark, str(tmp_path)))
        assert "REPARTITION_BY_NUM" in shown, name
    lists = plan(QUERIES["h12_shareholders"](spark, str(tmp_path)))
    assert not [line for line in lists.splitlines() if "Filter" in line.split("(")[0] and "from_json" in line]
    assert QUERIES["h12_shareholders"](spark, str(tmp_path)).count() == sum(k + 1 for k in range(5))


DATES = [
    "115/1/2 後", "99年3月4日", "0990304", "990304", "113/02/30", "abc", None, "  115/01/02", " 　115/1/2", "115/1/2\nx", "0990304\n", "0990304x",
    "99年3月4", "115-1.22", "99-1-2", "99.1.2", "1151/2/3", "115/123/4", "9年1月2日", "\t115/1/2", "115/1/2 0990304-012", "", "000101", "00/00/00",
]
ISO = [
    "2026-01-02", "2010-03-04", "2010-03-04", "2010-03-04", "2024-02-30", "", "", "2026-01-02", "", "2026-01-02", "2010-03-04", "", "", "2026-01-22",
    "2010-01-02", "2010-01-02", "", "", "", "", "2026-01-02", "", "1911-01-01", "1911-00-00",
]
RANKS = [
    20260102, 20100304, 0, 0, 20240230, 0, 0, 20260102, 20260102, 20260102, 0, 0, 20100304, 20260122, 20100102, 20100102, 0, 0, 0, 20260102, 20260102, 0, 0,
    19110000,
]


def test_a_candidate_s_date_is_searched_a_few_times_only(spark):
    rows = spark.createDataFrame(list(enumerate(DATES)), "n int, d string")
    iso = columns.roc_to_iso("d")
    found = rows.withColumn("iso", columns.once(iso)).select("n", "iso", columns.roc_rank("d").alias("rank"))
    assert sorted(map(tuple, found.collect())) == list(zip(range(len(DATES)), ISO, RANKS))
    shown = plan(rows.select(iso.alias("iso")))
    assert shown.count("RLIKE") == 1 and shown.count("regexp_extract") == 1 and "lambda" not in shown and "format_string" not in shown
