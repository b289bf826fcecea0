"""Column jobs on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from caseflow.functions import columns as c
from caseflow.functions import vocab
from caseflow.functions.udfs import nfkc, similarity
from caseflow.operators import forms, layout, pages
from caseflow.operators.dims import bureau_of, format_entry, split_entry


def values(spark, column, *rows):
    """Results of column(F.col('v')) on each row, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_roc_date(spark):
    got = values(
        spark, c.roc_date, "民國 115 年 8 月 6 日", "2026-08-06", "１１５．０２．２９", "2024/02/29", "1150203", "20260803", "", None, "115/13/01",
        "中華民國１１５年１月２日", "0/1/1",
    )
    assert got == ["115/08/06", "115/08/06", "", "113/02/29", "115/02/03", "115/08/03", "", "", "", "115/01/02", ""]


def test_loose_dates(spark):
    assert values(spark, layout.card_date, "民國115-7-8", "1O1年2月3日", "99/13/01", "201/1/1", "x") == [
        "115/07/08", "101/02/03", "", "", "",
    ]
    assert values(spark, c.roc_to_iso, "115/1/2 後", "99年3月4日", "0990304", "113/02/30", "abc") == [
        "2026-01-02", "2010-03-04", "2010-03-04", "2024-02-30", "",
    ]
    assert values(spark, c.roc_rank, "115年1月2", "115/1/2", "0990304") == [20260102, 20260102, 0]


def test_precheck_number(spark):
    assert values(spark, c.digits, "１１５-９９９ ９９９") == ["115999999"]
    assert values(spark, c.precheck_ok, "115 999 999", "079999999", "115000000", "11599999", "200000001") == [
        True, False, False, False, False,
    ]


def test_national_id(spark):
    assert values(
        spark, c.national_id_ok, "A123456789", "A123456788", "A323456789", "Z123456789", "A 1 2 8 0 8 2 7 3 4", "", None
    ) == [True, False, False, False, True, False, False]
    assert values(spark, c.first_valid_id, "x A123456788 y a-123.456 789 z", "none") == ["A123456789", ""]


def test_amounts(spark):
    assert values(spark, c.amount, "1,234.5", "", "-1", "1000000000001", "1000000000000", "x") == [1235, 0, None, None, 10**12, None]
    assert values(spark, c.loose_amount, "NT$ 1,200 元", "", None) == [1200, 0, 0]


def test_addresses(spark):
    assert values(spark, c.tax_address, " 台中巿 台灣大道　一段") == ["臺中市臺灣大道一段"]
    assert values(spark, c.document_address, "406 臺灣省台中市西屯區台灣大道三段99號12樓，備註", "台北市中山路1號（舊）") == [
        "臺中市西屯區台灣大道三段99號12樓", "臺北市中山路1號",
    ]
    assert values(spark, c.card_address, "戶籍地址：南投縣竹山镇延祥里17鄰集山路三段301巷81弄62號0181691323") == [
        "南投縣竹山鎮延祥里17鄰集山路三段301巷81弄62號",
    ]
    assert values(spark, c.postal_key, "南投縣竹山鎮 62號0181691323") == ["南投縣竹山鎮62號"]


def test_bureaus(spark):
    got = values(
        spark, lambda v: bureau_of(v)["bureau_code"], "臺北市信義區福德街86號", "新北市板橋區文化路一段1號", "台中市北屯區崇德路二段1號",
        "臺南市安南區安中路一段1號", "高雄市三民區建國一路1號", "東京",
    )
    assert got == ["A05", "H01", "B01", "D01", "E01", None]


def test_entries(spark):
    assert [tuple(x) for x in values(spark, split_entry, "e801010 室內裝潢業", "E801010", "室內裝潢業", None)] == [
        ("E801010", "室內裝潢業"), ("E801010", ""), ("", "室內裝潢業"), ("", ""),
    ]
    assert values(spark, lambda v: format_entry(F.lit("E801010 "), v), " 室內裝潢業", "", None) == ["E801010 室內裝潢業", "E801010", "E801010"]


def test_status_and_names(spark):
    assert values(spark, c.app_status, "核准發文中", "已核准", "補正通知", "收件") == ["核准發文中", "核准", "補件", "已送件"]
    plausible = lambda v: c.plausible_name(v, vocab.NAME_EXCLUSIONS_TEXT)
    assert values(spark, plausible, "王 小明", "姓名", "張", "地址陳", None) == [True, False, False, False, False]


def test_comparable(spark):
    same = lambda v: c.comparable(v, F.lit("臺北市（信義）8號"))
    assert values(spark, same, "臺北市信義", "臺北市信義8號樓", "高雄", "。", None) == [True, True, False, False, False]


def test_page_range_parser(spark):
    got = values(spark, lambda v: pages.parse_page_range(v, F.lit(5)), "1-2,5,2", "0,2", "2-9", "x", " ", None)
    assert [(r["pages"], r["error"]) for r in got] == [
        ([1, 2, 5], None), (None, "range"), (None, "range"), (None, "format"), (None, "blank"), (None, "blank"),
    ]


def test_date_warnings(spark):
    as_of = datetime.date(2026, 8, 1)
    df = spark.createDataFrame(
        [("082/10/12", "115/01/09"), ("115/01/09", "082/10/12"), ("110/01/01", "115/01/09"), ("", "115/01/09"), ("082/10/12", "120/01/01")],
        "b string, i string",
    )
    got = [r[0] for r in df.select(forms.date_warnings("b", "i", as_of)).collect()]
    assert got[0] == [] and got[3] == []
    assert got[1] == ["出生年月日與發證日期疑似對調，請人工確認"]
    assert got[2] == ["發證時未滿 14 歲，出生年月日或發證日期可能誤讀"]
    assert got[4] == ["發證日期晚於今日"]


def test_json_and_text_cleaning(spark):
    assert values(spark, c.stored_array, '["a","b"]', "{bad", '{"a":1}', None) == [["a", "b"], [], [], []]
    assert values(spark, c.stored_map, '{"a":1}', "[1]", "", None) == [{"a": "1"}, {}, {}, {}]
    assert values(spark, lambda v: c.clean_text(v, 3), "  abcdef ", None) == ["abc", ""]
    assert values(spark, c.clean_text, "  " + "x" * 900, None) == ["x" * 900, ""]
    assert values(spark, lambda v: c.text_cut(v, 3), "  abcd ", " abc ", None) == [True, False, False]


def test_chinese_dates(spark):
    df = spark.createDataFrame([("115", 10, 21), ("99", None, 5), ("", 12, 30)], "y string, m int, d int")
    assert [r[0] for r in df.select(c.chinese_date("y", "m", "d")).collect()] == [
        "中華民國一一五年十月二十一日", "中華民國九九年　月五日", "中華民國年十二月三十日",
    ]


def test_boxes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 400.0, 280.5],)], "b array<double>")
    assert df.select(c.grid_box(F.col("b"), F.lit(800), F.lit(561))).first()[0] == [1, 4, 500, 500]
    assert df.select(c.pixel_box(F.col("b"), F.lit(800), F.lit(500))).first()[0] == [1, 1, 320, 140]


def test_python_functions(spark):
    assert values(spark, nfkc, "ＡＢ①", None) == ["AB1", None]
    df = spark.createDataFrame([("稅籍編虎", "稅籍編號")], "a string, b string")
    assert df.select(similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.75)


def test_progress_url(spark):
    df = spark.createDataFrame(
        [("", "17", "公司", "", ""), ("1 2", "", "公司", "", ""), ("9", "", "行號", "", ""), ("9", "", "行號", "A1", "")],
        "r string, u string, e string, a string, s string",
    )
    got = [r[0] for r in df.select(c.progress_url("r", "u", "e", "a", "s")).collect()]
    assert got[0] == "" and got[1].endswith("?rcvNo=1+2&regUnitCode=17&showPreRegNo=0")
    assert got[2] == vocab.BUSINESS_LIST_URL and got[3].endswith("?caseNo=9&agency=A1&receiveNo=9&subAcptNo=01")


def test_string_lists_are_cut_only_where_the_caller_says(spark):
    rows = spark.createDataFrame([(["a" * 400, " ", "b"] * 100,), (None,)], "v array<string>")
    whole = rows.select(c.clean_strings("v").alias("w"), c.clean_strings("v", 200, 300).alias("k"), c.strings_cut("v", 200, 300).alias("cut"), c.strings_cut("v").alias("not")).collect()
    assert len(whole[0]["w"]) == 200 and len(whole[0]["w"][0]) == 400 and len(whole[0]["k"]) == 133 and len(whole[0]["k"][0]) == 300
    assert whole[0]["cut"] and not whole[0]["not"] and not whole[1]["cut"]
    short = spark.createDataFrame([(["a", " ", "b", "", " "],)], "v array<string>")
    assert not short.select(c.strings_cut("v", 3, 5)).first()[0] and short.select(c.strings_cut("v", 2, 5)).first()[0]


def test_match_places_and_windows_equal_a_walk_through_the_text(spark):
    import random
    import re

    chance = random.Random(6)
    texts = ["", None, "ab12", "12ab", "no digits", "1 22 333", "😀12é345" * 3] + ["".join(chance.choices("a1 é😀", k=chance.randint(0, 9000))) for _ in range(12)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    text = F.col("t")
    window = lambda m: c.block_window(c.text_blocks(text), m["start"] - 28, m["stop"] + 28)
    found = rows.select("k", F.transform(c.match_places(text, "[0-9]+"), lambda m: F.struct(m.alias("m"), window(m).alias("w"))).alias("v")).collect()
    for row in found:
        t = texts[row["k"]]
        expected = [(m.group(), m.start(), m.end(), t[max(0, m.start() - 28) : m.end() + 28]) for m in re.finditer("[0-9]+", t or "")]
        assert [(*x["m"], x["w"]) for x in row["v"] or []] == expected


def test_a_long_page_with_many_matches_is_cut_in_linear_time(spark):
    import time

    from caseflow.operators import pages

    def seconds(n):
        body = "臺北市中正區測試路一段12號3樓 聯絡地址 " * n
        table = spark.createDataFrame([("f", 1, body)], "file_id string, page int, text string")
        started = time.time()
        rows = pages.address_candidates(table).count()
        return time.time() - started, rows, len(body)

    seconds(10)
    (short, few, _), (long, many, size) = seconds(5_000), seconds(45_000)
    assert few >= 5_000 and many >= 45_000 and size > 900_000 and long < 30 * short + 20
