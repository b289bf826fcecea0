"""Page-text jobs on Taiwanese texts."""

from pyspark.sql import functions as F

from caseflow.operators import html, pages


def page_table(spark, rows):
    return spark.createDataFrame(rows, "file_id string, page long, text string")


def test_premises_address_ranks_first(spark):
    table = page_table(
        spark,
        [
            ("a.pdf", 1, "出租人王小明 通訊地址：臺北市中山區中正路100號 姓名 王小明"),
            ("a.pdf", 2, "租賃標的：房屋所在地 406臺中市西屯區台灣大道三段99號12樓 之房屋"),
            ("a.pdf", 3, "無地址"),
        ],
    )
    best = pages.best_candidates(pages.address_candidates(table)).orderBy(*pages.candidate_rank_order()).collect()
    assert best[0]["address"] == "臺中市西屯區台灣大道三段99號12樓" and best[0]["page"] == 2 and best[0]["confidence"] == "高"
    assert best[1]["score"] < best[0]["score"]


def test_document_types_merge_pages(spark):
    table = page_table(
        spark,
        [("x", 1, "租賃契約 出租人 甲"), ("x", 2, "承租人"), ("x", 3, "平面圖"), ("x", 5, "租賃標的")]
        + [("y", p, "租賃契約 出租人") for p in range(1, 9)]
        + [("y", 9, "文件簽收確認單 租賃契約 平面圖 房屋稅 地號"), ("y", 10, "平面圖 比例尺"), ("y", 11, "土地所有權狀 地號"), ("y", 12, "使用同意書"), ("y", 13, "房屋稅繳款書")],
    )
    found = {(r["file_id"], r["key"]): r for r in pages.document_types(table).collect()}
    lease = found["x", "lease"]
    assert (lease["page_range"], lease["confidence"], lease["score"]) == ("1-2,5", "高", 70)
    assert lease["evidence"] == "租賃契約、出租人、承租人、租賃標的"
    assert {k: v["page_range"] for (f, k), v in found.items() if f == "y"} == {
        "lease": "1-9", "floor_plan": "10", "land_title": "11", "building_consent": "12", "house_tax": "13",
    }


def test_precheck_certificate(spark):
    text = (
        "公司名稱及所營事業登記預查核定書\n預 查 編 號： １１５ - ０００ １２３\n核准日期：民國 115 年 2 月 3 日\n保留期限\n1150803\n"
        "公司名稱： 測試科技股份有限公司\nE599010 配管工程業 F113020\n電器批發業\nZZ99999 除許可業務外，得經營法令非禁止或限制之業務\nE599010 重複業"
    )
    files = spark.createDataFrame(
        [("good", text), ("none", "115000123 1150203 測試有限公司"), ("inline", "編號說明 預查編號\n\n\n其他\n文字 發文日期 1150203 保留至 1150803")],
        "file_id string, text string",
    )
    got = {r["file_id"]: r for r in pages.precheck_records(files).collect()}
    good = got["good"]
    assert (good["precheck_number"], good["approval_date"], good["expiry_date"], good["company_name"]) == (
        "115000123", "115/02/03", "115/08/03", "測試科技股份有限公司",
    )
    assert [(i["code"], i["name"]) for i in good["business_items"]] == [
        ("E599010", "配管工程業"), ("F113020", "電器批發業"), ("ZZ99999", "除許可業務外，得經營法令非禁止或限制之業務"),
    ]
    none = got["none"]
    assert [none[c] for c in ("precheck_number", "approval_date", "expiry_date", "company_name")] == ["", "", "", ""]
    assert none["business_items"] == []
    assert (got["inline"]["approval_date"], got["inline"]["expiry_date"]) == ("115/02/03", "115/08/03")


def test_identity_text(spark):
    files = spark.createDataFrame(
        [("a", "姓名：王小明 身分證統一編號 A 1 2 3 4 5 6 7 8 9"), ("b", "姓名\n陳大文\nA123456788"), ("c", "地址 姓名路1號\n無")],
        "file_id string, text string",
    )
    got = {r["file_id"]: (r["name"], r["national_id"]) for r in pages.identity_records(files).collect()}
    assert got == {"a": ("王小明", "A123456789"), "b": ("陳大文", ""), "c": ("", "")}


def test_provided_pages(spark):
    files = spark.createDataFrame([("a", 2), ("b", 1)], "file_id string, n int")
    got = pages.provided_pages(files, lambda row: [(i + 1, f"{row.file_id}{i}") for i in range(row.n)]).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "a0"), ("a", 2, "a1"), ("b", 1, "b0")]


def test_export_plan(spark):
    detections = spark.createDataFrame(
        [("a", "lease", "租約", "1-2", "高"), ("a", "floor_plan", "平面圖", "3", "低"), ("b", "lease", "租約", "1", "低"), ("c", "lease", "租約", "1", "高")],
        "file_id string, key string, label string, page_range string, confidence string",
    )
    decisions = spark.createDataFrame(
        [("a", "floor_plan", "3", "dismissed"), ("b", "lease", "1", "confirmed")], "file_id string, key string, page_range string, decision string"
    )
    files = spark.createDataFrame([("a", "pdf", 3), ("b", "pdf", 1), ("c", "png", 1)], "file_id string, suffix string, page_count int")
    got = sorted(tuple(r) for r in pages.export_plan(detections, decisions, files).collect())
    assert got == [("a", "租約.pdf", "1-2"), ("b", "租約.pdf", "1"), ("c", "c.png", "")]


def test_html_text_and_entities(spark):
    df = spark.createDataFrame(
        [("<p>A&#65;&#x4e2d; &amp;lt;</p><script>x<p></script><br/>b&nbsp;&#128512;</p><style>p{}</style>",), (None,)], "h string"
    )
    got = [r[0] for r in df.select(html.plain_text("h")).collect()]
    assert got == ["AA中 <\n\nb \U0001F600", ""]


def test_tag_attributes(spark):
    df = spark.createDataFrame([(""" HREF="/a?x=1&amp;y" href='/b' data-x=3 hidden """,)], "t string")
    assert df.select(html.tag_attributes(F.col("t"))).first()[0] == {"href": "/b", "data-x": "3", "hidden": ""}


def test_links_by_path_call_and_row(spark):
    table = spark.createDataFrame(
        [
            (1, "https://s.example/a/list.do?q=1", '<p>12345678 甲公司</p><a href="detail/QueryX.do">no</a><a href="../detail/QueryCase.do?x=1">go</a>', "公司", "12345678", "甲公司"),
            (2, "https://s.example/a/b.do", """<button onclick="go('123456789','17')">go</button>""", "公司", "", ""),
            (3, "https://s.example/a/b.do", """<button onclick="go('123456789','12345678A2','376590000A','02')">go</button>""", "行號", "", ""),
            (4, "https://s.example/a/b.do", """<table><tr><td>其他</td><td>'987654321'</td></tr><tr><td>甲公司</td><td onclick=f('123456789')>x</td></tr></table>""", "公司", "5550", "甲公司"),
            (5, "https://s.example/", "<p>none</p>", "公司", "1", "x"),
        ],
        "page_id int, url string, html string, entity_type string, tax_id string, company_name string",
    )
    got = {r["page_id"]: (r["link"], r["score"]) for r in html.link_candidates(table).collect()}
    assert got[1] == ("https://s.example/detail/QueryCase.do?x=1", 21)
    assert got[2][0].endswith("?rcvNo=123456789&regUnitCode=17&showPreRegNo=0") and got[2][1] == 1
    assert got[3][0].endswith("?caseNo=123456789&agency=376590000A&receiveNo=123456789&subAcptNo=02")
    assert got[4][1] == 5 and "rcvNo=123456789&" in got[4][0]
    assert 5 not in got


def test_resolve_url_folds_every_segment(spark):
    from caseflow.operators.html import resolve_url

    base = "https://a.b/c/d/e.do?x=1"
    cases = {
        "../../x/q.do": "https://a.b/x/q.do", "../x/q.do?u=a/../b": "https://a.b/c/x/q.do?u=a/../b", "./q.do": "https://a.b/c/d/q.do",
        "../../../q.do": "https://a.b/q.do", "/m/./n/../q.do#p": "https://a.b/m/q.do#p", "q.do": "https://a.b/c/d/q.do",
        "HTTPS://z.y/p": "HTTPS://z.y/p", "..": "https://a.b/c/",
    }
    df = spark.createDataFrame([(k,) for k in cases], "link string")
    rows = df.select("link", resolve_url(F.col("link"), F.lit(base)).alias("url")).collect()
    assert {r["link"]: r["url"] for r in rows} == cases


def test_numeric_entities_are_read_once(spark):
    from caseflow.operators.html import decode_entities

    df = spark.createDataFrame([("&#38;#60; &#60; &#0; &#x110000;",)], "t string")
    assert df.select(decode_entities("t").alias("t")).first()["t"] == "&#60; < &#0; &#x110000;"


def test_business_items_keep_the_first_of_each_code(spark):
    text = "\n".join(f"{code} 裝潢{chr(0x4e00 + k)}業" for k, code in enumerate(["E801010", "F113020", "E801010", "ZZ99999", "F113020"]))
    df = spark.createDataFrame([("a", text)], "file_id string, text string")
    items = pages.precheck_records(df).first()["business_items"]
    assert [i["code"] for i in items] == ["E801010", "F113020", "ZZ99999"]
