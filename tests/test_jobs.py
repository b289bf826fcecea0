"""Ledger, merge, reference-data and dataset jobs on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from caseflow.operators import dataset, dims, forms, ledger, merge, reconcile
from caseflow.plans.inputs import Inputs
from caseflow.sources import tables

D = datetime.date


def test_receivable_rules(spark):
    cases = spark.createDataFrame(
        [(1, 1000, 500, 0, "未請款"), (2, 1000, 500, 100, "已請款"), (3, 0, 0, 600, "已請款"), (4, 0, 0, 0, "已請款"), (5, 0, 0, 0, "已收款")],
        "id long, service_fee long, government_fee long, paid_amount long, billing_status string",
    )
    items = spark.createDataFrame([(2, 300), (2, 200), (3, 300), (3, 200), (5, 500)], "case_id long, amount long")
    got = {r["id"]: (r["total_due"], r["outstanding"], r["payment_status"]) for r in ledger.with_receivables(cases, items).collect()}
    assert got == {1: (1500, 1500, "未請款"), 2: (500, 400, "部分收款"), 3: (500, 0, "已收款"), 4: (0, 0, "待收款"), 5: (500, 500, "已收款")}


def test_reminder_else_if(spark):
    """A due follow-up hides the stale reminder, and a case under correction never goes stale."""
    as_of = D(2026, 8, 31)
    rows = [
        (1, "審查中", D(2026, 8, 1), D(2026, 8, 30), None), (2, "審查中", D(2026, 8, 1), None, None), (3, "補件", D(2026, 1, 1), None, None),
        (4, "準備中", D(2026, 8, 26), None, None), (5, "審查中", D(2026, 8, 26), None, None), (6, "審查中", D(2026, 1, 1), None, D(2026, 8, 30)),
    ]
    enriched = spark.createDataFrame(
        rows, "id long, status string, received_date date, next_follow_up_date date, last_progress_date date"
    ).selectExpr(
        "*", "'c' AS company_name", "'' AS tax_id", "'' AS entity_type", "'' AS case_type", "'' AS case_content", "'' AS status_detail",
        "'不需要' AS tax_office_required", "'未請款' AS billing_status", "0L AS outstanding", "CAST(NULL AS DATE) AS billing_date", "CAST(NULL AS DATE) AS last_event_date",
    )
    got = {(r["case_id"], r["kind"], r["priority"]) for r in ledger.reminders(enriched, as_of).collect()}
    assert got == {(1, "follow-up", 1), (2, "stale", 1), (3, "supplement", 1), (4, "stale", 2)}


def test_case_numbers_continue_and_grow(spark):
    cases = spark.createDataFrame([("2026-998",), ("2025-007",), ("x",)], "case_number string")
    intake = spark.createDataFrame([(i, D(2026, 1, 1)) for i in range(3)] + [(9, D(2027, 1, 1))], "input_pos long, received_date date")
    for rows in (1, 2, 100):
        got = {r["input_pos"]: r["case_number"] for r in ledger.assign_case_numbers(intake, cases, slice_rows=rows).collect()}
        assert got == {0: "2026-999", 1: "2026-1000", 2: "2026-1001", 9: "2027-001"}


def test_official_updates_protect_and_conflict(spark):
    cases = spark.createDataFrame(
        [
            (1, "n1", "公司", "11111111", "結案", "done", "", "", "", None, "", D(2026, 1, 1)), (2, "n2", "公司", "11111111", "準備中", "", "R9", "", "", None, "", D(2026, 1, 1)),
            (3, "n3", "公司", "22222222", "準備中", "", "", "", "", None, "", D(2026, 1, 2)),
        ],
        "id long, case_number string, entity_type string, tax_id string, status string, status_detail string, official_receipt_no string, "
        "official_status string, reg_unit_code string, submitted_date date, authority string, received_date date",
    )
    candidates = spark.createDataFrame(
        [(1, "R9", "115/01/01", "核准發文中", "A", 1, 1), (1, "R8", "115/01/01", "核准", "A", 1, 1), (3, "R1", "115/01/02", "核准發文中", "A", 1, 1), (3, "R2", "115/01/03", "審查中", "A", 1, 1),
         (2, "R9", "115/05/05", "審查中", "A", 1, 1)],
        "case_id long, receipt_no string, received_date string, official_status string, authority string, part long, supp long",
    )
    chosen = reconcile.choose_candidates(candidates, cases, ["part", "supp"])
    how = {r["case_id"]: (r["how"], r["receipt_no"]) for r in chosen.collect()}
    assert how == {1: ("date", "R8"), 2: ("receipt", "R9"), 3: ("date", "R1")}
    updates = {r["id"]: r for r in reconcile.official_updates(cases, chosen, D(2026, 9, 1)).collect()}
    assert updates[1]["status"] == "結案" and updates[1]["status_detail"] == "done" and updates[1]["changed"]
    assert updates[3]["status"] == "核准發文中" and updates[3]["status_detail"] == "官方網站：核准發文中（尚未可領件）"
    assert updates[3]["change_text"] == "帶入收文號 R1；官方進度：核准發文中；系統進度更新為 核准發文中"
    assert updates[3]["submitted_date"] == "2026-01-02" and not updates[2]["conflict"]
    forced = chosen.withColumn("receipt_no", F.when(F.col("case_id") == 1, "R9").otherwise(F.col("receipt_no")))
    conflicted = {r["id"]: r["conflict"] for r in reconcile.official_updates(cases, forced, D(2026, 9, 1)).collect()}
    assert conflicted == {1: True, 2: False, 3: False}


def test_upsert_takes_the_last_update(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, v string, w string")
    updates = spark.createDataFrame([(2, "c", None, 1), (2, "d", None, 2), (3, "e", "y", 1)], "id long, v string, w string, seq int")
    got = sorted(tuple(r) for r in merge.upsert(target, updates, ["id"], ["seq"]).collect())
    assert got == [(1, "a", None), (2, "d", None), (3, "e", "y")]


def test_exclusive_default(spark):
    offices = spark.createDataFrame([(1, True), (2, False), (3, False)], "id long, is_default boolean")
    run = lambda rows: {
        r["id"]: r["is_default"]
        for r in merge.exclusive_default(offices, spark.createDataFrame(rows, "id long, is_default boolean, seq int")).collect()
    }
    assert run([(2, True, 1), (3, True, 2)]) == {1: False, 2: False, 3: True}
    assert run([(2, True, 1), (2, False, 2)]) == {1: False, 2: False, 3: False}
    assert run([(1, False, 1)]) == {1: False, 2: False, 3: False}
    assert run([(3, False, 1)]) == {1: True, 2: False, 3: False}


def test_children_deletes_and_events(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, item string")
    fresh = spark.createDataFrame([(2, "c"), (3, "d")], "case_id long, item string")
    assert sorted(map(tuple, merge.replace_children(items, fresh, "case_id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    history = spark.createDataFrame([(1, 10, D(2026, 1, 2)), (2, 10, D(2026, 1, 1)), (3, 11, D(2026, 1, 1))], "id long, case_id long, event_date date")
    asked = spark.createDataFrame([(10, 1), (11, 1)], "case_id long, id long")
    kept, missed = merge.delete_events(history, asked)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3] and [tuple(r) for r in missed.collect()] == [(11, 1)]
    starts = spark.createDataFrame([(10, D(2025, 5, 5))], "case_id long, start_date date")
    moved = {r["id"]: r["event_date"] for r in merge.move_first_events(history, starts).collect()}
    assert moved == {1: D(2025, 5, 5), 2: D(2026, 1, 1), 3: D(2026, 1, 1)}


def test_first_contained(spark):
    rows = [(1, "x 臺南市 高雄市"), (2, "nothing"), (3, ""), (4, "新竹縣新竹市"), (5, None), (1, "x 臺南市 高雄市")]
    addresses = spark.createDataFrame(rows, "id long, address string")
    found = dims.first_contained(addresses, ["id"], F.col("address"), dims.bureau_dimension(spark), "county", "priority")
    got = sorted((r["id"], r["county"]) for r in found.collect())
    assert got == [(1, "臺南市"), (1, "臺南市"), (2, None), (3, None), (4, "新竹市"), (5, None)]


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_year_layout_prunes_by_value_and_by_a_joined_list(spark, tmp_path):
    path = str(tmp_path / "cases")
    rows = [(k, D(1992 + k % 7, 1 + k % 12, 1 + k % 28)) for k in range(700)] + [(1000, None), (1000, None)]
    ledger.write_by_year(spark.createDataFrame(rows, "id long, received_date date"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == len(rows)
    one = ledger.stored_in_year(stored, 1994)
    assert sorted(r["id"] for r in one.collect()) == [k for k, d in rows if d and d.year == 1994]
    assert "PartitionFilters: [isnotnull(received_year" in _plan(one)
    assert all("received_year=1994" in r[0] for r in one.select(F.input_file_name()).distinct().collect())
    years = spark.createDataFrame([(1993, "x"), (1997, "x"), (1997, "x"), (1999, "y")], "year int, kind string")
    some = ledger.stored_in_years(stored, years.filter("kind = 'x'"), "year")
    assert sorted(r["id"] for r in some.collect()) == [k for k, d in rows if d and d.year in (1993, 1997)]
    assert ledger.stored_in_years(stored, years.filter("kind = 'z'"), "year").count() == 0
    listed = str(tmp_path / "years")
    years.write.parquet(listed)
    assert "dynamicpruning" in _plan(ledger.stored_in_years(stored, spark.read.parquet(listed).filter("kind = 'x'"), "year"))


def test_first_contained_meets_names_by_their_rarest_piece(spark):
    """Names and texts that share their first characters, repeated texts, blank and null ones, and names longer than any text."""
    texts = [f"aa{k % 50}z" for k in range(300)] + ["", None, "aa", "q", "aa7z aa8z", "zzaa49"]
    names = [(f"aa{k}z", 100 - k) for k in range(60)] + [("", 0), ("aa49", 500), ("q", 3), ("aa8z aa9z aa10z", 1), (None, 0), ("aa7z", 93)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    dim = spark.createDataFrame(names, "name string, priority int")
    got = {r["id"]: r["name"] for r in dims.first_contained(df, ["id"], F.col("t"), dim, "name", "priority").collect()}
    wanted = {k: min(((p, n) for n, p in names if n and t and n in t), default=(0, None))[1] for k, t in enumerate(texts)}
    assert got == wanted


def test_first_contained_with_tied_priorities_and_short_names(spark):
    names = spark.createDataFrame([(1, "a", "Y"), (1, "z", "X"), (0, "s", "q"), (2, "b", "")], "priority int, code string, county string")
    texts = spark.createDataFrame([(1, "abXcdY"), (2, "uq"), (3, "")], "id long, address string")
    for gram in (1, 2, 3):
        found = dims.first_contained(texts, ["id"], F.col("address"), names, "county", "priority", gram)
        assert {r["id"]: r["county"] for r in found.collect()} == {1: "X", 2: "q", 3: None}


def test_branches(spark):
    offices = spark.createDataFrame(
        [(0, "A05", "臺北市", "中北稽徵所", "中山區", "east"), (1, "A05", "臺北市", "中南稽徵所", "中山區", "west"), (2, "H01", "新北市", "中和稽徵所", "永和區", ""),
         (3, "B01", "臺中市", "東山稽徵所", "北屯區", ""), (4, "B01", "臺中市", "民權稽徵所", "北區", "")],
        "ordinal int, bureau_code string, county string, office_name string, district string, boundary string",
    )
    addresses = spark.createDataFrame(
        [(1, "臺北市中山區松江路100號"), (2, "臺北市中山區松江路以東"), (3, "新北市永和區中正路1號"), (4, "台中市北屯區1號"), (5, "高雄市")], "id long, address string"
    )
    located = addresses.withColumn("_b", dims.bureau_of("address")).select("id", "address", "_b.*")
    from caseflow.functions.columns import tax_address

    got = {r["id"]: (r["branch_name"], r["branch_candidates"], r["needs_confirmation"]) for r in dims.resolve_branch(located, tax_address("address"), offices).collect()}
    assert got[1] == ("", ["中北稽徵所", "中南稽徵所"], True) and got[2] == ("中北稽徵所", ["中北稽徵所"], False)
    assert got[3][0] == "中和稽徵所" and got[4][0] == "東山稽徵所" and got[5] == ("", [], False)


def test_catalogue_search(spark):
    catalogue = spark.createDataFrame(
        [("E801010", "室內裝潢業", "營造及工程業"), ("E801020", "門窗安裝工程業", "營造及工程業"), ("F101010", "營造批發業", "批發業")],
        "code string, name string, category_name string",
    )
    found = dims.search_catalogue(catalogue, ["e801", "室內", "無", "營造", " E80 1010 "], 5)
    got = {}
    for r in found.orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append((r["code"], r["score"]))
    assert got == {
        "e801": [("E801010", 1), ("E801020", 1)], "室內": [("E801010", 2)], "營造": [("F101010", 2), ("E801010", 5), ("E801020", 5)],
        " E80 1010 ": [("E801010", 0)],
    }


def test_postal_codes(spark):
    addresses = spark.createDataFrame([(1, "南投縣竹山鎮 集山路62號0181691323"), (2, "集山路62號"), (3, "臺北市信義路1號")], "id long, address string")
    zips = spark.createDataFrame(
        [("南投縣竹山鎮集山路62號", "557012", "55775"), ("集山路62號", "557012", "55775"), ("臺北市信義路1號", "", "11049")], "address_key string, zipcode6 string, zipcode string"
    )
    assert {r["id"]: r["postal_code"] for r in dims.postal_codes(addresses, zips).collect()} == {1: "557012", 2: "", 3: "11049"}


def test_consent_leaves_out_blank_names(spark):
    cases = spark.createDataFrame(
        [(1, [], "甲有限公司", ["王一", " ", "林二"], "", "", "", [])],
        "case_id long, topic_keys array<string>, company string, directors array<string>, chairman string, registration_address string, "
        "capital string, contributions array<struct<name:string,capital:string>>",
    )
    row = forms.consent_rows(cases).first()
    assert row["body"] == "茲同意設立甲有限公司，訂定公司章程，並選任王一、林二為董事。" and row["title"] == "甲有限公司股東同意書"


def test_file_categories_and_duplicates(spark):
    names = ["房屋稅籍證明.pdf", "建物登記謄本.pdf", "建物所有權狀.jpg", "房屋稅.pdf", "公司名稱預查.pdf", "其他.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(dataset.file_category("name")).collect()] == [
        "tax_registration", "building_transcript", "building_title", "house_tax", "precheck", None,
    ]
    records = spark.createDataFrame(
        [("a", "h1", 1), ("a", "h1", 2), ("b", "h1", 3), ("a", None, 4), ("x", "h1", 5)], "category string, digest string, place long"
    )
    got = {r["place"]: r["outcome"] for r in dataset.mark_duplicates(records, "category", "digest", "place", ["x"]).collect()}
    assert got == {1: "kept", 2: "duplicates", 3: "kept", 4: "unreadable_files", 5: "excluded_categories"}


def sequential_names(names):
    used, out = set(), []
    for name in names:
        dot = name.rfind(".")
        base, extension = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        unique, k = name, 2
        while unique in used:
            unique, k = f"{base}_{k}{extension}", k + 1
        used.add(unique)
        out.append(unique)
    return out


@pytest.mark.parametrize(
    "names",
    [
        ["a.pdf", "a.pdf", "b", "b", "b", ".x", ".x", "c.tar.gz", "c.tar.gz"], ["a.pdf", "a.pdf", "a_2.pdf"], ["a_2.pdf", "a.pdf", "a.pdf"],
        ["a.pdf", "a_2.pdf", "a.pdf", "a_3.pdf", "a.pdf", "a_2.pdf", "a_2_2.pdf", "a.pdf"], ["a", "a", "a_2", "a_2", "a_2_2", "a"],
    ],
)
def test_unique_names_equal_the_sequential_rule(spark, names):
    entries = spark.createDataFrame(list(enumerate(names)), "place long, name string")
    got = [r["unique_name"] for r in dataset.unique_names(entries, "name", "place").orderBy("place").collect()]
    assert got == sequential_names(names)


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PDF").write_bytes(b"abc")
    (tmp_path / "sub" / "b.txt").write_bytes(b"abc")
    files = tables.file_inventory(spark, str(tmp_path), [".pdf"]).collect()
    assert [(r["suffix"], r["size_bytes"]) for r in files] == [(".pdf", 3)]
    digests = {r["sha256"] for r in tables.file_digests(spark, str(tmp_path)).collect()}
    assert digests == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    lines = tmp_path / "m.jsonl"
    lines.write_text('{"category":"a","size_bytes":1}\n\n{bad\n', encoding="utf-8")
    good, bad = tables.read_json_lines(spark, str(lines), tables.MANIFEST_SCHEMA)
    assert [(r["category"], r["size_bytes"]) for r in good.collect()] == [("a", 1)] and [r["_corrupt_record"] for r in bad.collect()] == ["{bad"]


def test_page_bytes_in_other_charsets(spark):
    body = '<meta charset="big5">中文'
    rows = [(1, bytearray(body.encode("big5"))), (2, bytearray("中文".encode())), (3, bytearray(b"<meta charset=nonsense>x"))]
    df = spark.createDataFrame(rows, "page_id int, content binary")
    assert {r["page_id"]: r["html"] for r in tables.page_text_from_bytes(df).collect()} == {1: body, 2: "中文", 3: "<meta charset=nonsense>x"}


def test_empty_tables(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    none = t.cases.filter("id < 0")
    enriched = ledger.enrich(none, t.items.filter("case_id < 0"), t.history.filter("id < 0"))
    assert enriched.count() == 0 and ledger.reminders(enriched, D(2026, 1, 1)).count() == 0
    assert ledger.kpis(none).first()["active"] == 0


def test_unique_names_on_random_lists(spark):
    import random

    rnd = random.Random(7)
    lists = [[f"L{i}x{rnd.choice(['', '_2', '_3', '_2_2', '_4', '_3_2'])}.pdf" for _ in range(rnd.randint(2, 14))] for i in range(80)]
    entries = [(i * 100 + p, n) for i, names in enumerate(lists) for p, n in enumerate(names)]
    df = spark.createDataFrame(entries, "place long, name string")
    expected = [n for names in lists for n in sequential_names(names)]
    for rows in (1_000_000, 3):
        got = [r["unique_name"] for r in dataset.unique_names(df, "name", "place", slice_rows=rows).orderBy("place").collect()]
        assert got == expected
