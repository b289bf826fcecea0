"""Column jobs and case-form queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import columns as c
from caseflow.functions import vocab
from caseflow.functions.udfs import nfkc
from caseflow.operators import forms
from caseflow.plans.inputs import AS_OF, dealt, national_id_of, pick

from caseflow.plans.inputs_sql import national_id_of as national_id_sql
from caseflow.plans.inputs_sql import pick as pick_sql
from caseflow.plans.registry import query


def _roc_texts(t):
    """Order dates written the ways people write them; one form in seven is not a real day."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    y, m, n = F.year(d) - 1911, F.month(d), F.dayofmonth(d)
    wide = F.translate(F.format_string("%03d．%02d．%02d", y, m, n), "0123456789", "０１２３４５６７８９")
    form = k % 7
    text = (
        F.when(form == 0, F.format_string("中華民國 %d 年 %d 月 %d 日", y, m, n))
        .when(form == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(form == 2, wide)
        .when(form == 3, F.format_string("%03d%02d%02d", y, m, n))
        .when(form == 4, F.date_format(d, "yyyyMMdd"))
        .when(form == 5, F.format_string("民國%d年2月30日", y))
        .otherwise(F.format_string("%d-%d-%d備註", y, m, n))
    )
    return t.orders.select(k.alias("id"), text.alias("text"), d.alias("d"))


@query("h1_roc_date", """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 IN (5, 6) THEN ''
    ELSE printf('%03d/%02d/%02d', year(o_orderdate) - 1911, month(o_orderdate), day(o_orderdate)) END AS roc_date FROM orders""")
def _(t):
    return _roc_texts(t).select("id", c.roc_date("text").alias("roc_date"))


@query("h2_roc_to_iso", """
  SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 4 THEN '' ELSE '' END AS iso,
    CASE o_orderkey % 7 WHEN 6 THEN strftime(o_orderdate, '%Y%m%d')::BIGINT ELSE 0 END AS rank
  FROM orders""")
def _(t):
    return _roc_texts(t).select("id", c.roc_to_iso("text").alias("iso"), c.roc_rank("text").alias("rank"))


@query("h3_iso_to_roc_parts", """
  SELECT id, coalesce((year(submitted_date) - 1911)::VARCHAR, '') AS roc_year, coalesce(month(submitted_date)::VARCHAR, '') AS roc_month,
    coalesce(day(submitted_date)::VARCHAR, '') AS roc_day, id % 40 BETWEEN 1 AND 31 AS day_ok, id % 12 = 0 OR id % 15 BETWEEN 1 AND 12 AS month_ok
  FROM cases""")
def _(t):
    month = F.when(F.col("id") % 12 == 0, "").otherwise((F.col("id") % 15).cast("string"))
    return t.cases.select(
        "id", c.roc_parts("submitted_date").alias("p"), c.roc_part_ok((F.col("id") % 40).cast("string"), 1, 31, True).alias("day_ok"),
        c.roc_part_ok(month, 1, 12).alias("month_ok"),
    ).select("id", "p.*", "day_ok", "month_ok")


LETTERS = list(vocab.ID_LETTER_VALUES)
ID_SQL = f"""
  ids AS (SELECT o_orderkey AS id, {national_id_sql('o_orderkey')} AS code FROM orders),
  judged AS (
    SELECT id, code, ({[vocab.ID_LETTER_VALUES[x] for x in LETTERS]})[strpos('{''.join(LETTERS)}', substr(code, 1, 1))] AS v FROM ids),
  checked AS (
    SELECT id, code, (v // 10 + v % 10 * 9 + {' + '.join(f"substr(code, {i}, 1)::INT * {10 - i}" for i in range(2, 10))}
      + substr(code, 10, 1)::INT) % 10 = 0 AS valid FROM judged)"""


@query("h5_national_id", f"WITH {ID_SQL} SELECT id, code, valid FROM checked")
def _(t):
    code = national_id_of(F.col("o_orderkey"))
    spaced = F.lower(F.concat(F.substring(code, 1, 1), F.lit(" - "), F.substring(code, 2, 9)))
    return t.orders.select(
        F.col("o_orderkey").alias("id"), c.id_text(spaced).alias("code"), c.national_id_ok(spaced).alias("valid")
    )


@query("h6_precheck_number", """
  WITH n AS (SELECT o_orderkey AS id, printf('%03d%06d', o_orderkey % 250, o_orderkey % 3) AS number FROM orders)
  SELECT id, number, id % 250 BETWEEN 80 AND 199 AND id % 3 <> 0 AS valid FROM n""")
def _(t):
    k = F.col("o_orderkey")
    text = F.translate(F.format_string("預查：%03d-%06d 號", k % 250, k % 3), "0123456789", "０１２３４５６７８９")
    return t.orders.select(k.alias("id"), c.digits(text).alias("number"), c.precheck_ok(text).alias("valid"))


@query("h9_text_fold", f"""
  SELECT o_orderkey AS id, '統壹編號 ABC-' || o_orderkey || '／臺灣' AS folded, '統壹編號 ABC-' || o_orderkey || '/台灣' AS nfkc FROM orders"""
  .replace("／臺灣", "/臺灣"))
def _(t):
    wide = F.translate(F.concat(F.lit("ABC-"), F.col("o_orderkey").cast("string"), F.lit("/")), c.HALF_WIDTH, c.FULL_WIDTH)
    folded = c.fold_glyphs(F.concat(F.lit("統壹編号　"), wide, F.lit("台湾")))
    return t.orders.select(
        F.col("o_orderkey").alias("id"), folded.alias("folded"), nfkc(F.concat(F.lit("統壹編號　"), wide, F.lit("台灣"))).alias("nfkc")
    )


H10_TEXTS = ["可自領", "案件已郵寄", "正本電子送達", "通知補正", "打字中", "校對", "審查中", "核准發文中", "核准", "收件"]
H10_RESULTS = ["可自領", "郵寄", "電子送達", "補件", "打字中", "校對中", "審查中", "核准發文中", "核准", "已送件"]


@query("h10_official_status", f"""
  SELECT event_id AS id, {pick_sql(H10_TEXTS, 'event_id')} AS official, {pick_sql(H10_RESULTS, 'event_id')} AS app_status FROM events""")
def _(t):
    official = pick(H10_TEXTS, F.col("event_id"))
    return t.events.select(F.col("event_id").alias("id"), official.alias("official"), c.app_status(official).alias("app_status"))


@query("h11_amount_parse", """
  SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE round(o_totalprice)::BIGINT END AS amount,
    CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey ELSE (floor(o_totalprice * 100 + 0.5))::BIGINT END AS loose
  FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("-"), k.cast("string")))
        .when(k % 5 == 2, F.concat(k.cast("string"), F.lit("元")))
        .otherwise(F.format_number("o_totalprice", 2))
    )
    return t.orders.select(k.alias("id"), c.amount(text).alias("amount"), c.loose_amount(text).alias("loose"))


@query("h12_clean_text", """
  SELECT p_partkey AS id, substr(p_name, 1, 6) AS name, substr(p_brand, 1, 7) || '|' || substr(p_type, 1, 7) AS tags FROM part""")
def _(t):
    tags = F.array(F.lit("  "), F.concat(F.lit(" "), "p_brand"), F.lit(None).cast("string"), F.concat("p_type", F.lit(" ")), F.lit("beyond"))
    return t.part.select(
        F.col("p_partkey").alias("id"), c.clean_text(F.concat(F.lit("  "), "p_name", F.lit(" ")), 6).alias("name"),
        F.array_join(c.clean_strings(tags, 4, 7), "|").alias("tags"),
    )


def _long_list(t):
    """Up to 60 shareholders for a customer, with every field; some lack a key, some are longer than the entry form allows."""
    k = F.col("c_custkey")
    said = lambda prefix, i, more="": F.concat(F.lit(f" {prefix}"), k.cast("string"), F.lit("-"), i.cast("string"), F.lit(f"{more} "))

    def person(i):
        return F.struct(
            F.when(i % 3 != 0, said("key", i)).alias("key"), said("name", i).alias("name"), F.lit("a123456789").alias("nationalId"),
            F.format_string("0%d/01/%02d", 80 + i % 20, i % 28 + 1).alias("birthDate"), said("road ", i, ", floor 2").alias("address"),
            F.when(i % 40 == 39, F.lit("12345678901")).otherwise(F.format_string("%05d", i)).alias("postalCode"), F.format_number(i * 1000, 0).alias("capital"),
        )

    people = F.transform(F.sequence(F.lit(0), (k % 60).cast("int")), person)
    return dealt(t.customer.select("c_custkey")).select(k.alias("id"), F.to_json(people).alias("text"))


@query("h12_shareholders", """
  WITH p AS (SELECT c_custkey AS id, unnest(range(0, c_custkey % 60 + 1)) AS i FROM customer),
  f AS (SELECT id, i, 'name' || id || '-' || i AS name FROM p)
  SELECT id, i::INT AS place, CASE WHEN i % 3 <> 0 THEN 'key' || id || '-' || i ELSE substr(sha256(i || '|' || name || '|A123456789'), 1, 32) END AS key, name,
    'A123456789' AS national_id, printf('0%d/01/%02d', 80 + i % 20, i % 28 + 1) AS birth_date, 'road ' || id || '-' || i || ', floor 2' AS address,
    CASE WHEN i % 40 = 39 THEN '12345678901' ELSE printf('%05d', i) END AS postal_code, format('{:,}', i * 1000) AS capital, id % 60 >= 39 AS truncated
  FROM f""")
def _(t):
    # Each once: what a generator unfolds, Spark also asks beforehand whether it is empty.
    lists = _long_list(t).withColumn("text", c.once(F.col("text"))).withColumn("s", c.once(forms.stored_shareholders("text")))
    read = lists.select("id", "s", forms.shareholders_cut("text").alias("truncated"))
    rows = read.select("id", "truncated", F.posexplode("s").alias("place", "p"))
    return rows.select(
        "id", "place", "p.key", "p.name", F.col("p.nationalId").alias("national_id"), F.col("p.birthDate").alias("birth_date"), "p.address",
        F.col("p.postalCode").alias("postal_code"), "p.capital", "truncated",
    )


@query("h13_tolerant_json", """
  SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '' ELSE regexp_extract(props, '([0-9]+)', 1) END AS k,
    CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS list_size FROM events""")
def _(t):
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    as_list = F.when(F.col("event_type") == "error", broken).otherwise(F.concat(F.lit('["a",'), "props", F.lit("]")))
    return t.events.select(
        F.col("event_id").alias("id"), F.coalesce(c.stored_map(broken)["k"], F.lit("")).alias("k"),
        F.size(c.stored_array(as_list)).alias("list_size"),
    )


@query("h15_progress_url", f"""
  SELECT id, CASE WHEN official_receipt_no = '' THEN ''
    WHEN entity_type = '行號' AND tax_bureau_code = '' THEN '{vocab.BUSINESS_LIST_URL}'
    WHEN entity_type = '行號' THEN '{vocab.BUSINESS_DETAIL_URL}?caseNo=' || official_receipt_no || '&agency=' || tax_bureau_code || '&receiveNo='
      || official_receipt_no || '&subAcptNo=01'
    ELSE '{vocab.COMPANY_DETAIL_URL}?rcvNo=' || official_receipt_no || '&regUnitCode=17&showPreRegNo=0' END AS url FROM cases""")
def _(t):
    return t.cases.select(
        "id", c.progress_url("official_receipt_no", "reg_unit_code", "entity_type", "tax_bureau_code", F.lit("")).alias("url")
    )


@query("h17_chinese_date", """
  WITH d AS (SELECT o_orderkey AS id, year(o_orderdate) - 1911 AS y, month(o_orderdate) AS m, day(o_orderdate) AS n FROM orders)
  SELECT id, '中華民國' || translate(y::VARCHAR, '0123456789', '〇一二三四五六七八九') || '年'
    || (['一','二','三','四','五','六','七','八','九','十','十一','十二'])[m::INT] || '月'
    || CASE WHEN id % 9 = 0 THEN '　' ELSE (['','十','二十','三十'])[(n // 10 + 1)::INT]
      || CASE WHEN n % 10 = 0 THEN '' ELSE (['一','二','三','四','五','六','七','八','九'])[(n % 10)::INT] END END || '日' AS text
  FROM d""")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), c.chinese_date(F.year(d) - 1911, F.month(d), F.when(k % 9 != 0, F.dayofmonth(d))).alias("text")
    )


@query("h18_date_consistency", f"""
  WITH p AS (
    SELECT o_orderkey AS id, printf('%03d/%02d/%02d', o_orderkey % 95, month(o_orderdate), day(o_orderdate)) AS birth,
      printf('%03d/%02d/%02d', year(o_orderdate) - 1911 + o_orderkey % 5, month(o_orderdate), day(o_orderdate)) AS issue FROM orders),
  j AS (
    SELECT *, issue <= birth AS early, issue > birth AND substr(issue, 1, 3)::INT - substr(birth, 1, 3)::INT < 14 AS young,
      substr(issue, 1, 3)::INT > {AS_OF.year - 1911} AS future,
      birth > issue AND substr(birth, 1, 3)::INT - substr(issue, 1, 3)::INT >= 14 AND substr(birth, 1, 3)::INT <= {AS_OF.year - 1911} AS swap_ok
    FROM p)
  SELECT id, CASE WHEN NOT (early OR young OR future) THEN '' WHEN swap_ok THEN '出生年月日與發證日期疑似對調，請人工確認'
    ELSE concat_ws('|', CASE WHEN early THEN '發證日期早於或等於出生年月日' WHEN young THEN '發證時未滿 14 歲，出生年月日或發證日期可能誤讀' END,
      CASE WHEN future THEN '發證日期晚於今日' END) END AS warnings FROM j""")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = lambda y: F.format_string("%03d/%02d/%02d", y, F.month(d), F.dayofmonth(d))
    pair = t.orders.select(
        k.alias("id"), text((k % 95).cast("int")).alias("birth"), text((F.year(d) - 1911 + k % 5).cast("int")).alias("issue")
    )
    return pair.select("id", F.array_join(forms.date_warnings("birth", "issue", AS_OF), "|").alias("warnings"))


@query("h19_comparable", """
  WITH d AS (SELECT doc_id AS id, regexp_replace(text, '[^A-Za-z0-9\\x{4e00}-\\x{9fff}]', '', 'g') AS a,
    regexp_replace(substr(text, 5, 60), '[^A-Za-z0-9\\x{4e00}-\\x{9fff}]', '', 'g') AS b FROM documents)
  SELECT id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS same,
    a <> '' AND (contains('theof', a) OR contains(a, 'theof')) AS has_phrase FROM d""")
def _(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), c.comparable("text", F.concat(F.lit("*"), F.substring("text", 5, 60))).alias("same"),
        c.comparable("text", F.lit("the of")).alias("has_phrase"),
    )


def _boxes(t):
    part = lambda n, m: (F.col("l_partkey") * n % m).cast("double")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array(part(1, 400), part(3, 300), part(1, 400) + 37, part(3, 300) + 20).alias("box"),
        F.lit(800).alias("width"), F.lit(560).alias("height"),
    )


@query("h20_box_scaling", """
  WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 400)::DOUBLE AS x0, (l_partkey * 3 % 300)::DOUBLE AS y0 FROM lineitem),
  g AS (SELECT *, round_even(x0 / 800 * 1000, 0)::INT AS gx0, round_even(y0 / 560 * 1000, 0)::INT AS gy0,
    round_even((x0 + 37) / 800 * 1000, 0)::INT AS gx1, round_even((y0 + 20) / 560 * 1000, 0)::INT AS gy1 FROM b)
  SELECT l_orderkey, l_linenumber, l_partkey, gx0 || ',' || gy0 || ',' || gx1 || ',' || gy1 AS grid,
    round_even(gx0::DOUBLE / 1000 * 800, 0)::INT AS px0 FROM g""")
def _(t):
    grid = _boxes(t).withColumn("g", c.grid_box(F.col("box"), "width", "height"))
    return grid.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.col("g").cast("array<string>"), ",").alias("grid"),
        c.pixel_box(F.col("g"), "width", "height")[0].alias("px0"),
    )


@query("h21_page_key", """
  SELECT doc_id AS id, substr(sha256(source || '/' || doc_id || '|' || n_chars || '|1700000000|3'), 1, 24) AS page_key FROM documents""")
def _(t):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return t.documents.select(
        F.col("doc_id").alias("id"), c.page_key(path, "n_chars", F.lit(1700000000), F.lit(3)).alias("page_key")
    )


B16_NAMES = ["陳俞欣", "王 小明", "姓名", "張", "地址陳", "林一二三四", "Ann", "歐陽大文"]


@query("b16_plausible_name", f"""
  SELECT o_orderkey AS id, {pick_sql(B16_NAMES, 'o_orderkey')} AS name, o_orderkey % 8 IN (0, 1, 7) AS plausible FROM orders""")
def _(t):
    name = pick(B16_NAMES, F.col("o_orderkey"))
    return t.orders.select(
        F.col("o_orderkey").alias("id"), name.alias("name"), c.plausible_name(name, vocab.NAME_EXCLUSIONS_TEXT).alias("plausible")
    )


@query("b17_field_value", """
  SELECT c_custkey AS id, c_custkey % 2 = 0 OR c_custkey >= 1000 AS address_ok, c_custkey % 3 = 0 AS number_ok FROM customer""")
def _(t):
    k = F.col("c_custkey")
    address = F.when(k % 2 == 0, F.format_string("%05d路 ", k)).otherwise(F.format_string("%d：號|1", k))
    number = F.when(k % 3 == 0, F.format_string("%03d:4567", k % 1000)).otherwise(F.format_string("%03d456", k % 1000))
    return t.customer.select(
        k.alias("id"), c.field_value_ok(F.lit("property_address"), address).alias("address_ok"),
        c.field_value_ok(F.lit("tax_registration_number"), number).alias("number_ok"),
    )


def _shareholder_forms(t):
    k = F.col("o_orderkey")
    person = lambda i: F.struct(
        F.format_string(f"sh{i}-%d", F.col("o_custkey")).alias("name"), F.lit("a123456789").alias("nationalId"),
        F.format_number(k * i, 0).alias("capital"),
    )
    people = F.slice(F.array(person(1), person(2), person(3)), F.lit(1), (k % 4).cast("int"))
    text = F.when(k % 10 == 7, "[{bad").otherwise(F.to_json(people))
    return t.orders.select(
        k.alias("case_id"), forms.stored_shareholders(text).alias("shareholders"),
        F.when(k % 5 == 0, "").otherwise(F.format_number(F.floor("o_totalprice"), 0)).alias("capital"),
        F.when(k % 3 == 0, F.format_number(k * 2, 0)).otherwise("").alias("representative_capital"),
        F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("rep-"), F.col("o_custkey").cast("string"))).alias("representative"),
    )


CAPITAL = """
  f AS (
    SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 10 = 7 THEN 0 ELSE o_orderkey % 4 END AS people, o_custkey,
      CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS declared, o_orderkey % 5 <> 0 AS has_capital FROM orders),
  g AS (SELECT *, case_id * (people * (people + 1) // 2) AS other_capital FROM f),
  h AS (SELECT *, CASE WHEN case_id % 3 = 0 THEN case_id * 2 WHEN declared > other_capital THEN declared - other_capital END AS rep FROM g)"""


@query("d12_capital_check", f"""
  WITH {CAPITAL}
  SELECT case_id, other_capital, coalesce(format('{{:,}}', rep), '') AS representative_capital,
    coalesce(rep, 0) + other_capital AS subscribed_capital, has_capital AND coalesce(rep, 0) + other_capital <> declared AS mismatch FROM h""")
def _(t):
    return forms.capital_check(_shareholder_forms(t)).select(
        "case_id", "other_capital", "representative_capital", "subscribed_capital", "mismatch"
    )


@query("d13_roster", f"""
  WITH {CAPITAL}
  SELECT case_id, 1 AS director_count, concat_ws(chr(10),
    CASE WHEN case_id % 9 <> 0 THEN 'rep-' || o_custkey || '　新臺幣 ' || coalesce(format('{{:,}}', rep), '') || ' 元' END,
    CASE WHEN people >= 1 THEN 'sh1-' || o_custkey || '　新臺幣 ' || format('{{:,}}', case_id) || ' 元' END,
    CASE WHEN people >= 2 THEN 'sh2-' || o_custkey || '　新臺幣 ' || format('{{:,}}', case_id * 2) || ' 元' END,
    CASE WHEN people >= 3 THEN 'sh3-' || o_custkey || '　新臺幣 ' || format('{{:,}}', case_id * 3) || ' 元' END) AS roster_text FROM h""")
def _(t):
    return forms.roster(forms.capital_check(_shareholder_forms(t))).select("case_id", "director_count", "roster_text")


OUTPUTS = [
    {"key": "application", "kind": "missing"},
    {"key": "registration_form", "kind": "generated", "needs": ["registration_address"]},
    {"key": "articles", "kind": "generated"},
    {"key": "aml", "kind": "generated", "needs": ["national_id", "contact_address"]},
    {"key": "precheck", "kind": "source", "slots": ["R"]},
    {"key": "address_proof", "kind": "source", "slots": ["A", "N"]},
]


def _slot_files(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("slot"), F.col("l_suppkey").alias("file_id")
    )


SLOT_COUNTS = """
  counts AS (
    SELECT l_orderkey AS case_id, CASE WHEN l_returnflag = 'R' THEN 'precheck' ELSE 'address_proof' END AS output_key,
      count(DISTINCT l_suppkey) AS file_count FROM lineitem WHERE l_returnflag IN ('R', 'A', 'N') GROUP BY 1, 2)"""


@query("c13_output_files", f"WITH {SLOT_COUNTS} SELECT * FROM counts")
def _(t):
    return forms.slot_file_counts(_slot_files(t), OUTPUTS)


@query("b11_output_readiness", f"""
  WITH {SLOT_COUNTS},
  f AS (SELECT case_id, company <> '' AND representative <> '' AS base, registration_address, national_id, contact_address FROM preparation),
  o AS (SELECT * FROM (VALUES ('application', 'missing'), ('registration_form', 'generated'), ('articles', 'generated'),
    ('aml', 'generated'), ('precheck', 'source'), ('address_proof', 'source')) v(output_key, kind))
  SELECT f.case_id, o.output_key, o.kind, CASE o.output_key WHEN 'application' THEN FALSE
      WHEN 'registration_form' THEN base AND registration_address <> '' WHEN 'articles' THEN base
      WHEN 'aml' THEN base AND national_id <> '' AND contact_address <> '' ELSE coalesce(c.file_count, 0) > 0 END AS ready
  FROM f CROSS JOIN o LEFT JOIN counts c ON c.case_id = f.case_id AND c.output_key = o.output_key""")
def _(t):
    return forms.output_readiness(t.preparation, _slot_files(t), OUTPUTS)


@query("b12_identity_completeness", """
  WITH s AS (
    SELECT case_id, CASE case_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'auto' END AS side, representative <> '' AS n,
      case_id % 7 <> 0 AS i, case_id % 2 = 0 AS b, registration_address <> '' AS a FROM preparation)
  SELECT case_id, side,
    CASE side WHEN 'back' THEN concat_ws('、', CASE WHEN a THEN '地址' END, CASE WHEN i THEN '證號' END)
      WHEN 'front' THEN concat_ws('、', CASE WHEN n THEN '姓名' END, CASE WHEN i THEN '證號' END, CASE WHEN b THEN '生日' END)
      ELSE concat_ws('、', CASE WHEN n THEN '姓名' END, CASE WHEN i THEN '證號' END, CASE WHEN b THEN '生日' END, CASE WHEN a THEN '地址' END) END AS found,
    CASE side WHEN 'back' THEN concat_ws('、', CASE WHEN NOT a THEN '地址' END, CASE WHEN NOT i THEN '證號' END)
      WHEN 'front' THEN concat_ws('、', CASE WHEN NOT n THEN '姓名' END, CASE WHEN NOT i THEN '證號' END, CASE WHEN NOT b THEN '生日' END)
      ELSE concat_ws('、', CASE WHEN NOT n THEN '姓名' END, CASE WHEN NOT i THEN '證號' END, CASE WHEN NOT b THEN '生日' END,
        CASE WHEN NOT a THEN '地址' END) END AS missing,
    CASE WHEN CASE WHEN side = 'back' THEN a ELSE n AND i END THEN 'success' ELSE 'review' END AS state FROM s""")
def _(t):
    k = F.col("case_id")
    scans = t.preparation.select(
        k, F.when(k % 3 == 0, "front").when(k % 3 == 1, "back").otherwise("auto").alias("side"),
        F.col("representative").alias("name"), F.when(k % 7 != 0, F.col("national_id")).alias("national_id"),
        F.when(k % 2 == 0, "080/05/06").otherwise("").alias("birth_date"), F.col("registration_address").alias("address"),
    )
    return forms.identity_completeness(scans).select("case_id", "side", "found", "missing", "state")


@query("i9_best_attempt", f"""
  WITH {ID_SQL},
  a AS (
    SELECT l.l_orderkey AS file_id, l.l_linenumber * 100000000 + l.l_partkey * 10000 + l.l_suppkey AS attempt_no,
      CASE WHEN l.l_returnflag = 'A' THEN '' ELSE 'name-' || l.l_suppkey END AS name, l.l_partkey,
      c.code AS national_id, c.valid FROM lineitem l JOIN checked c ON c.id = l.l_partkey),
  r AS (
    SELECT *, CASE WHEN valid AND name <> '' THEN 1 WHEN valid THEN 2 WHEN name <> '' THEN 3 END AS tier FROM a)
  SELECT DISTINCT file_id, attempt_no, name, national_id, tier FROM r WHERE tier IS NOT NULL
  QUALIFY rank() OVER (PARTITION BY file_id ORDER BY tier, attempt_no) = 1""")
def _(t):
    attempts = t.lineitem.select(
        F.col("l_orderkey").alias("file_id"),
        (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("attempt_no"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("name-"), F.col("l_suppkey").cast("string"))).alias("name"),
        national_id_of(F.col("l_partkey")).alias("national_id"),
    )
    return forms.best_attempt(attempts, "file_id")


def _file_results(t):
    k = F.col("l_suppkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("case_id"),
        (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 10000 + k).alias("file_ord"),
        (F.col("l_quantity") < 49).alias("done"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("name-"), k.cast("string"))).otherwise("").alias("name"),
        F.when(F.col("l_linestatus") == "O", national_id_of(F.col("l_partkey"))).otherwise("").alias("national_id"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("birth-"), k.cast("string"))).otherwise("").alias("birth_date"),
        F.when(F.col("l_discount") > 0.05, F.concat(F.lit("address-"), k.cast("string"))).otherwise("").alias("address"),
        F.concat(F.lit("file-"), k.cast("string")).alias("source_file"),
        F.round(F.col("l_quantity") / 50, 4).alias("confidence"),
    )


RESULTS_SQL = f"""
  r AS (
    SELECT l_orderkey AS case_id, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS file_ord, l_quantity < 49 AS done,
      CASE WHEN l_returnflag = 'A' THEN 'name-' || l_suppkey ELSE '' END AS name,
      CASE WHEN l_linestatus = 'O' THEN {national_id_sql('l_partkey')} ELSE '' END AS national_id,
      CASE WHEN l_tax > 0.04 THEN 'birth-' || l_suppkey ELSE '' END AS birth_date,
      CASE WHEN l_discount > 0.05 THEN 'address-' || l_suppkey ELSE '' END AS address, 'file-' || l_suppkey AS source_file,
      round(l_quantity / 50, 4) AS confidence, l_partkey FROM lineitem)"""


@query("d11_merge_sources", f"""
  WITH {RESULTS_SQL}
  SELECT case_id, coalesce(arg_min(name, file_ord) FILTER (name <> ''), '') AS name,
    coalesce(arg_min(birth_date, file_ord) FILTER (birth_date <> ''), '') AS birth_date,
    coalesce(arg_min(address, file_ord) FILTER (address <> ''), '') AS address, max(confidence) AS confidence FROM r GROUP BY case_id""")
def _(t):
    return forms.merge_sources(_file_results(t), "case_id", "file_ord", ["name", "birth_date", "address"])


@query("d11_identity_selection", f"""
  WITH {ID_SQL}, {RESULTS_SQL},
  v AS (SELECT r.*, r.national_id <> '' AND c.valid AS id_ok, name <> '' OR national_id <> '' OR birth_date <> '' OR address <> '' AS filled
    FROM r JOIN checked c ON c.id = r.l_partkey),
  g AS (
    SELECT case_id, count(*) FILTER (NOT done) AS waiting, arg_min(name, file_ord) FILTER (name <> '') AS n,
      arg_min(national_id, file_ord) FILTER (id_ok) AS i, arg_min(source_file, file_ord) FILTER (id_ok) AS i_file,
      arg_min(birth_date, file_ord) FILTER (birth_date <> '') AS b, arg_min(address, file_ord) FILTER (address <> '') AS a,
      arg_min(name, file_ord) FILTER (filled) AS s_name, arg_min(national_id, file_ord) FILTER (filled) AS s_id,
      arg_min(source_file, file_ord) FILTER (filled) AS s_file FROM v GROUP BY case_id),
  st AS (SELECT *, CASE WHEN waiting > 0 THEN 'processing' WHEN n IS NOT NULL AND i IS NOT NULL THEN 'success'
    WHEN s_file IS NOT NULL THEN 'partial' ELSE 'review' END AS state FROM g)
  SELECT case_id, state, CASE state WHEN 'success' THEN n WHEN 'partial' THEN s_name ELSE '' END AS name,
    CASE state WHEN 'success' THEN i WHEN 'partial' THEN s_id ELSE '' END AS national_id,
    CASE state WHEN 'success' THEN i_file WHEN 'partial' THEN s_file ELSE '' END AS source_file,
    CASE WHEN state IN ('success', 'partial') THEN coalesce(b, '') ELSE '' END AS birth_date,
    CASE WHEN state IN ('success', 'partial') THEN coalesce(a, '') ELSE '' END AS address FROM st""")
def _(t):
    return forms.identity_selection(_file_results(t), "case_id", "file_ord")


@query("i10_consent_rows", """
  WITH b AS (SELECT *, coalesce(nullif(company, ''), '＿＿＿＿＿＿') AS co FROM preparation),
  k AS (SELECT *, unnest(CASE case_id % 3 WHEN 0 THEN ['incorporation'] WHEN 1 THEN ['name_change', 'capital_increase']
    ELSE ['address_change', 'director_appointment', 'articles_amendment'] END) AS topic FROM b)
  SELECT case_id, co || '股東同意書' AS title,
    CASE topic WHEN 'incorporation' THEN '公司設立' WHEN 'name_change' THEN '公司名稱變更' WHEN 'capital_increase' THEN '增資'
      WHEN 'address_change' THEN '公司所在地變更' WHEN 'director_appointment' THEN '董事、董事長選任' ELSE '修正公司章程' END AS subject,
    CASE topic WHEN 'incorporation' THEN '茲同意設立' || co || '，訂定公司章程，並選任' || coalesce(nullif(representative, ''), '＿＿＿＿＿＿') || '為董事。'
      WHEN 'name_change' THEN '茲同意本公司更名為' || co || '，並同意修正公司章程如所附章程修正條文對照表。'
      WHEN 'capital_increase' THEN '茲同意本公司增資新臺幣' || coalesce(nullif(capital_text, ''), '＿＿＿＿＿＿') || '元，由'
        || coalesce(nullif(representative, ''), '＿＿＿＿＿＿') || '出資新臺幣' || coalesce(nullif(capital_text, ''), '＿＿＿＿＿＿') || '元。'
      WHEN 'address_change' THEN '茲同意本公司所在地遷至' || coalesce(nullif(registration_address, ''), '＿＿＿＿＿＿') || '，並同意修正公司章程如所附章程修正條文對照表。'
      WHEN 'director_appointment' THEN '茲同意改推' || coalesce(nullif(representative, ''), '＿＿＿＿＿＿') || '為董事，chair為董事長，對外代表本公司。'
      ELSE '茲同意修改公司章程如所附章程修正條文對照表。' END AS body
  FROM k""")
def _(t):
    k = F.col("case_id")
    listed = lambda *keys: F.array(*map(F.lit, keys)).cast("array<string>")
    cases = t.preparation.select(
        k, F.when(k % 3 == 0, listed()).when(k % 3 == 1, listed("name_change", "unknown", "capital_increase"))
        .otherwise(listed("address_change", "director_appointment", "articles_amendment")).alias("topic_keys"),
        "company", F.array(F.lit(" "), "representative").alias("directors"), F.lit("chair").alias("chairman"), "registration_address",
        F.col("capital_text").alias("capital"), F.array(F.struct(F.col("representative").alias("name"), F.col("capital_text").alias("capital"))).alias("contributions"),
    )
    return forms.consent_rows(cases).drop("place")
