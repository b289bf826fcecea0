"""Reference-data queries: catalogue, jurisdiction, offices, defaults and postal codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.columns import card_address, document_address, postal_key, tax_address
from caseflow.operators import dims
from caseflow.plans.inputs import AS_OF, address_of
from caseflow.plans.inputs_sql import address_of as address_sql
from caseflow.plans.registry import query


@query("a7_catalogue_build", """
  SELECT trim(p_brand || ' ' || p_size) AS code, p_name AS name, p_type AS category FROM part
  QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1""")
def _(t):
    raw = t.part.select(
        F.col("p_partkey").alias("input_pos"),
        F.concat(F.lit(" "), "p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("code"),
        F.concat("p_name", F.lit(" ")).alias("name"),
        F.col("p_type").alias("category"),
    )
    return dims.build_catalogue(raw).orderBy("code")


@query("b9_office_missing_fields", """
  SELECT id, concat_ws('、', CASE WHEN unified_number = '' THEN '統一編號' END, CASE WHEN responsible_person = '' THEN '負責人' END,
    CASE WHEN responsible_person_id = '' THEN '負責人身分證字號' END, CASE WHEN address = '' THEN '地址' END,
    CASE WHEN phone = '' THEN '電話' END, CASE WHEN media_code = '' THEN '媒體代號' END,
    CASE WHEN license_number = '' THEN '證書字號' END) AS missing
  FROM offices""")
def _(t):
    return t.offices.select("id", dims.missing_office_fields().alias("missing"))


@query("b10_proof_eligibility", """
  WITH office_gaps AS (
    SELECT id AS office, concat_ws('、', CASE WHEN unified_number = '' THEN '統一編號' END,
      CASE WHEN responsible_person = '' THEN '負責人' END, CASE WHEN responsible_person_id = '' THEN '負責人身分證字號' END,
      CASE WHEN phone = '' THEN '電話' END, CASE WHEN license_number = '' THEN '證書字號' END) AS missing FROM offices),
  judged AS (
    SELECT c.id, CASE
      WHEN coalesce(a.status, '') NOT IN ('received', 'archived') THEN 'approval'
      WHEN NOT regexp_full_match(c.tax_id, '[0-9]{8}') THEN 'tax_id'
      WHEN coalesce(p.office_id, 0) < 1 THEN 'office'
      WHEN g.missing IS NULL THEN 'unknown_office'
      WHEN g.missing <> '' THEN 'office:' || g.missing
      WHEN c.company_name = '' OR c.representative = '' OR c.address = '' THEN 'case_fields'
      WHEN coalesce(p.tax_registration_number, '') = '' THEN 'tax_registration_number'
      WHEN coalesce(p.responsible_person_id, '') = '' THEN 'responsible_person_id'
      ELSE '' END AS reason
    FROM cases c LEFT JOIN approvals a ON a.case_id = c.id AND a.agency = 'national_tax'
      LEFT JOIN proofs p ON p.case_id = c.id LEFT JOIN office_gaps g ON g.office = p.office_id)
  SELECT id, reason, reason = '' AS eligible FROM judged""")
def _(t):
    return dims.proof_eligibility(t.cases, t.approvals, t.proofs, t.offices)


PREPARED = """
  prepared AS (
    SELECT c.id, c.company_name AS company,
      coalesce(nullif(p.representative, ''), c.representative) AS representative,
      coalesce(p.national_id, '') AS national_id,
      coalesce(nullif(p.precheck, ''), c.precheck_no) AS precheck,
      coalesce(p.contact_address, '') AS contact_address,
      coalesce(nullif(p.registration_address, ''), c.address) AS registration_address,
      coalesce(p.contact_phone, '') AS contact_phone,
      coalesce(nullif(p.capital_text, ''), CASE WHEN c.capital = 0 THEN '' ELSE c.capital::VARCHAR END) AS capital_text
    FROM cases c LEFT JOIN preparation p ON p.case_id = c.id)"""


@query("c4_preparation_defaults", f"WITH {PREPARED} SELECT * FROM prepared")
def _(t):
    return dims.preparation_defaults(t.cases, t.preparation)


@query("c5_proof_defaults", f"""
  WITH {PREPARED},
  placed AS (
    SELECT pr.id, arg_min(b.bureau_code, b.priority) AS bureau_code, arg_min(b.county, b.priority) AS county, any_value(pr.registration_address) AS address
    FROM prepared pr JOIN bureau_county b ON contains(pr.registration_address, b.county) GROUP BY pr.id),
  near AS (
    SELECT p.id, o.office_name, min(o.ordinal) AS ordinal FROM placed p
    JOIN branches o ON o.bureau_code = p.bureau_code AND o.county = p.county AND contains(p.address, o.district) GROUP BY ALL),
  suggested AS (SELECT id, string_agg(office_name, '|' ORDER BY ordinal, office_name) AS names, count(*) AS n FROM near GROUP BY id),
  chosen AS (SELECT id FROM offices WHERE active AND is_default ORDER BY name, id LIMIT 1),
  bureaus AS (
    SELECT pr.id, arg_min(b.short_name, b.priority) AS short_name FROM prepared pr
    JOIN bureau_county b ON contains(pr.registration_address, b.county) GROUP BY pr.id)
  SELECT c.id, coalesce(nullif(s.office_id, 0), (SELECT id FROM chosen)) AS office_id,
    coalesce(nullif(s.page4_office_id, 0), nullif(s.office_id, 0), (SELECT id FROM chosen)) AS page4_office_id,
    coalesce(s.tax_registration_number, '') AS tax_registration_number,
    coalesce(nullif(s.responsible_person_id, ''), pr.national_id) AS responsible_person_id,
    coalesce(nullif(s.business_phone, ''), pr.contact_phone) AS business_phone,
    coalesce(nullif(s.tax_bureau_name, ''), b.short_name, k.short_name, '') AS tax_bureau_name,
    coalesce(nullif(s.official_year, ''), (year(a.approval_date) - 1911)::VARCHAR, '') AS official_year,
    coalesce(nullif(s.official_month, ''), month(a.approval_date)::VARCHAR, '') AS official_month,
    coalesce(nullif(s.official_day, ''), day(a.approval_date)::VARCHAR, '') AS official_day,
    coalesce(nullif(s.application_year, ''), '{AS_OF.year - 1911}') AS application_year,
    coalesce(nullif(s.application_month, ''), '{AS_OF.month}') AS application_month, coalesce(s.application_day, '') AS application_day,
    coalesce(s.email, '') AS email, coalesce(s.sales_document_number, '') AS sales_document_number,
    coalesce(nullif(s.branch_name, ''), CASE WHEN g.n = 1 THEN g.names END, '') AS branch_name,
    CASE WHEN s.case_id IS NULL THEN '1,2,3,4' ELSE coalesce(s.selected_pages, '') END AS selected_pages,
    CASE WHEN s.case_id IS NULL THEN '{dims.DEFAULT_CHECKBOXES}' ELSE coalesce(s.checkboxes, '{{}}') END AS checkboxes, coalesce(b.short_name, '') AS suggested_bureau,
    coalesce(g.names, '') AS suggested_branches, coalesce(g.n, 0) > 1 AS branch_needs_confirmation,
    coalesce(a.status, '') IN ('received', 'archived') AS tax_approval_received
  FROM cases c JOIN prepared pr ON pr.id = c.id LEFT JOIN proofs s ON s.case_id = c.id
    LEFT JOIN approvals a ON a.case_id = c.id AND a.agency = 'national_tax'
    LEFT JOIN bureaus b ON b.id = c.id LEFT JOIN suggested g ON g.id = c.id
    LEFT JOIN (SELECT DISTINCT bureau_code, short_name FROM bureau_county) k ON k.bureau_code = c.tax_bureau_code""")
def _(t):
    # No district is at a boundary here.
    found = dims.proof_defaults(t.cases, t.preparation, t.proofs, t.approvals, t.offices, t.branches, AS_OF, "@")
    pages = F.array_join(F.col("selected_pages").cast("array<string>"), ",").alias("selected_pages")
    rest = [c for c in found.columns if c not in ("selected_pages", "suggested_branches")]
    return found.select(*rest, pages, F.array_join("suggested_branches", "|").alias("suggested_branches"))


@query("c6_approval_grid", """
  SELECT c.id AS case_id, g.agency, coalesce(a.status, 'not_received') AS status, a.approval_date, a.document_number
  FROM cases c CROSS JOIN (VALUES ('city_government'), ('national_tax')) g(agency)
    LEFT JOIN approvals a ON a.case_id = c.id AND a.agency = g.agency""")
def _(t):
    return dims.approval_grid(t.cases, t.approvals)


@query("c6_registration_cards", """
  SELECT c.id AS case_id, coalesce(r.original_received, FALSE) AS original_received,
    coalesce(r.customer_copy_sent, FALSE) AS customer_copy_sent, r.updated_at
  FROM cases c LEFT JOIN cards r ON r.case_id = c.id""")
def _(t):
    return dims.registration_cards(t.cases, t.cards)


ENTRIES_SQL = """
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4
    WHEN 0 THEN printf('e%06d', l_partkey % 1000000) WHEN 1 THEN printf('E%06d  name ', l_partkey % 1000000) || l_suppkey
    WHEN 2 THEN 'plain name ' || l_suppkey ELSE printf('ZZ%05d', l_partkey % 100000) END AS entry
  FROM lineitem"""


def _entries(t):
    part = F.col("l_partkey") % 1000000
    step = F.col("l_linenumber") % 4
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(step == 0, F.format_string("e%06d", part))
        .when(step == 1, F.concat(F.format_string("E%06d  name ", part), F.col("l_suppkey").cast("string")))
        .when(step == 2, F.concat(F.lit("plain name "), F.col("l_suppkey").cast("string")))
        .otherwise(F.format_string("ZZ%05d", F.col("l_partkey") % 100000)).alias("entry"),
    )


SPLIT_SQL = f"""
  split AS (
    SELECT *, upper(regexp_extract(entry, '^([A-Za-z]{{1,2}}[0-9]{{5,6}})\\s*(.*)$', 1)) AS code,
      CASE WHEN regexp_matches(entry, '^[A-Za-z]{{1,2}}[0-9]{{5,6}}')
        THEN trim(regexp_extract(entry, '^([A-Za-z]{{1,2}}[0-9]{{5,6}})\\s*(.*)$', 2)) ELSE trim(entry) END AS own_name
    FROM ({ENTRIES_SQL}))"""


@query("c7_catalogue_lookup", f"""
  WITH {SPLIT_SQL}
  SELECT s.l_orderkey, s.l_linenumber, s.entry, s.code, coalesce(nullif(s.own_name, ''), k.name, '') AS name
  FROM split s LEFT JOIN catalogue k ON k.code = s.code""")
def _(t):
    named = dims.name_entries(_entries(t), t.catalogue)
    return named.select("l_orderkey", "l_linenumber", "entry", "code", "name")


@query("h14_entry_split_format", f"""
  WITH {SPLIT_SQL}
  SELECT l_orderkey, l_linenumber, code, own_name AS name, concat_ws(' ', nullif(code, ''), nullif(own_name, '')) AS formatted
  FROM split""")
def _(t):
    split = _entries(t).withColumn("e", dims.split_entry("entry"))
    return split.select("l_orderkey", "l_linenumber", "e.*", dims.format_entry("e.code", "e.name").alias("formatted"))


@query("c10_address_bureau", f"""
  WITH a AS (SELECT c_custkey AS id, replace({address_sql('c_custkey')}, '臺', '台') AS address FROM customer)
  SELECT a.id, arg_min(b.bureau_code, b.priority) AS bureau_code, arg_min(b.county, b.priority) AS county
  FROM a LEFT JOIN bureau_county b ON contains(replace(a.address, '台', '臺'), b.county) GROUP BY a.id""")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.translate(address_of(F.col("c_custkey")), "臺", "台").alias("address"))
    return rows.withColumn("b", dims.bureau_of("address")).select("id", "b.bureau_code", "b.county")


@query("c10_first_county_in_list", """
  SELECT a.id, arg_min(n.n_name, n.n_nationkey) AS county, arg_min(n.n_regionkey, n.n_nationkey)::VARCHAR AS bureau_code
  FROM regional_addresses a LEFT JOIN nation n ON contains(a.address, n.n_name) GROUP BY a.id""")
def _(t):
    counties = t.nation.select(
        F.col("n_nationkey").alias("priority"), F.col("n_name").alias("county"), F.col("n_regionkey").cast("string").alias("bureau_code")
    )
    found = dims.first_contained(t.regional_addresses, ["id"], F.col("address"), counties, "county", "priority")
    return found.select("id", "county", "bureau_code")


LOCATED = """
  located AS (
    SELECT a.id, a.address, arg_min(n.n_name, n.n_nationkey) AS county,
      arg_min(n.n_regionkey, n.n_nationkey)::VARCHAR AS bureau_code
    FROM regional_addresses a LEFT JOIN nation n ON contains(a.address, n.n_name) GROUP BY ALL)"""


@query("c11_branch_candidates", f"""
  WITH {LOCATED},
  hits AS (
    SELECT l.id, l.address, o.office_name, o.ordinal, o.boundary, count(*) OVER (PARTITION BY l.id) AS n
    FROM located l JOIN regional_offices o
      ON o.bureau_code = l.bureau_code AND o.county = l.county AND contains(l.address, o.district)),
  kept AS (
    SELECT id, office_name, min(ordinal) AS ordinal FROM hits
    WHERE NOT (n > 1 AND contains(address, 'zone 3;') AND contains(address, 'east side') AND boundary <> 'east')
      AND NOT (n > 1 AND contains(address, 'zone 3;') AND contains(address, 'west side') AND boundary <> 'west')
    GROUP BY id, office_name),
  lists AS (SELECT id, string_agg(office_name, '|' ORDER BY ordinal, office_name) AS candidates, count(*) AS n FROM kept GROUP BY id)
  SELECT l.id, l.county, coalesce(k.candidates, '') AS candidates, CASE WHEN k.n = 1 THEN k.candidates ELSE '' END AS branch_name,
    coalesce(k.n, 0) > 1 AS needs_confirmation
  FROM located l LEFT JOIN lists k ON k.id = l.id""")
def _(t):
    counties = t.nation.select(
        F.col("n_nationkey").alias("priority"), F.col("n_name").alias("county"), F.col("n_regionkey").cast("string").alias("bureau_code")
    )
    located = dims.first_contained(t.regional_addresses, ["id"], F.col("address"), counties, "county", "priority")
    hints = {"east side": "east", "west side": "west"}
    found = dims.resolve_branch(located, F.col("address"), t.regional_offices, "zone 3;", hints)
    return found.select(
        "id", "county", F.array_join("branch_candidates", "|").alias("candidates"), "branch_name", "needs_confirmation"
    )


@query("c12_office_options", """
  WITH asked AS (SELECT DISTINCT r_name AS bureau_text, r_regionkey::VARCHAR AS bureau_code FROM region
      JOIN nation ON n_regionkey = r_regionkey
    UNION SELECT DISTINCT r_regionkey::VARCHAR, r_regionkey::VARCHAR FROM region JOIN nation ON n_regionkey = r_regionkey)
  SELECT a.bureau_text, o.office_name, min(o.ordinal) AS ordinal
  FROM asked a JOIN regional_offices o ON o.bureau_code = a.bureau_code GROUP BY 1, 2""")
def _(t):
    code = F.col("r_regionkey").cast("string")
    bureaus = t.region.select(
        code.alias("bureau_code"), F.col("r_name").alias("bureau_name"), F.lower("r_name").alias("short_name")
    )
    asked = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.explode(F.array("r_name", code)).alias("bureau_text")
    )
    return dims.office_options(asked, bureaus, t.regional_offices).orderBy("bureau_text", "ordinal")


@query("c18_postal_codes", f"""
  WITH zips AS (
    SELECT address_key, min(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE printf('%06d', c_custkey % 1000000) END) AS zipcode6,
      min(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE printf('%05d', c_custkey % 100000) END) AS zipcode
    FROM (SELECT c_custkey, {address_sql('c_custkey')} AS address_key FROM customer) GROUP BY address_key)
  SELECT c.id, CASE WHEN regexp_full_match(z.zipcode6, '[0-9]{{6}}') THEN z.zipcode6
    WHEN regexp_full_match(z.zipcode, '[0-9]{{5}}') THEN z.zipcode ELSE '' END AS postal_code
  FROM cases c LEFT JOIN zips z ON z.address_key = nullif(c.address, '')""")
def _(t):
    k = F.col("c_custkey")
    zips = t.customer.groupBy(address_of(k).alias("address_key")).agg(
        F.min(F.when(k % 3 == 0, "").otherwise(F.format_string("%06d", k % 1000000))).alias("zipcode6"),
        F.min(F.when(k % 2 == 0, "").otherwise(F.format_string("%05d", k % 100000))).alias("zipcode"),
    )
    barcoded = t.cases.select(
        "id", F.concat(F.lit(" "), F.replace(F.col("address"), F.lit("測試路"), F.lit("測試路 ")), F.lit("01816913")).alias("address")
    )
    return dims.postal_codes(barcoded, zips).select("id", "postal_code")


@query("f4_catalogue_search", """
  WITH q AS (SELECT * FROM (VALUES ('e00 012', 'E00012'), ('ring', 'RING'), ('red', 'RED'), ('', ''), ('E000017', 'E000017')) v(query, needle)),
  scored AS (
    SELECT q.query, k.code, k.name, CASE WHEN needle = '' THEN 0 WHEN k.code = needle THEN 0 WHEN starts_with(k.code, needle) THEN 1
      WHEN starts_with(k.name, needle) THEN 2 WHEN contains(k.code, needle) THEN 3 WHEN contains(k.name, needle) THEN 4
      WHEN contains(k.category_name, needle) THEN 5 END AS score
    FROM catalogue k, q)
  SELECT query, code, name, score::INT AS score, row_number() OVER (PARTITION BY query ORDER BY score, code)::INT AS place
  FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY score, code) <= 20""")
def _(t):
    found = dims.search_catalogue(t.catalogue, ["e00 012", "ring", "red", "", "E000017"], 20)
    return found.select("query", "code", "name", "score", "place")


# Whole codes, their middles, whole names, the words of names and single letters, of every part.
@query("f4_catalogue_batch", """
  WITH asked AS (SELECT DISTINCT unnest([code, substr(code, 3, 4), upper(name), lower(category_name), substr(name, 1, 1), ' ' || substr(code, 2) || 'x']) AS query FROM catalogue),
  q AS (SELECT query, regexp_replace(upper(query), '\\s+', '', 'g') AS needle FROM asked),
  n AS (SELECT DISTINCT needle FROM q),
  scored AS (
    SELECT n.needle, k.code, CASE WHEN needle = '' THEN 0 WHEN k.code = needle THEN 0 WHEN starts_with(k.code, needle) THEN 1
      WHEN starts_with(k.name, needle) THEN 2 WHEN contains(k.code, needle) THEN 3 WHEN contains(k.name, needle) THEN 4
      WHEN contains(k.category_name, needle) THEN 5 END AS score
    FROM catalogue k, n),
  best AS (SELECT needle, code, score, row_number() OVER (PARTITION BY needle ORDER BY score, code) AS place FROM scored WHERE score IS NOT NULL QUALIFY place <= 20)
  SELECT query, code, score::INT AS score, place::INT AS place FROM q JOIN best USING (needle)""")
def _(t):
    code, name = F.col("code"), F.col("name")
    texts = [code, F.substring(code, 3, 4), F.upper(name), F.lower("category_name"), F.substring(name, 1, 1), F.concat(F.lit(" "), F.substr(code, F.lit(2)), F.lit("x"))]
    queries = t.catalogue.select(F.explode(F.array(*texts)).alias("query"))
    return dims.search_catalogue(t.catalogue, queries, 20).select("query", "code", "score", "place")



@query("h7_address_forms", f"""
  WITH a AS (SELECT c_custkey AS id, '406 ' || replace({address_sql('c_custkey')}, '臺', '台') AS raw FROM customer)
  SELECT id, replace(replace(raw, ' ', ''), '台', '臺') AS tax_form,
    replace(replace(replace(replace(substr(replace(raw, ' ', ''), 4), '台北市', '臺北市'), '台中市', '臺中市'), '台南市', '臺南市'),
      '台東縣', '臺東縣') AS document_form,
    replace(replace(raw, ' ', ''), '台', '臺') AS card_form
  FROM a""")
def _(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("406 "), F.translate(address_of(F.col("c_custkey")), "臺", "台")).alias("raw"),
    )
    return rows.select(
        "id", tax_address("raw").alias("tax_form"),
        document_address(F.concat("raw", F.lit("；之後（x"))).alias("document_form"),
        card_address(F.concat(F.lit("戶籍地址："), "raw", F.lit(" ，12345"))).alias("card_form"),
    )


@query("h8_postal_key", f"""
  SELECT c_custkey AS id, {address_sql('c_custkey')} AS address_key FROM customer""")
def _(t):
    raw = F.concat(F.lit("　"), address_of(F.col("c_custkey")), F.lit(" 12345678 9"))
    return t.customer.select(F.col("c_custkey").alias("id"), postal_key(raw).alias("address_key"))
