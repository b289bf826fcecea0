"""Landed-page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import html as h
from caseflow.plans.inputs import pick
from caseflow.plans.inputs_sql import pick as pick_sql
from caseflow.plans.merge_queries import STATUS_RULES
from caseflow.plans.registry import query
from caseflow.sources.tables import page_text_from_bytes


def plain_sql(html: str) -> str:
    """The plain text of HTML without numeric entities, which the given pages do not hold."""
    steps = [
        (r"(?is)<script\b[^>]*>.*?</script>", "' '"), (r"(?is)<style\b[^>]*>.*?</style>", "' '"), (r"(?i)<br\s*/?>", "chr(10)"),
        (r"(?i)</(?:p|div|li|tr|th|td|h[0-9])>", "chr(10)"), (r"<[^>]+>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"),
        ("(?i)&quot;", "'\"'"), ("(?i)&apos;|&#39;", "''''"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"), (r"[\t\r ]+", "' '"),
        (r" *\n+ *", "chr(10)"), (r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", "''"),
    ]
    for pattern, replacement in steps:
        html = f"regexp_replace({html}, '{pattern}', {replacement}, 'g')"
    return html


def flat_sql(html: str) -> str:
    return f"trim(regexp_replace({plain_sql(html)}, '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g'))"


# Numeric entities and what one pass over each of their two forms makes of them.
NUMERIC = "&#38;#60; &#60;&#x41;&#X3c3; &#0; &#1114112; &#36;1&#92;"
NUMERIC_READ = "&#60; <Aσ &#0; &#1114112; $1\\"


@query("h16_plain_text", f"SELECT page_id, replace({plain_sql("(html || '<p>@numeric@</p>')")}, '@numeric@', '{NUMERIC_READ}') AS text FROM pages")
def _(t):
    html = F.concat("html", F.lit(f"<p>{NUMERIC}</p>"))
    return t.pages.select("page_id", h.plain_text(html).alias("text"))


CELLS_SQL = f"""
  r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1)) AS body,
    generate_subscripts(regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1), 1) - 1 AS row_no FROM pages),
  c AS (SELECT page_id, row_no::INT AS row_no, unnest(regexp_extract_all(body, '(?is)<(?:li)\\b[^>]*>(.*?)</(?:li)>', 1)) AS raw,
    (generate_subscripts(regexp_extract_all(body, '(?is)<(?:li)\\b[^>]*>(.*?)</(?:li)>', 1), 1) - 1)::INT AS cell_no FROM r),
  cells AS (SELECT page_id, row_no, cell_no, {flat_sql('raw')} AS cell FROM c)"""


@query("k1_table_rows", f"WITH {CELLS_SQL} SELECT * FROM cells")
def _(t):
    return h.table_rows(t.pages, "page_id", "ul", "li")


@query("k2_label_pairs", f"""
  WITH {CELLS_SQL},
  pairs AS (
    SELECT a.page_id, a.row_no, a.cell_no, trim(regexp_replace(a.cell, '[：:]$', '')) AS label, trim(b.cell) AS value FROM cells a
    JOIN cells b ON a.page_id = b.page_id AND a.row_no = b.row_no AND b.cell_no = a.cell_no + 1 WHERE a.cell_no % 2 = 0 AND a.cell <> '')
  SELECT p.page_id, count(c.label) AS pair_count,
    coalesce(arg_min(c.value, c.row_no * 1000000 + c.cell_no) FILTER (regexp_matches(c.label, 'e') AND c.value <> ''), '') AS first_e
  FROM pages p LEFT JOIN pairs c ON c.page_id = p.page_id GROUP BY p.page_id""")
def _(t):
    pairs = t.pages.select("page_id", h.label_pairs(h.row_cells(F.col("html"), "ul", "li")).alias("p"))
    return pairs.select("page_id", F.size("p").cast("long").alias("pair_count"), h.pick_field(F.col("p"), "e").alias("first_e"))


K3_STATUS = ["審查中", "可自領", "發文中", ""]


def _detail_pages(t):
    """A landed detail page for every case, with and without a status, receipt and company row."""
    k = F.col("id")
    row = lambda label, value: F.concat(F.lit(f"<tr><th class=x>{label}</th>\n<td>"), value, F.lit("</td></tr>"))
    body = F.concat(
        row("處理進度(註)：", F.concat(F.lit("<b>"), pick(K3_STATUS, k), F.lit("</b>&nbsp;"))),
        F.when(k % 3 == 0, "").otherwise(row("收文號", F.concat(F.lit(" "), "case_number", F.lit("號")))),
        F.when(k % 5 == 0, row("公司名稱", F.lit(" "))).otherwise(row("公司名稱：", F.concat("company_name", F.lit(" &amp; Co")))),
        F.lit("<TR><TD>收文日期</TD><TD>"), F.col("received_date").cast("string"), F.lit("</TD><TD>主旨</TD><TD>設立<br>登記</TD></TR>"),
    )
    url = F.concat(F.lit("https://example.org/detail.do?rcvNo="), "tax_id", F.lit("&regUnitCode=17&agency=A%2F1"))
    return t.cases.select(
        k.alias("page_id"), url.alias("url"), F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"),
        F.lit("<i>fallback</i> name").alias("fallback_name"),
    )


@query("k3_detail_records", f"""
  WITH d AS (SELECT *, {pick_sql(K3_STATUS, 'id')} AS s FROM cases)
  SELECT id AS page_id, CASE WHEN id % 3 = 0 THEN tax_id ELSE case_number END AS receipt_no,
    CASE WHEN id % 5 = 0 THEN 'fallback name' ELSE company_name || ' & Co' END AS company_name, received_date::VARCHAR AS received_date,
    s AS official_status, {STATUS_RULES.format('s')} AS app_status, '設立 登記' AS subject, 'A/1' AS agency_code, '17' AS reg_unit_code
  FROM d WHERE s <> ''""")
def _(t):
    good, _ = h.detail_records(_detail_pages(t))
    return good.select(
        "page_id", "receipt_no", "company_name", "received_date", "official_status", "app_status", "subject", "agency_code", "reg_unit_code"
    )


@query("k3_layout_errors", f"SELECT id AS page_id FROM cases WHERE {pick_sql(K3_STATUS, 'id')} = ''")
def _(t):
    _, failed = h.detail_records(_detail_pages(t))
    return failed.select("page_id")


@query("k4_link_candidates", f"""
  WITH m AS (
    SELECT page_id, url, html, regexp_extract_all(html, '(?is)<(?:a|button)\\b([^>]*)>(.*?)</(?:a|button)>') AS ms,
      string_split_regex(html, '(?is)<(?:a|button)\\b[^>]*>.*?</(?:a|button)>') AS ps FROM pages),
  u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
  spans AS (SELECT page_id, url, html, ms[i] AS hit, (list_sum(list_transform(ps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS start FROM u),
  links AS (SELECT *, regexp_extract(hit, 'href="(/[^\\s"'']+)', 1) AS path,
    {flat_sql('substr(html, greatest(start - 900, 0) + 1, start + length(hit) + 900 - greatest(start - 900, 0))')} AS context FROM spans),
  scored AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || path AS link, start AS place,
    1 + CASE WHEN contains(context, 'ththre') THEN 12 ELSE 0 END + CASE WHEN contains(context, 'Que la') THEN 8 ELSE 0 END AS score
    FROM links WHERE path <> '')
  SELECT page_id, link, score, place FROM scored QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY score DESC, place) = 1""")
def _(t):
    pages = t.pages.select(
        "page_id", "url", "html", F.lit("公司").alias("entity_type"), F.lit("ththre").alias("tax_id"), F.lit("Que la").alias("company_name")
    )
    return h.link_candidates(pages, r"""/[^\s"']+""", "ul", "li")


@query("k5_tag_attributes", """
  WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z]+ ([^>]*)>', 1)) AS tag FROM pages)
  SELECT page_id, tag, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, regexp_extract(tag, 'charset="([^"]*)"', 1) AS charset,
    regexp_extract(tag, 'class="([^"]*)"', 1) AS class FROM a""")
def _(t):
    tags = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<[a-z]+ ([^>]*)>"), F.lit(1))).alias("tag"))
    mapped = tags.withColumn("m", h.tag_attributes(F.col("tag")))
    value = lambda name: F.coalesce(F.col("m")[name], F.lit("")).alias(name)
    return mapped.select("page_id", "tag", value("href"), value("charset"), value("class"))


@query("a9_tax_payload", """
  WITH p AS (SELECT o_orderkey AS id, o_orderkey % 4 AS form, printf('%08d', o_custkey % 100000000) AS tax_id,
    printf('%010d', o_orderkey) AS receipt, 'type "x"' AS case_type FROM orders)
  SELECT id, 0 AS row_no, tax_id, 'name' AS business_name, '87/01/05' AS received_date, receipt AS receipt_no, case_type, '審核中' AS official_status, FALSE AS truncated
  FROM p WHERE form IN (0, 3)
  UNION ALL SELECT id, 2, tax_id, '', '', '', '', '已發文', FALSE FROM p WHERE form = 3""")
def _(t):
    k = F.col("o_orderkey")
    row = lambda *v: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v])
    tax_id, receipt = F.format_string(" %08d", F.col("o_custkey") % 100000000), F.format_string("%010d", k)
    full = row(tax_id, "name", "87/01/05", receipt, 'type "x"', "審核中")
    payload = (
        F.when(k % 4 == 0, F.to_json(F.array(full))).when(k % 4 == 1, '"N"').when(k % 4 == 2, F.lit(None))
        .otherwise(F.to_json(F.array(full, row(tax_id, "blank", "", " ", "x", ""), row(tax_id, "", "", "", "", "已發文"))))
    )
    return h.tax_payload_rows(t.orders.select(k.alias("id"), payload.alias("payload")), "id")


@query("a10_decoded_pages", """
  WITH p AS (SELECT *, (['utf-8', 'iso-8859-1', 'windows-1252'])[page_id % 3 + 1] AS charset FROM pages)
  SELECT page_id, charset, replace(html, '"utf-8"', '"' || charset || '"') AS html FROM p""")
def _(t):
    charset = pick(["utf-8", "iso-8859-1", "windows-1252"], F.col("page_id"))
    html = F.replace(F.col("html"), F.lit('"utf-8"'), F.concat(F.lit('"'), charset, F.lit('"')))
    # The pages' letters are the same bytes in both Western charsets; Spark itself cannot write the last one.
    content = F.when(F.col("page_id") % 3 == 0, F.encode(html, "UTF-8")).otherwise(F.encode(html, "ISO-8859-1"))
    return page_text_from_bytes(t.pages.select("page_id", content.alias("content"))).select("page_id", "charset", "html")
