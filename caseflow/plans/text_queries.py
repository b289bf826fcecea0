"""Page-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import pages as p
from caseflow.operators.ranking import numbered
from caseflow.plans.inputs import national_id_of
from caseflow.plans.inputs_sql import national_id_sql_valid as id_valid_sql
from caseflow.plans.inputs_sql import national_id_of as national_id_sql
from caseflow.plans.registry import query

# The documents hold Latin text, so these queries run the same jobs with Latin patterns and words.
PATTERN = r"[a-z]{2,12} (?:the|and|of|la|de) [a-z]{2,12}"
TARGETS = ["the of", "tion", "les"]
NEGATIVES = ["ou ", "is "]
SETTINGS = dict(
    pattern=PATTERN, targets=TARGETS, negatives=NEGATIVES, person_terms="that|une", numbered_part="[aeo]n", min_length=8,
    normalise=lambda c: F.replace(c, F.lit(" "), F.lit("")),
)

SPANS_SQL = f"""
  m AS (SELECT file_id, page, text, regexp_extract_all(text, '{PATTERN}') AS ms, string_split_regex(text, '{PATTERN}') AS ps FROM page_text),
  u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
  spans AS (
    SELECT file_id, page, text, ms[i] AS hit,
      (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS start
    FROM u),
  evidence AS (
    SELECT file_id, page, start, replace(hit, ' ', '') AS address,
      trim(regexp_replace(substr(text, greatest(start - 28, 0) + 1, start + length(hit) + 28 - greatest(start - 28, 0)), '\\s+', ' ', 'g')) AS evidence
    FROM spans),
  found AS (
    SELECT *, (35 + least(20, length(address)) + 35 * ({' + '.join(f"contains(evidence, '{w}')::INT" for w in TARGETS)})
      - 42 * ({' + '.join(f"contains(evidence, '{w}')::INT" for w in NEGATIVES)})
      + CASE WHEN regexp_matches(address, '[aeo]n') THEN 12 ELSE 0 END
      - CASE WHEN regexp_matches(evidence, 'that|une') THEN 35 ELSE 0 END)::INT AS score
    FROM evidence WHERE length(address) >= 8),
  best AS (SELECT *, CASE WHEN score >= 85 THEN '高' WHEN score >= 55 THEN '中' ELSE '低' END AS confidence FROM found
    QUALIFY row_number() OVER (PARTITION BY file_id, address ORDER BY score DESC, page, start) = 1)"""


@query("i1_address_candidates", f"""
  WITH {SPANS_SQL}
  SELECT file_id, page, start, address, evidence, score, CASE WHEN score >= 85 THEN '高' WHEN score >= 55 THEN '中' ELSE '低' END AS confidence
  FROM found""")
def _(t):
    return p.address_candidates(t.page_text, **SETTINGS)


@query("e7_best_candidates", f"WITH {SPANS_SQL} SELECT file_id, address, page, start, score, confidence FROM best")
def _(t):
    best = p.best_candidates(p.address_candidates(t.page_text, **SETTINGS))
    return best.select("file_id", "address", "page", "start", "score", "confidence")


@query("f7_candidate_ranking", f"""
  WITH {SPANS_SQL}
  SELECT file_id, address, score, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, page, start, address) AS place
  FROM best""")
def _(t):
    best = p.best_candidates(p.address_candidates(t.page_text, **SETTINGS))
    return numbered(best, ["file_id"], p.candidate_rank_order(), "place", -F.col("score")).select("file_id", "address", "score", "place")


TYPES = [
    ("lease", "Lease", ["tion", "the of", "que"]),
    ("tax", "Tax", ["Ou", "The", "La"]),
    ("plan", "Plan", ["mentre", "ver", "eau"]),
]
CHECKLIST = "Dans|Und"

HITS_SQL = f"""
  words AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{label}', {n}, '{w}')" for k, label, ws in TYPES for n, w in enumerate(ws))})
    v(key, label, nth, word)),
  word_hits AS (
    SELECT p.file_id, p.page, w.* FROM page_text p JOIN words w ON contains(p.text, w.word)
    WHERE w.key = 'lease' OR NOT regexp_matches(p.text, '{CHECKLIST}')),
  hits AS (
    SELECT file_id, page, key, label, count(*) AS n, least(100, count(*) * 35)::INT AS score, string_agg(word, '、' ORDER BY nth) AS evidence
    FROM word_hits GROUP BY ALL)"""
TYPE_SETTINGS = dict(definitions=TYPES, checklist=CHECKLIST, exempt="lease")


@query("i2_page_types", f"""
  WITH {HITS_SQL}
  SELECT file_id, page, key, evidence, score, CASE WHEN n >= 2 THEN '高' ELSE '低' END AS confidence FROM hits""")
def _(t):
    hits = p.detect_page_types(t.page_text, **TYPE_SETTINGS)
    return hits.select("file_id", "page", "key", F.array_join("matched", "、").alias("evidence"), "score", "confidence")


RANGES_SQL = """
  runs AS (
    SELECT {keys}, min(page) AS a, max(page) AS b FROM (
      SELECT {keys}, page, page - row_number() OVER (PARTITION BY {keys} ORDER BY page) AS run
      FROM (SELECT DISTINCT {keys}, page FROM {source}))
    GROUP BY {keys}, run),
  ranges AS (
    SELECT {keys}, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS page_range FROM runs GROUP BY {keys})"""

DOCUMENT_SQL = f"""
  {HITS_SQL}, {RANGES_SQL.format(keys='file_id, key', source='hits')},
  first_words AS (SELECT file_id, key, word, min(page) AS page, any_value(nth) AS nth FROM word_hits GROUP BY file_id, key, word),
  evidence AS (SELECT file_id, key, string_agg(word, '、' ORDER BY page, nth) AS evidence FROM first_words GROUP BY file_id, key),
  documents_found AS (
    SELECT h.file_id, h.key, any_value(h.label) AS label, max(h.score) AS score, any_value(r.page_range) AS page_range,
      any_value(e.evidence) AS evidence, CASE WHEN max(h.score) >= 70 THEN '高' ELSE '低' END AS confidence
    FROM hits h JOIN ranges r USING (file_id, key) JOIN evidence e USING (file_id, key) GROUP BY h.file_id, h.key)"""


@query("d6_document_types", f"WITH {DOCUMENT_SQL} SELECT file_id, key, label, score, page_range, evidence, confidence FROM documents_found")
def _(t):
    return p.document_types(t.page_text, **TYPE_SETTINGS).select(
        "file_id", "key", "label", "score", "page_range", "evidence", "confidence"
    )


@query("e5_page_ranges", f"""
  WITH {RANGES_SQL.format(keys='file_id', source='page_text')}
  SELECT file_id, page_range FROM ranges""")
def _(t):
    return p.page_ranges(t.page_text, ["file_id"])


@query("g3_distinct_pages", "SELECT DISTINCT user_id AS case_id, event_type AS kind FROM events UNION SELECT DISTINCT conv_id, role FROM conversations")
def _(t):
    events = t.events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("kind"))
    return events.unionByName(t.conversations.select(F.col("conv_id").alias("case_id"), F.col("role").alias("kind"))).distinct()


@query("e6_parse_page_range", """
  WITH r AS (
    SELECT o_orderkey AS id, o_orderkey % 20 + 3 AS page_count, o_orderkey % 4 + 1 AS a, o_orderkey % 4 + 1 + o_orderkey % 7 AS b, o_orderkey % 5 AS form FROM orders)
  SELECT id, CASE WHEN form = 0 THEN 'blank' WHEN form = 1 THEN 'format' WHEN b > page_count THEN 'range' END AS error,
    CASE WHEN form >= 2 AND b <= page_count THEN array_to_string(list_distinct_sorted, ',') END AS pages
  FROM (SELECT *, list_sort(list_distinct(list_concat(range(a, b + 1), [2::BIGINT]))) AS list_distinct_sorted FROM r)""")
def _(t):
    k = F.col("o_orderkey")
    a, b = (k % 4 + 1).cast("string"), (k % 4 + 1 + k % 7).cast("string")
    text = F.when(k % 5 == 0, "  ").when(k % 5 == 1, F.concat(a, F.lit("-x"))).otherwise(F.concat(a, F.lit("-"), b, F.lit(", 2 ,"), a))
    ranges = t.orders.select(k.alias("id"), p.parse_page_range(text, k % 20 + 3).alias("r"))
    return ranges.select("id", "r.error", F.array_join(F.col("r.pages").cast("array<string>"), ",").alias("pages"))


@query("g2_replace_by_source", """
  SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de' AND n_chars > 2000)
  UNION ALL SELECT doc_id, source, 0 FROM documents WHERE lang = 'de' AND n_chars > 2000""")
def _(t):
    current = t.documents.select("doc_id", "source", "n_chars")
    fresh = t.documents.filter("lang = 'de' AND n_chars > 2000").select("doc_id", "source", F.lit(0).cast("long").alias("n_chars"))
    return p.replace_by_source(current, fresh, "source")


FILES_SQL = """
  files AS (
    SELECT conv_id AS file_id, CASE conv_id % 6 WHEN 0 THEN 'docx' WHEN 1 THEN 'png' ELSE 'pdf' END AS suffix,
      conv_id % 9 * 4000000 AS size_bytes, CASE WHEN conv_id % 8 = 3 THEN 30 ELSE count(*) END AS page_count FROM conversations GROUP BY conv_id)"""


def _files(t):
    k = F.col("conv_id")
    counted = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        k.alias("file_id"), F.when(k % 6 == 0, "docx").when(k % 6 == 1, "png").otherwise("pdf").alias("suffix"),
        (k % 9 * 4000000).alias("size_bytes"), F.when(k % 8 == 3, 30).otherwise(F.col("n")).alias("page_count"),
    )


@query("b13_ocr_routing", f"""
  WITH {SPANS_SQL}, {FILES_SQL},
  lengths AS (SELECT file_id, sum(length(trim(text, ' ')))::BIGINT AS text_length FROM page_text GROUP BY file_id),
  scores AS (SELECT file_id, max(score) AS best_score FROM best GROUP BY file_id)
  SELECT f.file_id, l.text_length, CASE WHEN suffix = 'docx' THEN 'manual' WHEN size_bytes > 26214400 THEN 'too_large'
    WHEN suffix = 'pdf' AND page_count > 25 THEN 'too_many_pages' WHEN suffix <> 'pdf' THEN 'ocr'
    WHEN l.text_length < 80 OR NOT coalesce(s.best_score >= 55, FALSE) THEN 'ocr' ELSE 'text_layer' END AS route
  FROM files f LEFT JOIN lengths l USING (file_id) LEFT JOIN scores s USING (file_id)""")
def _(t):
    best = p.best_candidates(p.address_candidates(t.page_text, **SETTINGS))
    scores = best.groupBy("file_id").agg(F.max("score").alias("best_score"))
    return p.ocr_routing(_files(t), t.page_text, scores)


@query("b14_text_layer_pages", """
  SELECT conv_id AS file_id, turn + 1 AS page, CASE WHEN role = 'system' THEN 'skipped_category' WHEN turn + 1 > 5 THEN 'beyond_limit'
    WHEN length(regexp_replace(text, '\\s+', '', 'g')) >= 120 THEN 'text_layer' ELSE 'ocr' END AS outcome FROM conversations""")
def _(t):
    pages = t.conversations.select(
        F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), "text", F.col("role").alias("category")
    )
    return p.needs_ocr(pages, ["system"], 5).select("file_id", "page", "outcome")


@query("c17_export_plan", f"""
  WITH {DOCUMENT_SQL}, {FILES_SQL},
  judged AS (
    SELECT d.*, f.suffix, f.page_count, d.confidence = '高' OR (d.key = 'tax' AND d.file_id % 3 <> 1) AS approved
    FROM documents_found d JOIN files f USING (file_id) WHERE NOT (d.key = 'plan' AND d.file_id % 3 = 0)),
  state AS (
    SELECT file_id, bool_or(approved AND suffix = 'pdf') AS split, bool_or(confidence = '低' AND NOT approved) AS open FROM judged GROUP BY file_id)
  SELECT file_id, label || '.pdf' AS name, page_range FROM judged WHERE approved AND suffix = 'pdf'
  UNION ALL SELECT f.file_id, f.file_id || '.' || f.suffix, '' FROM files f LEFT JOIN state s USING (file_id)
  WHERE NOT coalesce(s.split, FALSE) OR coalesce(s.open, FALSE)""")
def _(t):
    detections = p.document_types(t.page_text, **TYPE_SETTINGS).select("file_id", "key", "label", "page_range", "confidence")
    third = F.col("file_id") % 3
    decision = F.when((F.col("key") == "plan") & (third == 0), "dismissed").when((F.col("key") == "tax") & (third != 1), "confirmed")
    decisions = detections.select("file_id", "key", "page_range", decision.alias("decision")).filter("decision IS NOT NULL")
    return p.export_plan(detections, decisions, _files(t))


@query("i3_labelled_fields", """
  WITH d AS (SELECT doc_id AS file_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
  u AS (SELECT file_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d),
  v AS (
    SELECT file_id, i, coalesce(nullif(regexp_extract(regexp_replace(lines[i], '^.*?(?:(?:the|la) )', ''), '^[a-z]{5,}', 0), ''),
      nullif(regexp_extract(coalesce(lines[i + 1], ''), '^[a-z]{5,}', 0), '')) AS value FROM u WHERE regexp_matches(lines[i], '(?:the|la) '))
  SELECT d.file_id, coalesce(arg_min(v.value, v.i), '') AS value FROM d LEFT JOIN v ON v.file_id = d.file_id AND v.value IS NOT NULL GROUP BY d.file_id""")
def _(t):
    word = lambda c: F.regexp_extract(c, "^[a-z]{5,}", 0)
    files = t.documents.select(F.col("doc_id").alias("file_id"), p.text_lines(F.col("text")).alias("lines"))
    return files.select("file_id", F.coalesce(p.labelled_line(F.col("lines"), "(?:the|la) ", word), F.lit("")).alias("value"))


def _certificates(t):
    """A pre-check certificate page for every order, in one of four layouts."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    y, m, n = F.year(d) - 1911, F.month(d), F.dayofmonth(d)
    number = F.format_string("1%02d%06d", y % 100, k % 1000000)
    spaced = F.concat(F.substring(number, 1, 3), F.lit(" - "), F.substring(number, 4, 6))
    form = k % 4
    text = (
        F.when(form == 0, F.concat(
            F.lit("公司名稱預查核定書\n預查編號："), spaced, F.lit("\n核准日期：民國 "), y.cast("string"), F.lit(" 年 "), m.cast("string"),
            F.lit(" 月 "), n.cast("string"), F.lit(" 日\n保留期限\n"), F.format_string("1%02d/%02d/%02d", y % 100, m, n),
            F.lit("\n公司名稱： 測試"), F.lit("股份有限公司 "), F.lit("\n1. E599010 配管工程業 F113020電器批發業\n2. ZZ99999\n除許可業務外，得經營法令非禁止或限制之業務\nE599010 重複業")))
        .when(form == 1, F.concat(F.lit("預查\n號碼 "), number, F.lit("\n發文日期"), F.format_string("%03d%02d%02d", y, m, n), F.lit("\n核准公司名稱\n甲乙有限公司")))
        .when(form == 2, F.concat(F.lit("預查編號：079123456\n核定日期：113/02/30\n公司名稱：申請書有限公司\n")))
        .otherwise(F.concat(F.lit("無標籤 "), number, F.lit(" 文字")))
    )
    return t.orders.select(k.alias("file_id"), text.alias("text"))


CERTIFICATES = """
  c AS (SELECT o_orderkey AS file_id, o_orderkey % 4 AS form, year(o_orderdate) - 1911 AS y, month(o_orderdate) AS m, day(o_orderdate) AS n FROM orders),
  e AS (SELECT *, printf('1%02d%06d', y % 100, file_id % 1000000) AS number, printf('%03d/%02d/%02d', y, m, n) AS day_text FROM c),
  v AS (SELECT *, substr(number, 1, 3)::INT BETWEEN 80 AND 199 AND substr(number, 4) <> '000000' AS ok FROM e)"""


@query("i4_precheck_records", f"""
  WITH {CERTIFICATES}
  SELECT file_id, CASE WHEN form IN (0, 1) AND ok THEN number ELSE '' END AS precheck_number,
    CASE WHEN form IN (0, 1) THEN day_text ELSE '' END AS approval_date,
    CASE WHEN form = 0 AND try_cast(printf('%04d-%02d-%02d', y % 100 + 2011, m, n) AS DATE) IS NOT NULL THEN printf('1%02d/%02d/%02d', y % 100, m, n) ELSE '' END AS expiry_date,
    CASE form WHEN 0 THEN '測試股份有限公司' WHEN 1 THEN '甲乙有限公司' WHEN 2 THEN '申請書有限公司' ELSE '' END AS company_name
  FROM v""")
def _(t):
    return p.precheck_records(_certificates(t)).drop("business_items")


@query("i5_business_items", """
  SELECT o_orderkey AS file_id, code, name FROM orders JOIN (VALUES ('E599010', '配管工程業'), ('F113020', '電器批發業'),
    ('ZZ99999', '除許可業務外，得經營法令非禁止或限制之業務')) v(code, name) ON o_orderkey % 4 = 0""")
def _(t):
    items = p.precheck_records(_certificates(t)).select("file_id", F.explode("business_items").alias("i"))
    return items.select("file_id", "i.code", "i.name")


@query("i6_identity_text", f"""
  WITH d AS (SELECT o_orderkey AS file_id, {national_id_sql('o_orderkey')} AS code, o_orderkey % 5 AS form FROM orders)
  SELECT file_id, CASE WHEN {id_valid_sql('code')} THEN code ELSE 'A123456789' END AS national_id,
    CASE form WHEN 0 THEN '王小明' WHEN 1 THEN '陳俞欣' WHEN 2 THEN '' WHEN 3 THEN '林大文' ELSE '' END AS name FROM d""")
def _(t):
    k = F.col("o_orderkey")
    code = national_id_of(k)
    spaced = F.lower(F.concat(F.substring(code, 1, 1), F.lit(" "), F.substring(code, 2, 4), F.lit("-"), F.substring(code, 6, 5)))
    body = (
        F.when(k % 5 == 0, "姓 名：王小明 出生 民國80年").when(k % 5 == 1, "姓名\n陳俞欣").when(k % 5 == 2, "地址 姓名路一號 姓名")
        .when(k % 5 == 3, "姓名路 123 林一二\r姓名：林大文").otherwise("無資料")
    )
    fixed = F.when(k % 5 == 3, "姓名：出生地址\n姓名：林大文").otherwise(body)
    text = F.concat(fixed, F.lit("\n統一編號 "), spaced, F.lit("\nA123456788 B1 A123456789"))
    return p.identity_records(t.orders.select(k.alias("file_id"), text.alias("text")))


@query("i7_approval_fields", """
  WITH d AS (SELECT o_orderkey AS id, o_orderkey % 4 AS form, o_orderdate AS d FROM orders)
  SELECT id, CASE WHEN form = 3 THEN '' ELSE '府授經登字第' || id || '號' END AS document_number,
    CASE form WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') ELSE '' END AS approval_date FROM d""")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    number = F.concat(F.lit("發文字號：府授經登字第"), k.cast("string"), F.lit("號，"))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("中華民國"), (F.year(d) - 1911).cast("string"), F.lit("年 "), F.month(d).cast("string"),
                                    F.lit(" 月"), F.dayofmonth(d).cast("string"), F.lit("日 "), number))
        .when(k % 4 == 1, F.concat(number, F.date_format(d, "yyyy/M/d"), F.lit(" 止")))
        .when(k % 4 == 2, F.concat(number, F.lit("113年2月30日")))
        .otherwise("沒有")
    )
    return t.orders.select(k.alias("id"), p.approval_fields(text).alias("a")).select("id", "a.*")
