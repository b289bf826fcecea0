"""OCR-token queries. Tokens are laid out from conversation words and from order columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.udfs import similarity
from caseflow.operators import layout
from caseflow.operators.ranking import shuffled
from caseflow.plans.inputs import AS_OF, dealt, national_id_of
from caseflow.plans.inputs_sql import national_id_of as national_id_sql
from caseflow.plans.inputs_sql import national_id_sql_valid
from caseflow.plans.registry import query


def _words(t):
    """Words of every conversation turn as tokens: one text line per row, 60 units per word."""
    page = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    lines = t.conversations.select(page.alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    words = lines.select("page_id", "line", F.posexplode(F.split("body", " ")).alias("place", "text")).filter("text <> ''")
    x0, y0 = (F.col("place") * 60).cast("double"), (F.col("line") * 25).cast("double")
    size = F.length("text").cast("double")
    return words.select(
        "page_id", (F.col("line") * 10000 + F.col("place")).cast("long").alias("ord"), "text", (size % 7 / 10 + 0.3).alias("score"),
        x0.alias("x0"), y0.alias("y0"), (x0 + size * 5).alias("x1"), (y0 + 10 + size % 3 * 4).alias("y1"),
    )


WORDS = """
  l AS (SELECT conv_id || '-' || turn AS page_id, unnest(string_split(text, chr(10))) AS body,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations),
  w AS (SELECT page_id, line, unnest(string_split(body, ' ')) AS text, generate_subscripts(string_split(body, ' '), 1) - 1 AS place FROM l),
  tokens AS (
    SELECT page_id, line * 10000 + place AS ord, text, length(text)::DOUBLE % 7 / 10 + 0.3 AS score, (place * 60)::DOUBLE AS x0, (line * 25)::DOUBLE AS y0,
      (place * 60)::DOUBLE + length(text) * 5 AS x1, (line * 25)::DOUBLE + 10 + length(text) % 3 * 4 AS y1 FROM w WHERE text <> ''),
  g AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(1.0, y1 - y0) AS h FROM tokens)"""


@query("c14_near_label", f"""
  WITH {WORDS},
  p AS (
    SELECT t.page_id, a.ord AS label_ord, t.ord, abs(t.cy - a.cy) AS v, t.cx - a.cx AS dx, t.cy - a.cy AS dy, greatest(a.h, t.h) AS mh, a.h AS ah
    FROM g a JOIN g t ON t.page_id = a.page_id AND t.ord <> a.ord WHERE contains(a.text, 'tion')),
  d AS (SELECT *, CASE WHEN v <= mh * 1.3 AND dx >= 0 THEN dx + v * 2 WHEN dy > 0 AND dy <= ah * 3.5 THEN dy + abs(dx) * 0.4 END AS distance FROM p)
  SELECT page_id, label_ord, ord, round(distance, 4) AS distance FROM d WHERE distance IS NOT NULL""")
def _(t):
    near = layout.near_label(layout.with_geometry(_words(t)), ["tion"])
    return near.select("page_id", F.col("a_ord").alias("label_ord"), "ord", F.round("distance", 4).alias("distance"))


VALUES = f"""{WORDS},
  labels AS (SELECT page_id, arg_min(g, ord) AS a FROM g WHERE contains(text, 'que') OR contains(text, 'the') GROUP BY page_id),
  placed AS (
    SELECT t.*, l.a, CASE WHEN abs(l.a.cy - t.cy) <= greatest(l.a.h, t.h) * 0.9 AND t.x0 >= l.a.x1 - greatest(6.0, l.a.h * 0.3) THEN 0
      WHEN t.cy > l.a.y1 AND t.cy <= l.a.y1 + l.a.h * 4 AND t.x0 >= l.a.x0 - l.a.h * 2 THEN 1 END AS side
    FROM g t JOIN labels l ON l.page_id = t.page_id AND t.ord <> l.a.ord),
  used AS (SELECT page_id, min(side) AS use, min(cy) FILTER (side = 1) AS first_y FROM placed WHERE side IS NOT NULL GROUP BY page_id),
  chosen AS (SELECT p.* FROM placed p JOIN used u USING (page_id) WHERE p.side = u.use AND (u.use = 0 OR abs(p.cy - u.first_y) <= greatest(p.h, p.a.h))),
  gaps AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY page_id ORDER BY x0, ord) > greatest({{gap}}, a.h * {{heights}}), FALSE) AS wide FROM chosen),
  cut AS (SELECT *, bool_or(wide) OVER (PARTITION BY page_id ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS beyond FROM gaps)"""


def _first_labels(t):
    placed = layout.with_geometry(_words(t))
    found = placed.filter(F.contains("text", F.lit("que")) | F.contains("text", F.lit("the")))
    first = found.groupBy("page_id").agg(F.min_by(F.struct(*layout.TOKEN), "ord").alias("l"))
    return placed, first.select("page_id", F.lit("word").alias("field"), F.lit(1.0).alias("match_score"), "l.*")


@query("c15_value_tokens", f"WITH {VALUES.format(gap='180.0', heights='10')} SELECT page_id, ord, text FROM cut WHERE NOT beyond")
def _(t):
    return layout.value_tokens(*_first_labels(t)).select("page_id", "ord", "text")


@query("e8_gap_cut", f"""
  WITH {VALUES.format(gap='180.0', heights='10')}
  SELECT page_id, count(*) AS token_count, string_agg(text, '' ORDER BY x0, ord) AS value_text FROM cut WHERE NOT beyond GROUP BY page_id""")
def _(t):
    kept = layout.value_tokens(*_first_labels(t)).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("token_count"), F.sort_array(F.collect_list(F.struct("x0", "ord", "text"))).alias("t")
    )
    return kept.select("page_id", "token_count", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("value_text"))


@query("e9_reading_order", f"""
  WITH {WORDS}
  SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY round_even(cy / h, 0), cx, ord) AS reading_no FROM g""")
def _(t):
    return layout.reading_order(_words(t)).select("page_id", "ord", "reading_no")


@query("d10_page_confidence_box", f"""
  WITH {WORDS}
  SELECT page_id, round(avg(score), 4) AS confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM tokens GROUP BY page_id""")
def _(t):
    return _words(t).groupBy("page_id").agg(
        F.round(F.avg("score"), 4).alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def _tokens(t, rows, source, key):
    """Token rows of a sheet per source row; ``rows`` is a list of (text column, x0, y0, x1, y1)."""
    box = lambda v: v if not isinstance(v, (int, float)) else F.lit(float(v))
    cells = F.array(
        *[F.struct(text.alias("text"), *[box(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b)]) for text, *b in rows]
    )
    sheets = source.select(key.cast("string").alias("page_id"), F.posexplode(cells).alias("ord", "c"))
    return sheets.select(
        "page_id", F.col("ord").cast("long").alias("ord"), "c.text", (0.8 + F.col("ord") % 4 / 20).alias("score"), "c.x0", "c.y0", "c.x1", "c.y1"
    ).filter("text <> ''")


def _card_tokens(t):
    """An identity card for every order; what is printed where depends on the order key."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    code = national_id_of(k)
    birth = F.concat(F.lit("民國 "), (F.year(d) - 1951).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    issue = F.concat(F.lit("民國"), (F.year(d) - 1911).cast("string"), F.lit("年1月9日(北市)换發"))
    lit = F.lit
    rows = [
        (F.when(k % 4 == 3, "中華民國").otherwise("中華民國國民身分證"), 100, 0, 400, 22),
        (F.when(k % 3 == 0, "姓名陳").otherwise("姓名"), 0, 40, 50, 62),
        (F.when(k % 3 == 0, "俞 欣").when(k % 3 == 1, "王小明").otherwise("Ann"), 80, 42, 160, 64),
        (lit("出生"), 0, 80, 50, 102),
        (F.when(k % 5 == 0, "年月日").otherwise(birth), 80, 81, 220, 103),
        (F.when(k % 5 == 0, birth).otherwise(""), 600, 150, 700, 172),
        (lit("發證日期"), 0, 120, 70, 142),
        (issue, 90, 121, 300, 143),
        (lit("統一編號"), 0, 200, 70, 222),
        (F.concat(F.substring(code, 1, 1), lit(" "), F.substring(code, 2, 9)), 90, 200, 250, 222),
        (lit("出生地"), 0, 300, 60, 322),
        (lit("臺北市"), 80, 301, 140, 323),
        (lit("住址"), 0, 352, 50, 374),
        (F.concat(lit("臺中市南屯区範例里"), (k % 99 + 1).cast("string"), lit("鄰")), 80, 341, 300, 363),
        (F.concat(lit("測試路"), (k % 500 + 1).cast("string"), lit("號民國80年")), 80, 371, 300, 393),
        (lit("0012345678"), 80, 400, 300, 420),
    ]
    return _tokens(t, rows, dealt(t.orders.select("o_orderkey", "o_orderdate")), k)


CARDS = f"""
  k AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS page_id, o_orderdate AS d, {national_id_sql('o_orderkey')} AS code FROM orders),
  card AS (
    SELECT *, CASE WHEN {national_id_sql_valid('code')} THEN code ELSE '' END AS national_id,
      CASE id % 3 WHEN 0 THEN '陳俞欣' WHEN 1 THEN '王小明' ELSE '' END AS name,
      printf('%03d/%02d/%02d', year(d) - 1951, month(d), day(d)) AS birth_date,
      printf('%03d/01/09', year(d) - 1911) AS issue_date,
      '臺中市南屯區範例里' || (id % 99 + 1) || '鄰測試路' || (id % 500 + 1) || '號' AS address FROM k)"""


@query("j1_card_ids", f"WITH {CARDS} SELECT page_id, national_id FROM card")
def _(t):
    return layout.card_ids(layout.with_geometry(_card_tokens(t)))


@query("j2_card_names", f"WITH {CARDS} SELECT page_id, name FROM card")
def _(t):
    return layout.card_names(layout.with_geometry(_card_tokens(t)))


# A date printed away from its label is found only within the label's next five tokens.
@query("j3_birth_dates", f"WITH {CARDS} SELECT page_id, birth_date FROM card")
def _(t):
    return layout.card_birth_dates(layout.with_geometry(_card_tokens(t)))


@query("j4_issue_dates", f"WITH {CARDS} SELECT page_id, issue_date FROM card")
def _(t):
    return layout.card_issue_dates(layout.with_geometry(_card_tokens(t)))


@query("j5_card_addresses", f"WITH {CARDS} SELECT page_id, address FROM card")
def _(t):
    return layout.card_addresses(layout.with_geometry(_card_tokens(t)))


@query("d14_side_scores", f"""
  WITH {CARDS}
  SELECT page_id, (CASE WHEN id % 4 = 3 THEN 1 ELSE 2 END)::INT AS front_hits, 2::INT AS back_hits,
    CASE WHEN national_id <> '' THEN 'front' WHEN id % 4 = 3 THEN 'back' ELSE 'unknown' END AS side
  FROM card""")
def _(t):
    placed = layout.with_geometry(_card_tokens(t))
    scored = layout.side_scores(placed).join(layout.card_ids(placed), "page_id")
    front = F.col("front_hits") + F.when(F.col("national_id") != "", 3).otherwise(0)
    return scored.select("page_id", "front_hits", "back_hits", layout.side_of(front, F.col("back_hits")).alias("side"))


def _card_records(t):
    k = F.col("o_orderkey")
    cards = t.orders.select(
        k.cast("string").alias("page_id"), F.when(k % 3 == 0, "auto").when(k % 3 == 1, "front").otherwise("back").alias("requested_side"),
        F.when(k % 2 == 0, "A123456789").otherwise("").alias("barcode_id"),
    )
    return layout.card_records(_card_tokens(t), cards)


CARD_RECORDS = f"""{CARDS},
  s AS (SELECT *, CASE id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'front' ELSE 'back' END AS requested,
    CASE WHEN id % 2 = 0 AND id % 3 <> 1 THEN 'A123456789' ELSE '' END AS barcode FROM card),
  q AS (SELECT *, CASE WHEN barcode <> '' THEN barcode ELSE national_id END AS final_id FROM s),
  r AS (SELECT *, CASE WHEN requested <> 'auto' THEN requested
    WHEN id % 4 <> 3 AND final_id <> '' THEN 'unknown' ELSE 'back' END AS side FROM q),
  records AS (
    SELECT id, page_id, side, CASE WHEN side <> 'back' THEN name ELSE '' END AS name, final_id AS national_id,
      CASE WHEN barcode <> '' THEN 'barcode' WHEN national_id <> '' THEN 'ocr' ELSE '' END AS national_id_source,
      barcode <> '' AND national_id <> '' AND barcode <> national_id AS national_id_mismatch,
      CASE WHEN side <> 'back' THEN birth_date ELSE '' END AS birth_date, CASE WHEN side <> 'back' THEN issue_date ELSE '' END AS issue_date,
      CASE WHEN side <> 'front' THEN address ELSE '' END AS address, CASE id % 5 WHEN 0 THEN 0.875::DOUBLE ELSE 0.8767 END AS confidence FROM r)"""


@query("j6_card_records", f"""
  WITH {CARD_RECORDS}
  SELECT page_id, side, name, national_id, national_id_source, national_id_mismatch, birth_date, issue_date, address, confidence FROM records""")
def _(t):
    return _card_records(t)


@query("j6_file_cards", f"""
  WITH {CARD_RECORDS},
  f AS (
    SELECT id // 2 AS file_id, count(*) AS n, coalesce(arg_min(name, id) FILTER (name <> ''), '') AS name,
      coalesce(arg_min(national_id, id) FILTER (national_id <> ''), '') AS national_id,
      coalesce(arg_min(address, id) FILTER (address <> ''), '') AS address,
      coalesce(arg_min(birth_date, id) FILTER (birth_date <> ''), '') AS birth_date,
      coalesce(arg_min(issue_date, id) FILTER (issue_date <> ''), '') AS issue_date, bool_or(national_id_mismatch) AS mismatch
    FROM records GROUP BY 1)
  SELECT file_id, name, national_id, address, CASE WHEN national_id <> '' AND (name <> '' OR address <> '') THEN 'success' ELSE 'review' END AS status,
    concat_ws('|', CASE WHEN n < 2 THEN '合併頁未穩定偵測到兩張卡片，已使用可用候選或整頁辨識' END,
      CASE WHEN national_id = '' THEN '未取得通過 checksum 的身分證字號' END,
      CASE WHEN mismatch THEN '背面條碼與正面辨識的身分證字號不一致，已採用條碼值，請人工確認' END,
      CASE WHEN birth_date <> '' AND issue_date <> '' AND substr(issue_date, 1, 3)::INT - substr(birth_date, 1, 3)::INT < 14
        THEN '發證時未滿 14 歲，出生年月日或發證日期可能誤讀' END) AS warnings FROM f""")
def _(t):
    records = _card_records(t).withColumn("place", F.col("page_id").cast("long")).withColumn("file_id", F.expr("place div 2"))
    return layout.file_cards(records, AS_OF).select(
        "file_id", "name", "national_id", "address", "status", F.array_join("warnings", "|").alias("warnings")
    )


def _sheet_tokens(t):
    """A property sheet for every order: an address beside its label and a number below a misread label."""
    k = F.col("o_orderkey")
    lit = F.lit
    rows = [
        (lit("課稅房屋坐落："), 50, 100, 200, 120),
        (F.concat(lit("臺北市信義區"), (k % 50 + 1).cast("string")), 220, 101, 400, 121),
        (lit("路8號"), 420, 102, 480, 122),
        (lit("印章"), 900, 100, 950, 120),
        (F.when(k % 3 == 0, "稅籍編虎").when(k % 3 == 1, "房屋稅籍編號").otherwise("稅單登 記"), 50, 600, 200, 620),
        (F.format_string("%07d", k % 10000000), 60, 640, 200, 660),
        (lit("123"), 210, 641, 240, 661),
        (lit("頁尾"), 60, 900, 100, 920),
    ]
    return _tokens(t, rows, dealt(t.orders.select("o_orderkey", "o_orderdate")), k)


def _sheet_pages(t):
    k = F.col("o_orderkey")
    category = F.element_at(F.array(*[F.lit(c) for c in vocab.BOTTOM_RATIOS]), (k % 4 + 1).cast("int"))
    return t.orders.select(
        k.cast("string").alias("page_id"), F.concat(F.lit("file-"), (k % 500).cast("string")).alias("source_path"), category.alias("category"),
        (k % 9 + 1).cast("int").alias("page"), F.lit(1000).alias("width"), F.lit(1000).alias("height"),
        F.concat(k.cast("string"), F.lit(".jpg")).alias("image_file"),
    )


SHEETS = f"""
  s AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS page_id, ({list(vocab.BOTTOM_RATIOS)})[(o_orderkey % 4 + 1)::INT] AS category,
    o_orderkey % 3 AS form FROM orders),
  fields AS (
    SELECT id, page_id, category, 'property_address' AS field, '臺北市信義區' || (id % 50 + 1) || '路8號' AS value, 1.0::DOUBLE AS match, TRUE AS kept FROM s
    UNION ALL
    SELECT id, page_id, category, 'tax_registration_number', printf('%07d', id % 10000000) || '123', CASE form WHEN 0 THEN 0.75::DOUBLE ELSE 1.0 END,
      category IN ('building_transcript', 'building_title') FROM s WHERE form <> 2)"""


@query("j7_property_fields", f"WITH {SHEETS} SELECT page_id, field, value, match AS label_match_score FROM fields")
def _(t):
    return layout.property_fields(_sheet_tokens(t)).select("page_id", "field", "value", "label_match_score")


@query("e13_best_labels", f"""
  WITH {SHEETS} SELECT page_id, field, CASE field WHEN 'property_address' THEN 0 ELSE 4 END::BIGINT AS ord, match AS match_score FROM fields""")
def _(t):
    found = layout.find_labels(layout.with_geometry(_sheet_tokens(t)))
    return found.select("page_id", "field", "ord", F.round("match_score", 4).alias("match_score"))


@query("h22_label_similarity")
def _(t):
    words = _words(t).select("text").distinct()
    return words.select("text", F.round(similarity(F.col("text"), F.lit("tionement")), 6).alias("ratio"))


@query("j8_region_tokens", f"""
  WITH {SHEETS},
  t AS (SELECT s.*, ord, cy FROM s CROSS JOIN (VALUES (0, 110), (1, 111), (2, 112), (3, 110), (4, 610), (5, 650), (6, 651), (7, 910)) v(ord, cy))
  SELECT page_id, ord::BIGINT AS ord FROM t
  WHERE cy <= 1000 * CASE category {' '.join(f"WHEN '{c}' THEN {r}" for c, r in vocab.BOTTOM_RATIOS.items())} END""")
def _(t):
    return layout.keep_region(_sheet_tokens(t), _sheet_pages(t).select("page_id", "category")).select("page_id", "ord")


@query("j8_region_boxes", f"""
  WITH {SHEETS}
  SELECT page_id, category, 3::INT AS all_boxes, (1 + CASE WHEN category IN ('building_transcript', 'building_title') THEN 1 ELSE 0 END)::INT AS selected_boxes FROM s""")
def _(t):
    box = lambda y0, y1: F.array(F.lit(10), F.lit(y0), F.lit(90), F.lit(y1))
    records = _sheet_pages(t).withColumn("det_boxes_1000", F.array(box(100, 130), box(590, 640), box(800, 840)))
    return layout.boxes_kept(records)


@query("j9_pseudo_labels", f"""
  WITH {SHEETS}
  SELECT page_id, 'file-' || (id % 500) AS source_path, category, (id % 9 + 1)::INT AS page, field, value AS value_text, match AS label_match_score,
    CASE field WHEN 'property_address' THEN '50,100,200,120' ELSE '50,600,200,620' END AS label_box,
    CASE field WHEN 'property_address' THEN '220,101,480,122' ELSE '60,640,240,661' END AS value_box,
    CASE field WHEN 'property_address' THEN 0.875::DOUBLE ELSE 0.875 END AS ocr_confidence, 'pending_review' AS annotation_status FROM fields""")
def _(t):
    rows = layout.pseudo_labels(layout.property_fields(_sheet_tokens(t)), _sheet_pages(t))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select(
        "page_id", "source_path", "category", "page", "field", "value_text", "label_match_score", text("label_box_1000").alias("label_box"),
        text("value_box_1000").alias("value_box"), "ocr_confidence", "annotation_status",
    )


@query("j10_label_records", f"""
  WITH {SHEETS}
  SELECT page_id, count(*)::INT AS shape_count, '{{"shapes":[' || string_agg('{{"label":"' || field || '","points":' ||
      CASE field WHEN 'property_address' THEN '[[220,101],[480,122]]' ELSE '[[60,640],[240,661]]' END ||
      ',"shape_type":"rectangle","flags":{{"needs_review":true}}}}', ',' ORDER BY field) || '],"imagePath":"' || page_id ||
      '.jpg","imageHeight":1000,"imageWidth":1000}}' AS record FROM fields GROUP BY page_id""")
def _(t):
    return layout.label_records(layout.property_fields(_sheet_tokens(t)), _sheet_pages(t)).select("page_id", "shape_count", "record")


@query("c16_field_agreement", f"WITH {SHEETS} SELECT page_id, field, kept AS matched FROM fields")
def _(t):
    return _agreement(t).select("page_id", "field", "matched")


def _agreement(t):
    tokens, pages = _sheet_tokens(t), _sheet_pages(t)
    baseline = layout.property_fields(tokens).select("page_id", "field", "value")
    region = layout.keep_region(tokens, pages.select("page_id", "category"))
    return layout.compare_fields(baseline, layout.property_fields(region).select("page_id", "field", "value"))


@query("d8_agreement_report", f"""
  WITH {SHEETS}
  SELECT coalesce(category, 'all') AS category, count(*) AS baseline_fields, count(*) FILTER (kept) AS matched_fields,
    round(count(*) FILTER (kept)::DOUBLE / greatest(count(*), 1), 4) AS field_agreement FROM fields GROUP BY ROLLUP (category)""")
def _(t):
    from caseflow.operators.dataset import agreement_report

    return agreement_report(_agreement(t).join(shuffled(_sheet_pages(t).select("page_id", "category")), "page_id"))
