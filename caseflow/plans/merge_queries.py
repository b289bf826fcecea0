"""Reconciliation and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import roc_rank
from caseflow.operators import ledger, merge, reconcile
from caseflow.operators.ranking import numbered
from caseflow.plans.inputs import AS_OF, pick
from caseflow.plans.inputs_sql import in_list
from caseflow.plans.inputs_sql import pick as pick_sql
from caseflow.plans.registry import query

TODAY = AS_OF.isoformat()

LINKED = """
  links AS (
    SELECT entity_type, tax_id, official_receipt_no AS receipt_no, max(id) AS linked_id, min(id) AS lowest_id
    FROM cases WHERE official_receipt_no <> '' GROUP BY ALL),
  marked AS (
    SELECT n.*, c.entity_type, c.tax_id, c.official_receipt_no AS stored, l.linked_id,
      (split_part(n.received_date, '/', 1)::INT + 1911) || '-' || replace(substr(n.received_date, strpos(n.received_date, '/') + 1), '/', '-') AS received_iso,
      coalesce(c.submitted_date, c.received_date)::VARCHAR AS target_date
    FROM candidates n JOIN cases c ON c.id = n.case_id
      LEFT JOIN links l ON l.entity_type = c.entity_type AND l.tax_id = c.tax_id AND l.receipt_no = n.receipt_no)"""

CHOSEN = LINKED + """,
  ordered AS (
    SELECT *, linked_id IS NULL OR linked_id = case_id AS available,
      row_number() OVER (PARTITION BY case_id ORDER BY received_iso DESC, receipt_no DESC, part, supp, official_status) AS rn
    FROM marked),
  counted AS (
    SELECT case_id, min(rn) FILTER (stored <> '' AND receipt_no = stored) AS exact_rn,
      min(rn) FILTER (available AND received_iso = target_date) AS dated_rn,
      count(*) FILTER (available AND received_iso = target_date) AS dated_n,
      min(rn) FILTER (available) AS available_rn, count(*) FILTER (available) AS available_count
    FROM ordered GROUP BY case_id),
  decided AS (
    SELECT *, CASE WHEN exact_rn IS NOT NULL THEN 'receipt' WHEN dated_n = 1 THEN 'date' WHEN available_count = 1 THEN 'single'
      ELSE 'ambiguous' END AS how FROM counted),
  chosen AS (
    SELECT d.case_id, d.how, d.available_count, o.receipt_no, o.received_date, o.official_status, o.authority, o.received_iso
    FROM decided d LEFT JOIN ordered o ON o.case_id = d.case_id
      AND o.rn = CASE d.how WHEN 'receipt' THEN exact_rn WHEN 'date' THEN dated_rn WHEN 'single' THEN available_rn END)"""

STATUS_RULES = "CASE " + " ".join(
    f"WHEN regexp_matches({{0}}, '{p}') THEN '{s}'" for p, s in vocab.OFFICIAL_STATUS_RULES
) + f" ELSE '{vocab.OFFICIAL_STATUS_DEFAULT}' END"


@query("b7_intake_validation", f"""
  SELECT id, concat_ws(',',
      CASE WHEN tax_id <> '' AND NOT regexp_full_match(tax_id, '[0-9]{{8}}') THEN 'tax_id' END,
      CASE WHEN entity_type NOT IN {in_list(vocab.ENTITY_TYPES)} THEN 'entity_type' END,
      CASE WHEN trim(case_content) = '' THEN 'case_content' END,
      CASE WHEN status NOT IN {in_list(vocab.STATUSES)} THEN 'status' END,
      CASE WHEN tax_bureau_code = 'E01' THEN 'tax_bureau_code' END,
      CASE WHEN capital = 0 THEN 'capital' END,
      CASE WHEN paid_amount = 0 THEN 'paid_amount' END) AS errors
  FROM cases""")
def _(t):
    rows = t.cases.select(
        "id", F.col("received_date").cast("string").alias("received_date"), "tax_id", "entity_type", "company_name",
        "case_type", "case_content", "status", "tax_office_required",
        F.when(F.col("tax_bureau_code") == "E01", "X99").otherwise(F.col("tax_bureau_code")).alias("tax_bureau_code"),
        F.col("billing_date").cast("string").alias("billing_date"),
        F.when(F.col("capital") == 0, "1e3x").otherwise(F.col("capital").cast("string")).alias("capital"),
        F.when(F.col("paid_amount") == 0, "-5").otherwise(F.col("paid_amount").cast("string")).alias("paid_amount"),
    )
    return merge.check_intake(rows).select("id", F.array_join("errors", ",").alias("errors"))


@query("b8_billing_item_cleaning", """
  SELECT case_id, position - 1 AS sort_order, item_name, amount, notes, item_name = '' AS missing_name FROM (
    SELECT l_orderkey AS case_id, l_linenumber AS position, CASE l_linenumber % 3 WHEN 0 THEN '' ELSE 'item-' || l_partkey END AS item_name,
      CASE WHEN l_returnflag = 'A' THEN 0 ELSE floor(l_extendedprice)::BIGINT END AS amount,
      CASE WHEN l_linestatus = 'O' THEN '' ELSE l_returnflag END AS notes FROM lineitem)
  WHERE item_name <> '' OR amount <> 0 OR notes <> ''""")
def _(t):
    raw = t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit(" item-"), F.col("l_partkey").cast("string"))).alias("item_name"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.format_number(F.floor("l_extendedprice"), 0)).alias("amount_text"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_returnflag")).alias("notes"),
    )
    return merge.clean_items(raw).select("case_id", "sort_order", "item_name", "amount", "notes", "missing_name")


@query("c8_candidate_links", f"""
  WITH {LINKED}
  SELECT case_id, receipt_no, received_iso, linked_id, linked_id = case_id AS is_current,
    linked_id IS NULL AND received_iso = target_date AS recommended FROM marked""")
def _(t):
    marked = reconcile.annotate_candidates(t.candidates, t.cases)
    return marked.select("case_id", "receipt_no", "received_iso", "linked_id", "is_current", "recommended")


@query("c9_link_conflicts", """
  SELECT user_id, receipt_no, count(*) AS case_count, min(id) AS lowest_id, max(id) AS highest_id
  FROM (SELECT event_id AS id, user_id, props AS receipt_no FROM events) GROUP BY user_id, receipt_no HAVING count(DISTINCT id) > 1""")
def _(t):
    held = t.events.select(F.col("event_id").alias("id"), "user_id", F.col("props").alias("receipt"))
    return reconcile.link_conflicts(held, ["user_id"], "receipt")


@query("l1_candidate_choice", f"""
  WITH {CHOSEN}
  SELECT case_id, how, available_count, receipt_no, received_date, official_status FROM chosen""")
def _(t):
    chosen = reconcile.choose_candidates(t.candidates, t.cases, ["part", "supp"])
    return chosen.select("case_id", "how", "available_count", "receipt_no", "received_date", "official_status")


UPDATES = CHOSEN + f""",
  staged AS (
    SELECT c.*, k.receipt_no AS n_receipt, k.received_iso AS n_iso, k.official_status AS n_status, k.authority AS n_authority,
      CASE WHEN c.status IN {in_list(vocab.PROTECTED)} THEN c.status ELSE {STATUS_RULES.format('k.official_status')} END AS next_status,
      coalesce(l.linked_id <> c.id OR l.lowest_id <> c.id, FALSE) AS conflict
    FROM cases c JOIN chosen k ON k.case_id = c.id AND k.how <> 'ambiguous'
      LEFT JOIN links l ON l.entity_type = c.entity_type AND l.tax_id = c.tax_id AND l.receipt_no = k.receipt_no),
  updates AS (
    SELECT id, conflict, n_receipt <> official_receipt_no OR n_status <> official_status OR next_status <> status AS changed,
      next_status AS status,
      CASE WHEN status IN {in_list(vocab.PROTECTED)} THEN status_detail
        ELSE '官方網站：' || n_status || CASE WHEN contains(n_status, '發文中') THEN '（尚未可領件）' ELSE '' END END AS status_detail,
      n_receipt AS official_receipt_no, n_status AS official_status, '17' AS reg_unit_code,
      coalesce(submitted_date::VARCHAR, n_iso) AS submitted_date, n_authority AS authority,
      CASE WHEN entity_type = '行號' THEN '{vocab.BUSINESS_LIST_URL}'
        ELSE '{vocab.COMPANY_DETAIL_URL}?rcvNo=' || n_receipt || '&regUnitCode=17&showPreRegNo=0' END AS progress_url,
      coalesce(nullif(concat_ws('；', CASE WHEN n_receipt <> official_receipt_no THEN '帶入收文號 ' || n_receipt END,
        CASE WHEN n_status <> official_status THEN '官方進度：' || n_status END,
        CASE WHEN next_status <> status THEN '系統進度更新為 ' || next_status END), ''),
        '官方網站：' || n_status || CASE WHEN contains(n_status, '發文中') THEN '（尚未可領件）' ELSE '' END) AS change_text
    FROM staged)"""


def _updates(t):
    chosen = reconcile.choose_candidates(t.candidates, t.cases, ["part", "supp"])
    return reconcile.official_updates(t.cases, chosen, AS_OF)


@query("l2_official_updates", f"WITH {UPDATES} SELECT * FROM updates")
def _(t):
    return _updates(t)


@query("l2_official_events", f"""
  WITH {UPDATES}
  SELECT id AS case_id, DATE '{TODAY}' AS event_date, '官方查詢' AS event_type, status, change_text AS detail
  FROM updates WHERE changed AND NOT conflict""")
def _(t):
    return reconcile.official_events(_updates(t), AS_OF)


TAX_STATUS = ["已發文", "審核中", "", "辦理完成"]
TAX_UPDATES = f"""
  records AS (
    SELECT o_orderkey AS case_id, lower(['A05', 'H01', 'B01', 'D01', 'E01', 'Z9'][(o_orderkey % 6 + 1)::INT]) AS bureau_code,
      CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE printf('%010d', o_orderkey - o_orderkey % 7) END AS receipt_no,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '87/01/05' END AS received_date,
      {pick_sql(TAX_STATUS, 'o_orderkey')} AS official_status FROM orders),
  tax_links AS (
    SELECT tax_id, tax_receipt_no AS receipt_no, max(id) AS linked_id, min(id) AS lowest_id FROM cases
    WHERE tax_receipt_no <> '' GROUP BY ALL),
  tax_updates AS (
    SELECT r.case_id, upper(r.bureau_code) AS bureau_code, r.receipt_no, r.received_date, r.official_status,
      coalesce(l.linked_id <> c.id OR l.lowest_id <> c.id, FALSE) AS conflict,
      CASE WHEN regexp_matches(r.official_status, '已發文|結案|完成') THEN '已完成' ELSE '辦理中' END AS tax_office_required,
      CASE WHEN regexp_matches(r.official_status, '已發文|結案|完成') THEN '國稅局已完成' ELSE '國稅局辦理中' END AS label,
      b.short_name || '・' || coalesce(nullif(r.receipt_no, ''), '無文號') || '・稅籍登記・' ||
        coalesce(nullif(r.official_status, ''), '已查詢') AS detail
    FROM records r JOIN cases c ON c.id = r.case_id
      JOIN (SELECT DISTINCT bureau_code, short_name FROM bureau_county) b ON b.bureau_code = upper(r.bureau_code)
      LEFT JOIN tax_links l ON l.tax_id = c.tax_id AND l.receipt_no = r.receipt_no)"""


def _tax_updates(t):
    k = F.col("o_orderkey")
    records = t.orders.select(
        k.alias("case_id"), F.lower(pick(["A05", "H01", "B01", "D01", "E01", "Z9"], k)).alias("bureau_code"),
        F.when(k % 3 == 0, "").otherwise(F.format_string("%010d", k - k % 7)).alias("receipt_no"),
        F.when(k % 5 == 0, "").otherwise("87/01/05").alias("received_date"), F.lit("").alias("case_type"),
        pick(TAX_STATUS, k).alias("official_status"),
    )
    return reconcile.tax_updates(t.cases, records)


@query("l3_tax_updates", f"WITH {TAX_UPDATES} SELECT * FROM tax_updates")
def _(t):
    return _tax_updates(t)


@query("l3_tax_events", f"""
  WITH {TAX_UPDATES},
  new_events AS (
    SELECT case_id, CASE WHEN received_date = '' THEN '{TODAY}' ELSE '1998-01-05' END AS event_date, '國稅局查詢' AS event_type,
      label AS status, detail FROM tax_updates WHERE NOT conflict)
  SELECT n.* FROM new_events n JOIN cases c ON c.id = n.case_id WHERE c.entity_type <> '行號'""")
def _(t):
    updates = _tax_updates(t)
    # An earlier run already logged the events of every sole proprietorship.
    earlier = updates.join(t.cases.filter("entity_type = '行號'").select(F.col("id").alias("case_id")), "case_id", "left_semi")
    logged = earlier.select("case_id", F.lit("國稅局查詢").alias("event_type"), F.col("label").alias("status"), "detail")
    known = logged.unionByName(t.history.select("case_id", "event_type", "status", "detail"))
    return reconcile.tax_events(updates, known, AS_OF)


@query("f6_results_newest_first", """
  WITH ranked AS (
    SELECT c.case_id, c.receipt_no, c.received_date, row_number() OVER (PARTITION BY c.case_id
      ORDER BY (split_part(received_date, '/', 1)::BIGINT + 1911) * 10000 + split_part(received_date, '/', 2)::BIGINT * 100
        + split_part(received_date, '/', 3)::BIGINT DESC, receipt_no DESC) AS place FROM candidates c)
  SELECT * FROM ranked""")
def _(t):
    rows = t.candidates.select("case_id", "receipt_no", "received_date")
    return numbered(rows, ["case_id"], reconcile.candidate_order(), "place", -roc_rank("received_date"))


@query("k6_pick_result", """
  WITH asked AS (SELECT id AS query_id, CASE WHEN entity_type = '公司' THEN official_receipt_no ELSE '' END AS wanted FROM cases),
  ranked AS (
    SELECT a.query_id, c.receipt_no, c.received_date, row_number() OVER (PARTITION BY a.query_id
      ORDER BY split_part(received_date, '/', 1)::INT DESC, substr(received_date, strpos(received_date, '/')) DESC, receipt_no DESC) AS rn
    FROM asked a JOIN candidates c ON c.case_id = a.query_id AND (a.wanted = '' OR c.receipt_no = a.wanted))
  SELECT a.query_id, r.receipt_no, r.received_date, r.receipt_no IS NULL AS not_found
  FROM asked a LEFT JOIN ranked r ON r.query_id = a.query_id AND r.rn = 1""")
def _(t):
    asked = t.cases.select(
        F.col("id").alias("query_id"), F.when(F.col("entity_type") == "公司", F.concat(F.lit(" "), "official_receipt_no")).alias("receipt_no")
    )
    results = t.candidates.withColumnRenamed("case_id", "query_id")
    return reconcile.pick_result(asked, results)


@query("l4_keyed_upsert", """
  WITH updates AS (SELECT user_id AS id, props AS notes, event_type AS status, event_id AS seq FROM events),
  newest AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
  SELECT coalesce(n.id, c.id) AS id, CASE WHEN n.id IS NULL THEN c.status ELSE n.status END AS status,
    CASE WHEN n.id IS NULL THEN c.notes ELSE n.notes END AS notes
  FROM cases c FULL JOIN newest n ON n.id = c.id""")
def _(t):
    target = t.cases.select("id", "status", "notes")
    updates = t.events.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("props").alias("notes"), F.col("event_id").alias("seq")
    )
    return merge.upsert(target, updates, ["id"], ["seq"])


@query("l5_replace_children", """
  WITH new_items AS (SELECT user_id AS case_id, event_type AS item_name, floor(value)::BIGINT AS amount, 'new' AS notes,
      (event_id % 9)::INT AS sort_order FROM events)
  SELECT * FROM items WHERE case_id NOT IN (SELECT case_id FROM new_items) UNION ALL SELECT * FROM new_items""")
def _(t):
    return merge.replace_children(t.items, _new_items(t), "case_id")


def _new_items(t):
    return t.events.select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("item_name"), F.floor("value").cast("long").alias("amount"),
        F.lit("new").alias("notes"), (F.col("event_id") % 9).cast("int").alias("sort_order"),
    )


@query("l5_billing_saved", """
  WITH new_total AS (SELECT user_id AS case_id, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1),
  forms AS (SELECT o_orderkey AS id, '已請款' AS billing_status, o_orderdate::DATE AS billing_date, o_orderkey * 10 AS paid_amount
    FROM orders WHERE o_orderpriority = '1-URGENT')
  SELECT c.id, CASE WHEN f.id IS NULL THEN c.billing_status WHEN coalesce(n.total, 0) > 0 AND f.paid_amount >= n.total THEN '已收款'
      ELSE f.billing_status END AS billing_status,
    CASE WHEN f.id IS NULL THEN c.paid_amount ELSE f.paid_amount END AS paid_amount,
    CASE WHEN f.id IS NULL THEN c.service_fee ELSE 0 END AS service_fee,
    CASE WHEN f.id IS NULL THEN c.billing_date ELSE f.billing_date END AS billing_date
  FROM cases c LEFT JOIN forms f ON f.id = c.id LEFT JOIN new_total n ON n.case_id = c.id""")
def _(t):
    forms = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("case_id"), F.lit("已請款").alias("billing_status"),
        F.col("o_orderdate").cast("date").alias("billing_date"), (F.col("o_orderkey") * 10).alias("paid_amount"),
        F.lit(None).cast("date").alias("payment_date"),
    )
    saved = merge.apply_billing(t.cases, forms, _new_items(t))
    return saved.select("id", "billing_status", "paid_amount", "service_fee", "billing_date")


@query("l6_cascading_delete", """
  WITH gone AS (SELECT id FROM cases WHERE status = '取消')
  SELECT 'cases' AS table_name, count(*) AS row_count, sum(id)::BIGINT AS key_sum FROM cases WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'items', count(*), sum(case_id)::BIGINT FROM items WHERE case_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'history', count(*), sum(case_id)::BIGINT FROM history WHERE case_id NOT IN (SELECT id FROM gone)""")
def _(t):
    kept = merge.delete_cases(
        t.cases.filter("status = '取消'"), t.cases, {"items": t.items, "history": t.history}
    )
    result = None
    for name, table in kept.items():
        key = "id" if name == "cases" else "case_id"
        row = table.agg(F.count(F.lit(1)).alias("row_count"), F.sum(key).alias("key_sum")).withColumn("table_name", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result.select("table_name", "row_count", "key_sum")


def _event_requests(t):
    """Delete requests from purchases; those of users above 100 name the wrong case."""
    case_id = F.when(F.col("user_id") > 100, F.col("user_id") + 1).otherwise(F.col("user_id"))
    return t.events.filter("event_type = 'purchase'").select(case_id.alias("case_id"), F.col("event_id").alias("id"))


@query("l7_event_delete", """
  SELECT id, case_id FROM history h WHERE NOT EXISTS (
    SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.event_id = h.id
      AND CASE WHEN e.user_id > 100 THEN e.user_id + 1 ELSE e.user_id END = h.case_id)""")
def _(t):
    kept, _ = merge.delete_events(t.history, _event_requests(t))
    return kept.select("id", "case_id")


@query("l7_event_delete_not_found", """
  SELECT user_id + 1 AS case_id, event_id AS id FROM events WHERE event_type = 'purchase' AND user_id > 100""")
def _(t):
    _, missed = merge.delete_events(t.history, _event_requests(t))
    return missed.select("case_id", "id")


POSTED_SQL = """
  posted AS (SELECT id, case_id, (event_date - INTERVAL 28 YEAR)::DATE AS event_date, status, detail FROM history)"""


def _posted(t):
    return t.history.select(
        "id", "case_id", F.add_months("event_date", -12 * 28).alias("event_date"), "status", "detail"
    )


@query("l8_event_apply", f"""
  WITH {POSTED_SQL},
  folded AS (
    SELECT case_id, min(event_date) AS earliest, arg_max(status, id) AS last_status, arg_max(detail, id) AS last_detail,
      arg_min(event_date, id) FILTER (status = '已送件') AS submitted, arg_min(event_date, id) FILTER (status = '結案') AS closed
    FROM posted GROUP BY case_id)
  SELECT c.id, least(c.received_date, f.earliest) AS received_date, coalesce(f.last_status, c.status) AS status,
    coalesce(f.last_detail, c.status_detail) AS status_detail, coalesce(c.submitted_date, f.submitted) AS submitted_date,
    f.closed AS closed_date, coalesce(f.earliest < c.received_date, FALSE) AS received_date_adjusted
  FROM cases c LEFT JOIN folded f ON f.case_id = c.id""")
def _(t):
    return merge.apply_events(t.cases, _posted(t)).select(
        "id", "received_date", "status", "status_detail", "submitted_date", "closed_date", "received_date_adjusted"
    )


@query("l9_event_labels", f"""
  WITH forms AS (
    SELECT *, CASE WHEN case_type = '新設立' THEN '審查中' ELSE status END AS new_status,
      {pick_sql(vocab.TAX_OFFICE_VALUES, 'id')} AS new_tax FROM cases),
  judged AS (SELECT *, new_tax <> tax_office_required AND new_status = status AS tax_only FROM forms),
  labels AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in vocab.TAX_OFFICE_LABELS.items())}) v(tax, label))
  SELECT id AS case_id, CASE WHEN tax_only THEN '國稅局' ELSE '進度' END AS event_type,
    CASE WHEN tax_only THEN label ELSE new_status END AS status,
    CASE WHEN tax_only THEN '國稅局進度更新為「' || label || '」・' || coalesce(b.short_name, '未選擇區局') ELSE status_detail END AS detail
  FROM judged JOIN labels ON labels.tax = new_tax
    LEFT JOIN (SELECT DISTINCT bureau_code, short_name FROM bureau_county) b ON b.bureau_code = tax_bureau_code""")
def _(t):
    same = ["tax_bureau_code", "reg_unit_code", "status_detail", "official_receipt_no", "submitted_date", "next_follow_up_date"]
    forms = t.cases.select(
        F.col("id").alias("case_id"), F.col("received_date").alias("event_date"),
        F.when(F.col("case_type") == "新設立", "審查中").otherwise(F.col("status")).alias("status"),
        pick(vocab.TAX_OFFICE_VALUES, F.col("id")).alias("tax_office_required"),
        F.col("status").alias("cur_status"), F.col("tax_office_required").alias("cur_tax_office_required"),
        *same, *[F.col(c).alias(f"cur_{c}") for c in same],
    )
    names = {code: short for code, _, short, _ in vocab.BUREAUS}
    return merge.label_events(forms, names).drop("event_date")


@query("l10_exclusive_default", """
  WITH requests AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS id, c_acctbal > 0 AS is_default, c_custkey AS seq FROM customer),
  won AS (SELECT arg_max(id, seq) AS id, max(seq) AS seq FROM requests WHERE is_default),
  last AS (SELECT id, arg_max(is_default, seq) AS asked, max(seq) AS seq FROM requests GROUP BY id)
  SELECT o.id, o.id = (SELECT id FROM won) AND NOT coalesce(l.seq > (SELECT seq FROM won) AND NOT l.asked, FALSE) AS is_default
  FROM offices o LEFT JOIN last l ON l.id = o.id""")
def _(t):
    n = t.supplier.agg(F.count(F.lit(1))).scalar()
    requests = t.customer.select(
        (F.col("c_custkey") % n).alias("id"), (F.col("c_acctbal") > 0).alias("is_default"), F.col("c_custkey").alias("seq")
    )
    return merge.exclusive_default(t.offices, requests).select("id", "is_default")


INTAKE = ["received_date", "tax_id", "entity_type", "company_name", "case_type", "case_content", "status", "tax_office_required",
          "tax_bureau_code", "billing_date", "capital", "paid_amount"]


INTAKE_SQL = """
  last_numbers AS (SELECT substr(case_number, 1, 4) AS y, max(substr(case_number, 6)::BIGINT) AS n FROM cases GROUP BY 1),
  accepted AS (
    SELECT c.*, c.received_date + 400 AS new_date, year(c.received_date + 400)::VARCHAR AS y,
      row_number() OVER (PARTITION BY year(c.received_date + 400) ORDER BY c.id) AS place FROM cases c),
  intake_numbered AS (
    SELECT a.id, a.new_date AS received_date, a.status, a.status_detail,
      a.y || '-' || CASE WHEN coalesce(l.n, 0) + place < 1000 THEN lpad((coalesce(l.n, 0) + place)::VARCHAR, 3, '0') ELSE (coalesce(l.n, 0) + place)::VARCHAR END AS case_number
    FROM accepted a LEFT JOIN last_numbers l ON l.y = a.y)"""


def _intake(t, max_rows=None):
    """A batch of good rows, one per case and dated later, after the gate and with its numbers."""
    content = F.when(F.trim("case_content") == "", "變更").otherwise(F.col("case_content")).alias("case_content")
    later = F.date_add("received_date", 400).cast("string").alias("received_date")
    rows = t.cases.select(
        "id", "status_detail", content, later, *[F.col(c).cast("string").alias(c) for c in INTAKE if c not in ("case_content", "received_date")]
    )
    accepted = merge.accept_all_or_nothing(merge.check_intake(rows), max_rows)
    dated = accepted.withColumns({"received_date": F.col("received_date").cast("date"), "input_pos": F.col("id")})
    return ledger.assign_case_numbers(dated, t.cases)


@query("l11_batch_intake", f"WITH {INTAKE_SQL} SELECT id, received_date, case_number FROM intake_numbered")
def _(t):
    return _intake(t).select("id", "received_date", "case_number")


@query("l11_intake_events", f"""
  WITH {INTAKE_SQL}
  SELECT case_number, received_date AS event_date, '進度' AS event_type, status, coalesce(nullif(status_detail, ''), '建立案件') AS detail
  FROM intake_numbered""")
def _(t):
    return merge.intake_events(_intake(t))


@query("l11_batch_too_long", f"WITH {INTAKE_SQL} SELECT id, case_number FROM intake_numbered WHERE (SELECT count(*) FROM cases) <= 100")
def _(t):
    return _intake(t, 100).select("id", "case_number")


@query("l11_batch_rejected", "SELECT id, case_number FROM cases WHERE FALSE")
def _(t):
    rows = t.cases.select("id", "case_number", *[F.col(c).cast("string").alias(c) for c in INTAKE])
    return merge.accept_all_or_nothing(merge.check_intake(rows)).select("id", "case_number")


@query("l12_backfill_defaults", """
  SELECT id, coalesce(closed_date, DATE '1970-01-01') AS closed_date, '未請款' AS dunning_status, 0::BIGINT AS reminders_sent,
    CASE WHEN submitted_date IS NULL AND status = '已送件' THEN received_date ELSE submitted_date END AS submitted_date
  FROM cases""")
def _(t):
    filled = merge.backfill_columns(
        t.cases,
        {"closed_date": ("date", "1970-01-01"), "dunning_status": ("string", "未請款"), "reminders_sent": ("bigint", 0)},
    )
    due = F.col("submitted_date").isNull() & (F.col("status") == "已送件")
    return filled.withColumn("submitted_date", F.when(due, F.col("received_date")).otherwise(F.col("submitted_date"))).select(
        "id", "closed_date", "dunning_status", "reminders_sent", "submitted_date"
    )


@query("l13_profile_update", """
  SELECT id, CASE WHEN case_type = '新設立' THEN received_date - 9 ELSE received_date END AS received_date,
    CASE WHEN case_type = '新設立' THEN company_name || ' Ltd' ELSE company_name END AS company_name, status, status_detail FROM cases""")
def _(t):
    updates = t.cases.filter("case_type = '新設立'").select(
        "id", F.date_sub("received_date", 9).alias("received_date"), F.concat("company_name", F.lit(" Ltd")).alias("company_name"),
        F.lit("取消").alias("status"),
    )
    return merge.update_profiles(t.cases, updates).select("id", "received_date", "company_name", "status", "status_detail")


@query("l13_first_event_moved", """
  WITH firsts AS (SELECT case_id, min(id) AS id FROM history GROUP BY case_id)
  SELECT h.id, h.case_id, CASE WHEN f.id IS NOT NULL AND c.case_type = '新設立' THEN c.received_date - 9 ELSE h.event_date END AS event_date
  FROM history h LEFT JOIN firsts f ON f.id = h.id LEFT JOIN cases c ON c.id = h.case_id""")
def _(t):
    updates = t.cases.select("id", F.when(F.col("case_type") == "新設立", F.date_sub("received_date", 9)).otherwise(F.col("received_date")).alias("received_date"))
    return merge.profile_events(t.cases, t.history, updates).select("id", "case_id", "event_date")


@query("l14_preparation_sync", """
  SELECT c.id, CASE WHEN p.case_id IS NULL THEN c.company_name ELSE coalesce(nullif(p.company, ''), c.company_name) END AS company_name,
    CASE WHEN p.case_id IS NULL THEN c.representative ELSE p.representative END AS representative,
    CASE WHEN p.case_id IS NULL THEN c.precheck_no ELSE p.precheck END AS precheck_no,
    CASE WHEN p.case_id IS NULL THEN c.address ELSE p.registration_address END AS address,
    CASE WHEN p.case_id IS NULL THEN c.capital ELSE coalesce(nullif(replace(p.capital_text, ',', ''), '')::BIGINT, 0) END AS capital
  FROM cases c LEFT JOIN preparation p ON p.case_id = c.id""")
def _(t):
    return merge.sync_preparation(t.cases, t.preparation).select(
        "id", "company_name", "representative", "precheck_no", "address", "capital"
    )


@query("l14_preparation_events", f"""
  SELECT c.id AS case_id, DATE '{TODAY}' AS event_date, '資料準備' AS event_type, c.status, '已儲存 OCR 與文件準備確認資料' AS detail
  FROM cases c SEMI JOIN preparation p ON p.case_id = c.id""")
def _(t):
    return merge.preparation_events(t.cases, t.preparation, AS_OF)


@query("l15_approval_batch", """
  WITH v AS (SELECT case_id, count(DISTINCT agency) = 2 AS accepted FROM approvals GROUP BY case_id)
  SELECT a.case_id, a.agency, a.status, a.approval_date::VARCHAR AS approval_date, a.document_number, NULL::VARCHAR AS cloud_path, v.accepted
  FROM approvals a JOIN v ON v.case_id = a.case_id""")
def _(t):
    rows = t.approvals.select(
        "case_id", "agency", "status", F.coalesce(F.col("approval_date").cast("string"), F.lit(" ")).alias("approval_date"),
        F.coalesce("document_number", F.lit("")).alias("document_number"), F.lit("  ").alias("cloud_path"),
    )
    return merge.check_approvals(rows)


def _sent_approvals(t):
    """New approval forms of every case with an approval; only those with both agencies are in good order."""
    rows = t.approvals.select(
        "case_id", "agency", F.lit("archived").alias("status"), F.lit("2001-12-01").alias("approval_date"),
        F.concat(F.lit("New-"), F.col("case_id").cast("string")).alias("document_number"), F.lit(" path ").alias("cloud_path"),
    )
    return merge.check_approvals(rows)


BOTH = "both_sent AS (SELECT case_id FROM approvals GROUP BY case_id HAVING count(DISTINCT agency) = 2)"


@query("l15_approvals_stored", f"""
  WITH {BOTH}
  SELECT a.case_id, agency, CASE WHEN b.case_id IS NULL THEN status ELSE 'archived' END AS status,
    CASE WHEN b.case_id IS NULL THEN approval_date::VARCHAR ELSE '2001-12-01' END AS approval_date,
    CASE WHEN b.case_id IS NULL THEN document_number ELSE 'New-' || a.case_id END AS document_number
  FROM approvals a LEFT JOIN both_sent b ON b.case_id = a.case_id""")
def _(t):
    stored = t.approvals.withColumn("approval_date", F.col("approval_date").cast("string"))
    return merge.store_approvals(stored, _sent_approvals(t))


@query("l15_cards_stored", f"""
  WITH {BOTH}
  SELECT coalesce(r.case_id, b.case_id) AS case_id, b.case_id IS NOT NULL OR r.original_received AS original_received,
    CASE WHEN b.case_id IS NULL THEN r.customer_copy_sent ELSE FALSE END AS customer_copy_sent
  FROM cards r FULL JOIN both_sent b ON b.case_id = r.case_id""")
def _(t):
    columns = ["case_id", "original_received", "customer_copy_sent"]
    sent = t.cases.select(F.col("id").alias("case_id"), F.lit(True).alias("original_received"), F.lit(False).alias("customer_copy_sent"))
    return merge.store_cards(t.cards.select(*columns), sent, _sent_approvals(t))


@query("l15_approval_events", f"""
  WITH {BOTH}
  SELECT c.id AS case_id, DATE '{TODAY}' AS event_date, '核准公文' AS event_type, c.status, '已更新核准公文與登記事項卡追蹤' AS detail
  FROM cases c SEMI JOIN both_sent b ON b.case_id = c.id""")
def _(t):
    return merge.approval_events(t.cases, _sent_approvals(t), AS_OF)


@query("i8_keep_manual_lists", """
  SELECT o_orderkey AS case_id, item, CASE WHEN item = 3 OR o_custkey % 4 = 0 THEN 'old' ELSE 'new,' || o_custkey END AS business
  FROM orders, (VALUES (1), (2), (3)) v(item)""")
def _(t):
    held = t.orders.select(F.col("o_orderkey").alias("case_id"), "o_custkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("item"))
    current = held.select("case_id", "item", F.array(F.lit("old")).alias("business"), (F.col("item") == 3).alias("manual_business"))
    none = F.array().cast("array<string>")
    parsed = held.select(
        "case_id", "item", F.when(F.col("o_custkey") % 4 == 0, none).otherwise(F.array(F.lit("new"), F.col("o_custkey").cast("string"))).alias("business")
    )
    kept = merge.keep_manual(current, parsed, ["case_id", "item"], ["business"])
    return kept.select("case_id", "item", F.array_join("business", ",").alias("business"))


@query("i8_keep_manual_values", """
  SELECT c.id, CASE WHEN c.case_type = '新設立' OR coalesce(p.representative, '') = '' THEN c.representative ELSE p.representative END AS representative,
    CASE WHEN c.entity_type = '行號' OR coalesce(p.registration_address, '') = '' THEN c.address ELSE p.registration_address END AS address
  FROM cases c LEFT JOIN preparation p ON p.case_id = c.id""")
def _(t):
    current = t.cases.select(
        "id", "representative", "address", (F.col("case_type") == "新設立").alias("manual_representative"),
        (F.col("entity_type") == "行號").alias("manual_address"),
    )
    parsed = t.preparation.select(F.col("case_id").alias("id"), "representative", F.col("registration_address").alias("address"))
    return merge.keep_manual(current, parsed, "id", ["representative", "address"]).select("id", "representative", "address")
