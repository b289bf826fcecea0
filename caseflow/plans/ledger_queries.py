"""Ledger queries: projections, filters, joins, aggregates, order and reminders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import days_between
from caseflow.operators import ledger
from caseflow.operators.ranking import numbered
from caseflow.plans.inputs import AS_OF
from caseflow.plans.inputs_sql import in_list
from caseflow.plans.registry import query
from caseflow.session import shared_folder

TODAY = f"DATE '{AS_OF.isoformat()}'"


@query("a1_scan_ledger", "SELECT id, case_number, received_date, status, paid_amount FROM cases")
def _(t):
    return t.cases.select("id", "case_number", "received_date", "status", "paid_amount")


@query("b1_case_projection", """
  SELECT id, case_number, received_date, year(received_date)::INT AS year, client_name, company_name, entity_type, case_type
  FROM cases""")
def _(t):
    return t.cases.select(
        "id", "case_number", "received_date", F.year("received_date").alias("year"), "client_name", "company_name",
        "entity_type", "case_type",
    )


@query("b2_cases_in_year", "SELECT id, received_date FROM cases WHERE year(received_date) = 1997")
def _(t):
    return ledger.in_year(t.cases, 1997).select("id", "received_date")


def _stored_by_year(t):
    path = f"{shared_folder(t.spark)}/cases-by-year-{uuid.uuid4().hex}"
    ledger.write_by_year(t.cases.select("id", "received_date", "status"), path)
    return t.spark.read.parquet(path)


@query("b2_stored_cases_in_year", "SELECT id, received_date, status FROM cases WHERE year(received_date) = 1997")
def _(t):
    return ledger.stored_in_year(_stored_by_year(t), 1997)


@query("b2_stored_cases_in_years", """
  SELECT id, received_date, status FROM cases
  WHERE year(received_date) IN (SELECT year(l_shipdate) FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM lineitem) / 7)""")
def _(t):
    shipped = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    busy = shipped.filter(F.col("n") > t.lineitem.agg(F.count(F.lit(1)) / 7).scalar())
    return ledger.stored_in_years(_stored_by_year(t), busy, "year")


@query("b3_receivables", """
  SELECT c.id, d.total_due, greatest(d.total_due - c.paid_amount, 0)::BIGINT AS outstanding
  FROM cases c JOIN due d ON d.id = c.id""")
def _(t):
    return ledger.with_receivables(t.cases, t.items).select("id", "total_due", "outstanding")


@query("b4_payment_status", "SELECT id, billing_status, payment_status FROM enriched")
def _(t):
    return ledger.with_receivables(t.cases, t.items).select("id", "billing_status", "payment_status")


@query("b5_search", """
  SELECT id, company_name, case_content, status FROM cases
  WHERE contains(lower(company_name || ' ' || tax_id || ' ' || case_content || ' ' || client_name), 'urgent')
    AND entity_type = '行號' AND status = '審查中'""")
def _(t):
    return ledger.search(t.cases, " URGENT ", "行號", "審查中").select("id", "company_name", "case_content", "status")


@query("b6_status_tone", f"""
  SELECT id, CASE {' '.join(f"WHEN status IN {in_list(v)} THEN '{k}'" for k, v in vocab.STATUS_TONES.items())}
      ELSE 'review' END AS tone,
    CASE WHEN tax_office_required = '不需要' THEN '免送國稅局' WHEN tax_office_required = '已完成' THEN '國稅局完成'
      WHEN tax_official_status <> '' THEN tax_official_status
      WHEN tax_office_required = '辦理中' OR status = '國稅局辦理' THEN '國稅局辦理中'
      WHEN tax_office_required = '需要' THEN '待辦國稅局' ELSE '尚未確認' END AS tax_summary
  FROM cases""")
def _(t):
    return t.cases.select("id", ledger.status_tone(F.col("status")).alias("tone"), ledger.tax_summary().alias("tax_summary"))


@query("c1_billing_left_join", """
  SELECT c.id, b.billed_total FROM cases c
  LEFT JOIN (SELECT case_id, sum(amount)::BIGINT AS billed_total FROM items GROUP BY case_id) b ON b.case_id = c.id""")
def _(t):
    totals = ledger.billing_totals(t.items).withColumnRenamed("case_id", "id")
    return t.cases.select("id").join(totals, "id", "left")


@query("c2_last_event_dates", """
  SELECT c.id, e.last_event_date, e.last_progress_date FROM cases c LEFT JOIN last_events e ON e.case_id = c.id""")
def _(t):
    dates = ledger.event_dates(t.history).withColumnRenamed("case_id", "id")
    return t.cases.select("id").join(dates, "id", "left")


@query("c3_seed_events", """
  SELECT c.id AS case_id, c.received_date AS event_date, '進度' AS event_type, c.status,
    CASE WHEN c.status_detail <> '' THEN c.status_detail ELSE '由舊版台帳匯入' END AS detail
  FROM cases c WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.case_id = c.id)""")
def _(t):
    from caseflow.operators.merge import seed_events

    return seed_events(t.cases, t.history)


@query("d1_billing_totals", """
  SELECT case_id, sum(amount)::BIGINT AS billed_total, count(*) AS item_count FROM items GROUP BY case_id""")
def _(t):
    return t.items.groupBy("case_id").agg(
        F.sum("amount").alias("billed_total"), F.count(F.lit(1)).alias("item_count")
    )


@query("d2_content_options", """
  SELECT entity_type, case_content, max(updated_at) AS last_used_at FROM cases
  WHERE trim(case_content) <> '' GROUP BY entity_type, case_content""")
def _(t):
    return ledger.content_options(t.cases).orderBy(F.desc("last_used_at"), "case_content")


REMINDERS = f"""
  base AS (
    SELECT *, status NOT IN {in_list(vocab.CLOSED)} AS is_open,
      greatest(({TODAY} - coalesce(last_progress_date, received_date)), 0) AS stale_days,
      greatest(({TODAY} - coalesce(billing_date, last_event_date, received_date)), 0) AS waited
    FROM enriched),
  flagged AS (SELECT *, is_open AND coalesce(next_follow_up_date <= {TODAY}, FALSE) AS is_due FROM base),
  reminders AS (
    SELECT id, company_name, 'supplement' AS kind, '補件待處理' AS title,
      CASE WHEN status_detail = '' THEN '請確認補件內容' ELSE status_detail END AS message, 1 AS priority
    FROM flagged WHERE status = '補件'
    UNION ALL SELECT id, company_name, 'pickup', '案件可領件', '可安排前往市政府領件', 1 FROM flagged WHERE status = '可自領'
    UNION ALL SELECT id, company_name, 'tax', '尚待國稅局', '領件後仍需辦理國稅局', 1 FROM flagged
      WHERE status = '已領件' AND tax_office_required = '需要'
    UNION ALL SELECT id, company_name, 'tax-check', '確認國稅局流程', '請確認這件是否需要再跑國稅局', 2 FROM flagged
      WHERE status = '已領件' AND tax_office_required = '未確認'
    UNION ALL SELECT id, company_name, 'follow-up', '已到追蹤日', '原訂 ' || next_follow_up_date || ' 追蹤', 1 FROM flagged WHERE is_due
    UNION ALL SELECT id, company_name, 'stale', CASE WHEN status = '準備中' THEN '等待客戶資料' ELSE '進度待追蹤' END,
      stale_days || ' 天沒有更新進度', CASE WHEN stale_days >= 14 THEN 1 ELSE 2 END
      FROM flagged WHERE is_open AND NOT is_due AND status NOT IN {in_list(vocab.NEVER_STALE)}
        AND stale_days >= CASE WHEN status = '準備中' THEN 5 ELSE 7 END
    UNION ALL SELECT id, company_name, 'unbilled', '結案尚未請款', '請建立收費明細並向客戶請款', 1 FROM flagged
      WHERE status = '結案' AND billing_status = '未請款'
    UNION ALL SELECT id, company_name, 'unpaid', '請款尚未收款',
      '已請款 ' || waited || ' 天，尚有 ' || format('{{:,}}', outstanding) || ' 元未收', CASE WHEN waited >= 30 THEN 1 ELSE 2 END
      FROM flagged WHERE billing_status = '已請款' AND outstanding > 0 AND waited >= 7)"""


def _reminders(t):
    return ledger.reminders(ledger.enrich(t.cases, t.items, t.history), AS_OF)


@query("d3_kpis", f"""
  WITH {REMINDERS}
  SELECT count(*) FILTER (status NOT IN {in_list(vocab.CLOSED)}) AS active,
    count(*) FILTER (status IN {in_list(vocab.PREPARING)}) AS preparing,
    count(*) FILTER (status IN {in_list(vocab.GOVERNMENT)}) AS government, (SELECT count(*) FROM reminders) AS reminders
  FROM cases""")
def _(t):
    return ledger.kpis(t.cases, _reminders(t))


@query("d4_reminder_counts", f"""
  WITH {REMINDERS}
  SELECT kind, priority, count(*) AS reminder_count FROM reminders GROUP BY kind, priority""")
def _(t):
    return _reminders(t).groupBy("kind", "priority").agg(F.count(F.lit(1)).alias("reminder_count"))


@query("d5_last_sequence", """
  SELECT substr(case_number, 1, 4) AS year_text, max(try_cast(substr(case_number, 6) AS BIGINT)) AS last_sequence
  FROM cases GROUP BY 1""")
def _(t):
    return ledger.last_sequence(t.cases)


@query("e1_first_event_moved", """
  WITH firsts AS (SELECT case_id, min(id) AS first_id FROM history GROUP BY case_id)
  SELECT h.id, h.case_id,
    CASE WHEN f.first_id IS NOT NULL AND c.received_date IS NOT NULL THEN c.received_date ELSE h.event_date END AS event_date
  FROM history h LEFT JOIN firsts f ON f.first_id = h.id LEFT JOIN cases c ON c.id = h.case_id""")
def _(t):
    from caseflow.operators.merge import move_first_events

    starts = t.cases.select(F.col("id").alias("case_id"), F.col("received_date").alias("start_date"))
    return move_first_events(t.history, starts).select("id", "case_id", "event_date")


@query("e2_timeline", """
  SELECT case_id, id, event_date, row_number() OVER (PARTITION BY case_id ORDER BY event_date DESC, id DESC) AS position
  FROM history""")
def _(t):
    return ledger.timeline(t.history.select("case_id", "id", "event_date"))


@query("e2_latest_event", """
  SELECT case_id, id, event_date, status FROM history
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY event_date DESC, id DESC) = 1""")
def _(t):
    newest = F.struct("event_date", "id")
    latest = t.history.groupBy("case_id").agg(F.max_by(F.struct("id", "event_date", "status"), newest).alias("e"))
    return latest.select("case_id", "e.*")


@query("e3_case_numbers", """
  WITH used AS (
    SELECT substr(case_number, 1, 4) AS y, max(try_cast(substr(case_number, 6) AS BIGINT)) AS n FROM cases GROUP BY 1),
  intake AS (
    SELECT user_id AS input_user, event_id AS input_pos, (ts::DATE - INTERVAL 26 YEAR)::DATE AS received_date FROM events),
  placed AS (
    SELECT *, row_number() OVER (PARTITION BY year(received_date) ORDER BY input_pos) AS place FROM intake)
  SELECT input_pos, received_date,
    year(received_date)::VARCHAR || '-' || printf('%03d', coalesce(n, 0) + place) AS case_number
  FROM placed LEFT JOIN used ON y = year(received_date)::VARCHAR""")
def _(t):
    intake = t.events.select(
        F.col("event_id").alias("input_pos"), F.add_months(F.col("ts").cast("date"), -12 * 26).alias("received_date")
    )
    return ledger.assign_case_numbers(intake, t.cases).select("input_pos", "received_date", "case_number")


@query("f1_ledger_order", """
  SELECT id, case_number, received_date, year, company_name, status, total_due, paid_amount, outstanding::BIGINT AS outstanding,
    payment_status, last_event_date, last_progress_date FROM enriched""")
def _(t):
    rows = ledger.enrich(t.cases, t.items, t.history).select(
        "id", "case_number", "received_date", "year", "company_name", "status", "total_due", "paid_amount", "outstanding",
        "payment_status", "last_event_date", "last_progress_date",
    )
    return rows.orderBy(*ledger.ledger_order())


@query("f2_reminder_order", f"""
  WITH {REMINDERS}
  SELECT id || '-' || kind AS id, company_name, kind, priority FROM reminders""")
def _(t):
    return _reminders(t).select("id", "company_name", "kind", "priority").orderBy(*ledger.reminder_order())


@query("f3_top_reminders", f"""
  WITH {REMINDERS}
  SELECT id || '-' || kind AS id, company_name, kind, priority FROM reminders
  ORDER BY priority, company_name, id || '-' || kind LIMIT 8""")
def _(t):
    return (
        _reminders(t).select("id", "company_name", "kind", "priority").orderBy(*ledger.reminder_order(None)).limit(8)
    )


@query("f5_office_order", """
  SELECT id, name, is_default, active,
    row_number() OVER (ORDER BY is_default DESC, active DESC, name, id) AS place FROM offices""")
def _(t):
    order = [F.desc("is_default"), F.desc("active"), F.col("name"), F.col("id")]
    # Flags and the beginning of the name: a rising slice of the order.
    part = F.struct(~F.col("is_default"), ~F.col("active"), F.substring("name", 1, 14))
    return numbered(t.offices.select("id", "name", "is_default", "active"), [], order, "place", part)


@query("g1_reminders", f"""
  WITH {REMINDERS}
  SELECT id || '-' || kind AS id, id AS case_id, company_name, kind, title, message, priority FROM reminders""")
def _(t):
    return _reminders(t).select("id", "case_id", "company_name", "kind", "title", "message", "priority")


@query("h4_days_between", f"""
  SELECT id, greatest({TODAY} - received_date, 0) AS age_days,
    coalesce(greatest(submitted_date - billing_date, 0), 0) AS lag_days FROM cases""")
def _(t):
    return t.cases.select(
        "id",
        days_between(F.col("received_date"), F.lit(AS_OF)).alias("age_days"),
        days_between(F.col("billing_date"), F.col("submitted_date")).alias("lag_days"),
    )
