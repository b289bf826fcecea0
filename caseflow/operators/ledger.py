"""Case ledger: enriched rows, receivables, KPIs, option lists and dated reminders."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import days_between, first_filled
from caseflow.operators.ranking import lookup, numbered


# Intake rows of one year are spread over so many tasks.
YEAR_COPIES = 16


def billing_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("case_id").agg(F.sum("amount").alias("billed_total"))


def event_dates(history: DataFrame, progress_type: str = "進度") -> DataFrame:
    """Last event and last progress event per case in one pass."""
    progress = F.when(F.col("event_type") == progress_type, F.col("event_date"))
    return history.groupBy("case_id").agg(
        F.max("event_date").alias("last_event_date"), F.max(progress).alias("last_progress_date")
    )


def total_due() -> Column:
    return F.coalesce(F.col("billed_total"), F.col("service_fee") + F.col("government_fee"))


def payment_status(due: Column) -> Column:
    return (
        F.when(F.col("billing_status") == "未請款", "未請款")
        .when(F.col("billing_status") == "已收款", "已收款")
        .when((due > 0) & (F.col("paid_amount") >= due), "已收款")
        .when(F.col("paid_amount") > 0, "部分收款")
        .otherwise("待收款")
    )


def with_receivables(cases: DataFrame, items: DataFrame) -> DataFrame:
    joined = cases.join(billing_totals(items).withColumnRenamed("case_id", "id"), "id", "left")
    due = F.col("total_due")
    return (
        joined.withColumn("total_due", total_due())
        .withColumn("outstanding", F.greatest(due - F.col("paid_amount"), F.lit(0)))
        .withColumn("payment_status", payment_status(due))
        .drop("billed_total")
    )


def enrich(cases: DataFrame, items: DataFrame, history: DataFrame) -> DataFrame:
    """One wide row per case: year, receivables and event dates."""
    dates = event_dates(history).withColumnRenamed("case_id", "id")
    return with_receivables(cases, items).join(dates, "id", "left").withColumn("year", F.year("received_date"))


def in_year(cases: DataFrame, year: int) -> DataFrame:
    """Cases received in a year, as a date range so that Parquet statistics can skip files."""
    day = F.col("received_date")
    return cases.filter((day >= datetime.date(year, 1, 1)) & (day <= datetime.date(year, 12, 31)))


def write_by_year(cases: DataFrame, path: str) -> None:
    """Write cases in a folder per year received, each file holding a run of days; a busy year spreads over several tasks.

    Cases without a received date lie in a folder of their own, which no year reads.
    """
    dated = cases.withColumn("received_year", F.year("received_date"))
    dated.repartitionByRange("received_year", "received_date", "id").sortWithinPartitions("received_year", "received_date").write.partitionBy("received_year").parquet(path)


def stored_in_year(stored: DataFrame, year: int) -> DataFrame:
    """Cases of one year from what ``write_by_year`` wrote: only that year's folder is listed and read."""
    return stored.filter(F.col("received_year") == year).drop("received_year")


def stored_in_years(stored: DataFrame, years: DataFrame, year: str) -> DataFrame:
    """Cases of the years that a table lists; Spark prunes the folders when the list is known, at run time."""
    listed = years.select(F.col(year).cast("int").alias("received_year")).distinct()
    return stored.join(listed, "received_year", "left_semi").drop("received_year")


def ledger_order() -> list[Column]:
    return [F.col("received_date").desc(), F.col("id").desc()]


def search(cases: DataFrame, needle: str = "", entity: str = "", status: str = "") -> DataFrame:
    found = cases
    text = F.lower(F.concat_ws(" ", "company_name", "tax_id", "case_content", "client_name"))
    if needle.strip():
        found = found.filter(text.contains(needle.strip().lower()))
    if entity:
        found = found.filter(F.col("entity_type") == entity)
    if status:
        found = found.filter(F.col("status") == status)
    return found


def status_tone(status: Column) -> Column:
    tone = F.lit("review")
    for name, members in reversed(vocab.STATUS_TONES.items()):
        tone = F.when(status.isin(members), name).otherwise(tone)
    return tone


def tax_summary() -> Column:
    need = F.col("tax_office_required")
    return (
        F.when(need == "不需要", "免送國稅局")
        .when(need == "已完成", "國稅局完成")
        .when(F.col("tax_official_status") != "", F.col("tax_official_status"))
        .when((need == "辦理中") | (F.col("status") == "國稅局辦理"), "國稅局辦理中")
        .when(need == "需要", "待辦國稅局")
        .otherwise("尚未確認")
    )


def content_options(cases: DataFrame) -> DataFrame:
    return (
        cases.filter(F.trim("case_content") != "")
        .groupBy("entity_type", "case_content")
        .agg(F.max("updated_at").alias("last_used_at"))
    )


def kpis(cases: DataFrame, due: DataFrame | None = None) -> DataFrame:
    """Dashboard counts; with the rows of ``reminders`` given as ``due``, their number too."""
    status = F.col("status")
    counts = cases.agg(
        F.count_if(~status.isin(vocab.CLOSED)).alias("active"),
        F.count_if(status.isin(vocab.PREPARING)).alias("preparing"),
        F.count_if(status.isin(vocab.GOVERNMENT)).alias("government"),
    )
    if due is None:
        return counts
    return counts.withColumn("reminders", due.agg(F.count(F.lit(1))).scalar())


def last_sequence(cases: DataFrame) -> DataFrame:
    """Highest case number used in each year; numbering continues after it."""
    return cases.groupBy(F.substring("case_number", 1, 4).alias("year_text")).agg(
        F.max(F.expr("try_cast(substr(case_number, 6) AS BIGINT)")).alias("last_sequence")
    )


def assign_case_numbers(intake: DataFrame, cases: DataFrame, position: str = "input_pos", slice_rows: int = 1_000_000) -> DataFrame:
    """Give each intake row the next ``YYYY-NNN`` of its year, in input order; ``position`` is a whole number."""
    rows = intake.withColumn("year_text", F.year("received_date").cast("string"))
    placed = numbered(rows, ["year_text"], [F.col(position)], "place", F.floor(F.col(position) / slice_rows))
    used = last_sequence(cases)
    number = F.coalesce(F.col("last_sequence"), F.lit(0)) + F.col("place")
    return lookup(placed, used, ["year_text"], [position], copies=YEAR_COPIES).withColumn(
        "case_number", F.concat("year_text", F.lit("-"), F.format_string("%03d", number))
    ).drop("last_sequence", "place", "year_text")


def timeline(history: DataFrame) -> DataFrame:
    """Position of each event in its case, newest first; a busy case is numbered day by day."""
    order = [F.col("event_date").desc(), F.col("id").desc()]
    return numbered(history, ["case_id"], order, "position", -F.unix_date("event_date"))


def reminders(enriched: DataFrame, as_of: datetime.date) -> DataFrame:
    """All reminders of all cases in one pass over the enriched rows."""
    today = F.lit(as_of)
    status, tax = F.col("status"), F.col("tax_office_required")
    follow_up = F.col("next_follow_up_date")
    is_open = ~status.isin(vocab.CLOSED)
    stale_days = days_between(F.coalesce("last_progress_date", "received_date"), today)
    waited = days_between(F.coalesce("billing_date", "last_event_date", "received_date"), today)
    is_due = is_open & F.coalesce(follow_up <= today, F.lit(False))
    preparing = status == "準備中"

    def rule(test: Column, kind: str, title, message, priority) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(
            test,
            F.struct(
                F.lit(kind).alias("kind"),
                as_column(title).alias("title"),
                as_column(message).alias("message"),
                as_column(priority).cast("int").alias("priority"),
            ),
        )

    rules = [
        rule(status == "補件", "supplement", "補件待處理", first_filled("status_detail", F.lit("請確認補件內容")), 1),
        rule(status == "可自領", "pickup", "案件可領件", "可安排前往市政府領件", 1),
        rule((status == "已領件") & (tax == "需要"), "tax", "尚待國稅局", "領件後仍需辦理國稅局", 1),
        rule((status == "已領件") & (tax == "未確認"), "tax-check", "確認國稅局流程", "請確認這件是否需要再跑國稅局", 2),
        rule(is_due, "follow-up", "已到追蹤日", F.concat(F.lit("原訂 "), follow_up.cast("string"), F.lit(" 追蹤")), 1),
        rule(
            is_open & ~is_due & ~status.isin(vocab.NEVER_STALE) & (stale_days >= F.when(preparing, 5).otherwise(7)),
            "stale",
            F.when(preparing, "等待客戶資料").otherwise("進度待追蹤"),
            F.concat(stale_days.cast("string"), F.lit(" 天沒有更新進度")),
            F.when(stale_days >= 14, 1).otherwise(2),
        ),
        rule((status == "結案") & (F.col("billing_status") == "未請款"), "unbilled", "結案尚未請款", "請建立收費明細並向客戶請款", 1),
        rule(
            (F.col("billing_status") == "已請款") & (F.col("outstanding") > 0) & (waited >= 7),
            "unpaid",
            "請款尚未收款",
            F.concat(
                F.lit("已請款 "), waited.cast("string"), F.lit(" 天，尚有 "), F.format_number("outstanding", 0), F.lit(" 元未收")
            ),
            F.when(waited >= 30, 1).otherwise(2),
        ),
    ]
    found = enriched.select(
        F.col("id").alias("case_id"), "company_name", "tax_id", "entity_type", "case_type", "case_content", "status",
        F.explode(F.array_compact(F.array(*rules))).alias("r"),
    )
    return found.select(
        F.concat(F.col("case_id").cast("string"), F.lit("-"), F.col("r.kind")).alias("id"),
        *[c for c in found.columns if c != "r"],
        "r.*",
    )


def reminder_order(collation: str | None = "zh_Hant_TWN") -> list[Column]:
    """Priority, then company name by collation (binary without one), then id."""
    name = F.collate("company_name", collation) if collation else F.col("company_name")
    return [F.col("priority"), name, F.col("id")]
