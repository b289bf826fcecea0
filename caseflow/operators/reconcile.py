"""Matching cases with externally published progress records."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import app_status, clean_text, first_filled, once, progress_url, roc_rank, roc_to_iso


def receipt_links(cases: DataFrame, keys: list[str], receipt: str) -> DataFrame:
    """One row per linked receipt: the case it links to (highest id) and the lowest id that holds it."""
    held = cases.filter(F.col(receipt) != "")
    return held.groupBy(*keys, F.col(receipt).alias("receipt_no")).agg(
        F.max("id").alias("linked_id"), F.min("id").alias("lowest_linked_id"),
        F.max_by("case_number", "id").alias("linked_case_number"),
    )


def annotate_candidates(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """External candidates with the case that already holds their receipt and whether they are recommended."""
    current = cases.select(
        F.col("id").alias("case_id"), "entity_type", "tax_id",
        F.coalesce("submitted_date", "received_date").cast("string").alias("target_date"),
        F.col("official_receipt_no").alias("stored_receipt"),
    )
    links = receipt_links(cases, ["entity_type", "tax_id"], "official_receipt_no")
    joined = candidates.join(current, "case_id").join(links, ["entity_type", "tax_id", "receipt_no"], "left")
    return joined.withColumn("received_iso", once(roc_to_iso("received_date"))).withColumns(
        {
            "is_current": F.col("linked_id") == F.col("case_id"),
            "recommended": F.col("linked_id").isNull() & (F.col("received_iso") == F.col("target_date")),
        }
    ).drop("lowest_linked_id", "linked_case_number")


def candidate_rank() -> list[Column]:
    """Rising keys of a candidate: its date, then its receipt as text. The best candidate has the highest."""
    return [roc_rank("received_date"), F.coalesce(F.col("receipt_no"), F.lit(""))]


def candidate_order() -> list[Column]:
    """Newest first, then receipt descending."""
    return [key.desc() for key in candidate_rank()]


def choose_candidates(candidates: DataFrame, cases: DataFrame, tie_break: list[str]) -> DataFrame:
    """One row per case that has candidates: the chosen one and how, or an ambiguous mark.

    ``tie_break`` names numbers, of which the lowest wins.

    The stored receipt wins; else the only available one on the target date; else the only available one.
    One aggregate per case with map-side combine, so a case with very many candidates stays cheap.
    """
    marked = annotate_candidates(candidates, cases)
    available = F.col("linked_id").isNull() | F.coalesce("is_current", F.lit(False))
    on_date = available & (F.col("received_iso") == F.col("target_date"))
    exact = (F.col("stored_receipt") != "") & (F.col("receipt_no") == F.col("stored_receipt"))
    row = F.struct("receipt_no", "received_date", "official_status", "authority", *tie_break)
    order = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(candidate_rank())], *[(-F.col(t)).alias(t) for t in tie_break])
    first = lambda test: F.max_by(F.when(test, row), F.when(test, F.col("_order")))
    picked = marked.withColumn("_order", once(order)).groupBy("case_id").agg(
        first(exact).alias("_exact"),
        first(on_date).alias("_dated"), F.count_if(on_date).alias("_dated_n"),
        first(available).alias("_available"), F.count_if(available).alias("available_count"),
    )
    how = (
        F.when(F.col("_exact").isNotNull(), "receipt")
        .when(F.col("_dated_n") == 1, "date")
        .when(F.col("available_count") == 1, "single")
        .otherwise("ambiguous")
    )
    chosen = (
        F.when(F.col("how") == "receipt", F.col("_exact"))
        .when(F.col("how") == "date", F.col("_dated"))
        .when(F.col("how") == "single", F.col("_available"))
    )
    return picked.withColumn("how", how).withColumn("_chosen", chosen).select(
        "case_id", "how", "available_count",
        *[F.col("_chosen")[c].alias(c) for c in ["receipt_no", "received_date", "official_status", "authority"]],
    )


def official_updates(cases: DataFrame, chosen: DataFrame, as_of: datetime.date) -> DataFrame:
    """New progress fields per case with a chosen record, whether anything changed and the change text.

    ``conflict`` marks a receipt that another case of the same entity already holds; such rows are not applied.
    """
    records = chosen.filter("how <> 'ambiguous'").select(
        F.col("case_id").alias("id"), F.col("receipt_no").alias("n_receipt"), F.col("received_date").alias("n_received"),
        clean_text("official_status", 100).alias("n_status"), F.col("authority").alias("n_authority"),
    )
    links = receipt_links(cases, ["entity_type", "tax_id"], "official_receipt_no").withColumnRenamed("receipt_no", "n_receipt")
    current = cases.select(
        "id", "entity_type", "tax_id", "status", "status_detail", "official_receipt_no", "official_status", "reg_unit_code",
        "submitted_date", "authority",
    )
    joined = current.join(records, "id").join(links, ["entity_type", "tax_id", "n_receipt"], "left")
    protected = F.col("status").isin(vocab.PROTECTED)
    next_status = F.when(protected, F.col("status")).otherwise(app_status("n_status"))
    detail = F.concat(
        F.lit("官方網站："), "n_status", F.when(F.contains("n_status", F.lit("發文中")), "（尚未可領件）").otherwise("")
    )
    receipt = first_filled("n_receipt", "official_receipt_no")
    unit = first_filled("reg_unit_code", F.lit("17"))
    changes = F.concat_ws(
        "；",
        F.when((receipt != "") & (receipt != F.col("official_receipt_no")), F.concat(F.lit("帶入收文號 "), receipt)),
        F.when(
            (F.col("n_status") != "") & (F.col("n_status") != F.col("official_status")),
            F.concat(F.lit("官方進度："), "n_status"),
        ),
        F.when(next_status != F.col("status"), F.concat(F.lit("系統進度更新為 "), next_status)),
    )
    changed = (
        (receipt != F.col("official_receipt_no")) | (F.col("n_status") != F.col("official_status")) | (next_status != F.col("status"))
    )
    others = (F.col("linked_id") != F.col("id")) | (F.col("lowest_linked_id") != F.col("id"))
    return joined.select(
        "id",
        F.coalesce(others, F.lit(False)).alias("conflict"),
        changed.alias("changed"),
        next_status.alias("status"),
        F.when(protected, F.col("status_detail")).otherwise(detail).alias("status_detail"),
        receipt.alias("official_receipt_no"),
        F.col("n_status").alias("official_status"),
        unit.alias("reg_unit_code"),
        F.coalesce(F.col("submitted_date").cast("string"), F.nullif(roc_to_iso("n_received"), F.lit("")), F.lit(as_of.isoformat()))
        .alias("submitted_date"),
        first_filled("n_authority", "authority").alias("authority"),
        progress_url(receipt, unit, "entity_type", F.lit(""), F.lit("")).alias("progress_url"),
        first_filled(changes, detail).alias("change_text"),
    )


def official_events(updates: DataFrame, as_of: datetime.date) -> DataFrame:
    """One history event per applied update that changed its case."""
    return updates.filter("changed AND NOT conflict").select(
        F.col("id").alias("case_id"), F.lit(as_of).alias("event_date"), F.lit("官方查詢").alias("event_type"), "status",
        F.col("change_text").alias("detail"),
    )


def tax_updates(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Tax progress per case: need, label and detail text; ``conflict`` marks a receipt another case holds.

    ``records`` has case_id, bureau_code, receipt_no, received_date, case_type and official_status.
    """
    short_names = F.create_map(*[F.lit(x) for code, _, short, _ in vocab.BUREAUS for x in (code, short)])
    links = receipt_links(cases, ["tax_id"], "tax_receipt_no")
    joined = (
        records.withColumn("bureau_code", F.upper(clean_text("bureau_code", 3)))
        .filter(F.col("bureau_code").isin([b[0] for b in vocab.BUREAUS]))
        .join(cases.select(F.col("id").alias("case_id"), "tax_id"), "case_id")
        .join(links, ["tax_id", "receipt_no"], "left")
    )
    completed = F.col("official_status").rlike("已發文|結案|完成")
    others = (F.col("linked_id") != F.col("case_id")) | (F.col("lowest_linked_id") != F.col("case_id"))
    detail = F.concat_ws(
        "・",
        short_names[F.col("bureau_code")],
        first_filled("receipt_no", F.lit("無文號")),
        first_filled("case_type", F.lit("稅籍登記")),
        first_filled("official_status", F.lit("已查詢")),
    )
    return joined.select(
        "case_id", "bureau_code", "receipt_no", "received_date", "official_status",
        F.coalesce(others, F.lit(False)).alias("conflict"),
        F.when(completed, "已完成").otherwise("辦理中").alias("tax_office_required"),
        F.when(completed, "國稅局已完成").otherwise("國稅局辦理中").alias("label"),
        detail.alias("detail"),
    )


def tax_events(updates: DataFrame, history: DataFrame, as_of: datetime.date) -> DataFrame:
    """Tax events for applied updates, leaving out those the history already holds word for word."""
    new = updates.filter("NOT conflict").select(
        "case_id",
        first_filled(roc_to_iso("received_date"), F.lit(as_of.isoformat())).alias("event_date"),
        F.lit("國稅局查詢").alias("event_type"),
        F.col("label").alias("status"),
        "detail",
    )
    keys = ["case_id", "event_type", "status", "detail"]
    known = history.filter("event_type = '國稅局查詢'").select(*keys).distinct()
    return new.join(known, keys, "left_anti")


def link_conflicts(cases: DataFrame, keys: list[str], receipt: str) -> DataFrame:
    """Receipts that more than one case holds."""
    held = cases.filter(F.col(receipt) != "")
    counted = held.groupBy(*keys, F.col(receipt).alias("receipt_no")).agg(
        F.count(F.lit(1)).alias("case_count"), F.min("id").alias("lowest_id"), F.max("id").alias("highest_id")
    )
    return counted.filter("lowest_id <> highest_id")


def pick_result(asked: DataFrame, results: DataFrame) -> DataFrame:
    """The result with the asked receipt (marked missing if absent), or the newest when none was asked for.

    ``asked`` has query_id and receipt_no; ``results`` has query_id, receipt_no, received_date.
    """
    clean = F.regexp_replace(F.coalesce(F.col("receipt_no"), F.lit("")), r"[^\dA-Za-z-]", "")
    wanted = asked.select("query_id", clean.alias("_wanted"))
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(candidate_rank())])
    joined = results.join(wanted, "query_id")
    usable = (F.col("_wanted") == "") | (F.col("receipt_no") == F.col("_wanted"))
    row = F.struct("receipt_no", "received_date")
    best = joined.groupBy("query_id").agg(
        F.max_by(F.when(usable, row), F.when(usable, rank)).alias("r")
    )
    return wanted.join(best, "query_id", "left").select(
        "query_id", F.col("r.receipt_no").alias("receipt_no"), F.col("r.received_date").alias("received_date"),
        F.col("r").isNull().alias("not_found"),
    )
