"""Keyed batch merges. Plain Parquet has no MERGE, so each job returns the complete new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import amount, clean_text, first_filled


def seed_events(cases: DataFrame, history: DataFrame, event_type: str = "進度", text: str = "由舊版台帳匯入") -> DataFrame:
    """One starting event for every case that has none."""
    known = history.select(F.col("case_id").alias("id")).distinct()
    return cases.join(known, "id", "left_anti").select(
        F.col("id").alias("case_id"),
        F.col("received_date").alias("event_date"),
        F.lit(event_type).alias("event_type"),
        "status",
        first_filled("status_detail", F.lit(text)).alias("detail"),
    )


def move_first_events(history: DataFrame, starts: DataFrame) -> DataFrame:
    """Date the lowest-id event of each case in ``starts`` at its ``start_date``.

    The first events join back on (case_id, id), which is unique, so a case with many events spreads out.
    """
    firsts = history.groupBy("case_id").agg(F.min("id").alias("id")).join(starts, "case_id")
    moved = history.join(firsts, ["case_id", "id"], "left")
    return moved.withColumn("event_date", F.coalesce("start_date", "event_date")).select(*history.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target with updates laid over it; the update with the highest ``order`` wins a key.

    One shuffle on the keys; each side is cut to one row per key before it.
    """
    values = [c for c in target.columns if c not in keys]
    rank = ["_is_update", *[f"_order_{c}" for c in order]]
    old = target.select(
        *keys, F.struct(*values).alias("_row"), F.lit(0).alias("_is_update"),
        *[F.lit(None).cast(dict(updates.dtypes)[c]).alias(f"_order_{c}") for c in order],
    )
    new = updates.select(
        *keys, F.struct(*values).alias("_row"), F.lit(1).alias("_is_update"), *[F.col(c).alias(f"_order_{c}") for c in order]
    )
    merged = old.unionByName(new).groupBy(*keys).agg(F.max_by("_row", F.struct(*rank)).alias("_row"))
    return merged.select(*keys, "_row.*").select(*target.columns)


def replace_children(children: DataFrame, replacements: DataFrame, key: str) -> DataFrame:
    """Children of every parent named in ``replacements`` give way to the new rows."""
    parents = replacements.select(key).distinct()
    return children.join(parents, key, "left_anti").unionByName(replacements)


def clean_items(raw: DataFrame) -> DataFrame:
    """Billing rows with positions from the source order; wholly blank rows go, nameless ones are flagged."""
    kept = raw.select(
        "case_id",
        clean_text("item_name", 200).alias("item_name"),
        F.coalesce(amount(F.col("amount_text")), F.lit(0).cast("long")).alias("amount"),
        amount(F.col("amount_text")).isNull().alias("bad_amount"),
        clean_text("notes", 500).alias("notes"),
        (F.col("position") - 1).cast("int").alias("sort_order"),
    )
    return kept.filter((F.col("item_name") != "") | (F.col("amount") != 0) | (F.col("notes") != "") | F.col("bad_amount")).withColumn(
        "missing_name", F.col("item_name") == ""
    )


def apply_billing(cases: DataFrame, billing: DataFrame, items: DataFrame) -> DataFrame:
    """Cases after their billing form was saved: fees are zeroed and a fully paid bill settles itself.

    ``billing`` has case_id, billing_status, billing_date, paid_amount and payment_date.
    """
    totals = items.groupBy("case_id").agg(F.sum("amount").alias("new_total"))
    forms = billing.join(totals, "case_id", "left").select(
        F.col("case_id").alias("id"),
        F.coalesce("new_total", F.lit(0)).alias("new_total"),
        *[F.col(c).alias(f"new_{c}") for c in ["billing_status", "billing_date", "paid_amount", "payment_date"]],
    )
    joined = cases.join(forms, "id", "left")
    has_form = F.col("new_billing_status").isNotNull()
    settled = (F.col("new_total") > 0) & (F.col("new_paid_amount") >= F.col("new_total"))
    value = lambda c, new: F.when(has_form, new).otherwise(F.col(c)).alias(c)
    changed = {
        "billing_status": F.when(settled, "已收款").otherwise(F.col("new_billing_status")),
        "billing_date": F.col("new_billing_date"),
        "paid_amount": F.col("new_paid_amount"),
        "payment_date": F.col("new_payment_date"),
        "service_fee": F.lit(0).cast("long"),
        "government_fee": F.lit(0).cast("long"),
    }
    return joined.select(*[value(c, changed[c]) if c in changed else F.col(c) for c in cases.columns])


def delete_cases(deleted: DataFrame, cases: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cases and their child tables without the ids in ``deleted``."""
    ids = deleted.select("id").distinct()
    as_child = ids.withColumnRenamed("id", "case_id")
    kept = {name: table.join(as_child, "case_id", "left_anti") for name, table in children.items()}
    return {"cases": cases.join(ids, "id", "left_anti"), **kept}


def delete_events(history: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History without the requested (case_id, id) events, and the requests that matched none."""
    wanted = requests.select("case_id", "id").distinct()
    kept = history.join(wanted, ["case_id", "id"], "left_anti")
    missed = wanted.join(history.select("case_id", "id"), ["case_id", "id"], "left_anti")
    return kept, missed


def apply_events(cases: DataFrame, posted: DataFrame) -> DataFrame:
    """Fold posted events, in id order, into case status and dates with one aggregate per case."""
    at = lambda status: F.min_by(
        F.when(F.col("status") == status, F.col("event_date")), F.when(F.col("status") == status, F.col("id"))
    )
    folded = posted.groupBy(F.col("case_id").alias("id")).agg(
        F.min("event_date").alias("_earliest"),
        F.max_by(F.struct("status", "detail"), "id").alias("_last"),
        at("已送件").alias("_submitted"),
        at("結案").alias("_closed"),
    )
    joined = cases.join(folded, "id", "left")
    changed = {
        "received_date": F.least("received_date", "_earliest"),
        "status": F.coalesce("_last.status", "status"),
        "status_detail": F.coalesce("_last.detail", "status_detail"),
        "submitted_date": F.coalesce("submitted_date", "_submitted"),
        "closed_date": F.coalesce("closed_date", "_closed"),
    }
    result = joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in cases.columns], "_earliest", F.col("received_date").alias("_was"))
    return result.withColumn("received_date_adjusted", F.coalesce(F.col("_earliest") < F.col("_was"), F.lit(False))).drop("_earliest", "_was")


def label_events(posted: DataFrame, bureau_names: dict[str, str]) -> DataFrame:
    """Event rows for posted forms: a form that changes only tax fields is logged as a tax event.

    ``posted`` carries the form's fields and the case's present ones, the latter prefixed ``cur_``.
    """
    differs = lambda name: ~F.coalesce(F.col(name).cast("string"), F.lit("")).eqNullSafe(
        F.coalesce(F.col(f"cur_{name}").cast("string"), F.lit(""))
    )
    tax_changed = differs("tax_office_required") | differs("tax_bureau_code")
    unit = first_filled("reg_unit_code", F.lit("17")) != first_filled("cur_reg_unit_code", F.lit("17"))
    progress = unit
    for name in ["status", "status_detail", "official_receipt_no", "submitted_date", "next_follow_up_date"]:
        progress = progress | differs(name)
    tax_only = tax_changed & ~progress
    labels = F.create_map(*[F.lit(x) for pair in vocab.TAX_OFFICE_LABELS.items() for x in pair])
    bureaus = F.create_map(*[F.lit(x) for pair in bureau_names.items() for x in pair])
    label = labels[F.col("tax_office_required")]
    bureau = F.coalesce(bureaus[F.col("tax_bureau_code")], F.lit("未選擇區局"))
    return posted.select(
        "case_id",
        "event_date",
        F.when(tax_only, "國稅局").otherwise("進度").alias("event_type"),
        F.when(tax_only, label).otherwise(F.col("status")).alias("status"),
        F.when(tax_only, F.concat(F.lit("國稅局進度更新為「"), label, F.lit("」・"), bureau))
        .otherwise(F.col("status_detail")).alias("detail"),
    )


def exclusive_default(offices: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply default-flag requests (id, is_default, seq): the last one set true clears every other office."""
    best = requests.filter("is_default").agg(F.struct(F.max_by("id", "seq").alias("id"), F.max("seq").alias("seq")).alias("won"))
    won = best.scalar()
    last = requests.groupBy("id").agg(F.max_by("is_default", "seq").alias("_asked"), F.max("seq").alias("_asked_at"))
    joined = offices.join(last, "id", "left")
    dropped_later = (F.col("_asked_at") > won["seq"]) & ~F.col("_asked")
    flag = F.when(won["id"].isNull(), F.col("is_default") & F.coalesce("_asked", F.lit(True))).otherwise(
        (F.col("id") == won["id"]) & ~F.coalesce(dropped_later, F.lit(False))
    )
    return joined.select(*[flag.alias(c) if c == "is_default" else F.col(c) for c in offices.columns])


def intake_errors() -> Column:
    """Every rule an intake row breaks, in rule order."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    shape = r"^\d{4}-\d{2}-\d{2}$"
    optional = lambda c: (text(c) != "") & ~text(c).rlike(shape)
    rules = [
        (~text("received_date").rlike(shape), "received_date"),
        ((text("tax_id") != "") & ~text("tax_id").rlike(r"^\d{8}$"), "tax_id"),
        (~text("entity_type").isin(vocab.ENTITY_TYPES), "entity_type"),
        (text("company_name") == "", "company_name"),
        (text("case_type") == "", "case_type"),
        (text("case_content") == "", "case_content"),
        (~text("status").isin(vocab.STATUSES), "status"),
        (~text("tax_office_required").isin(vocab.TAX_OFFICE_VALUES), "tax_office_required"),
        ((text("tax_bureau_code") != "") & ~text("tax_bureau_code").isin([b[0] for b in vocab.BUREAUS]), "tax_bureau_code"),
        (optional("billing_date"), "billing_date"),
        (amount(F.col("capital")).isNull(), "capital"),
        (amount(F.col("paid_amount")).isNull(), "paid_amount"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in rules]))


def check_intake(rows: DataFrame) -> DataFrame:
    return rows.withColumn("errors", intake_errors())


def accept_all_or_nothing(checked: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The checked rows when none has an error (and the batch is 1 to max_rows long), else no row."""
    counts = F.struct(F.count_if(F.size("errors") > 0).alias("bad"), F.count(F.lit(1)).alias("n"))
    summary = checked.agg(counts.alias("s")).scalar()
    good = (summary["bad"] == 0) & (summary["n"] >= 1)
    if max_rows is not None:
        good = good & (summary["n"] <= max_rows)
    return checked.filter(good).drop("errors")


def intake_events(numbered_cases: DataFrame) -> DataFrame:
    """The first event of each accepted case, which carries its number in place of an id."""
    return numbered_cases.select(
        "case_number", F.col("received_date").alias("event_date"), F.lit("進度").alias("event_type"), "status",
        first_filled("status_detail", F.lit("建立案件")).alias("detail"),
    )


def backfill_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add missing columns and fill nulls of present ones; ``defaults`` maps name to (type, value)."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value).cast(kind)) if name in df.columns else F.lit(value).cast(kind)
        for name, (kind, value) in defaults.items()
    }
    return df.withColumns(filled)


PROFILE_COLUMNS = [
    "received_date", "client_name", "company_name", "tax_id", "entity_type", "precheck_no", "case_type", "case_content",
    "notes", "representative", "address", "capital", "authority",
]


def update_profiles(cases: DataFrame, updates: DataFrame) -> DataFrame:
    """Cases with the profile columns of ``updates`` (one row per id); status and its detail stay."""
    given = [c for c in PROFILE_COLUMNS if c in updates.columns]
    renamed = updates.select("id", F.lit(True).alias("_given"), *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = cases.join(renamed, "id", "left")
    value = lambda c: F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in given else F.col(c) for c in cases.columns])


def profile_events(cases: DataFrame, history: DataFrame, updates: DataFrame) -> DataFrame:
    """History after ``update_profiles``: a changed received date moves the first event of its case."""
    asked = updates.select("id", F.col("received_date").alias("start_date"))
    changed = cases.join(asked, "id").filter(~F.col("received_date").eqNullSafe(F.col("start_date")))
    return move_first_events(history, changed.select(F.col("id").alias("case_id"), "start_date"))


def sync_preparation(cases: DataFrame, preparation: DataFrame) -> DataFrame:
    """Cases with confirmed preparation fields; a blank company keeps the present name."""
    new = preparation.select(
        F.col("case_id").alias("id"),
        F.lit(True).alias("_given"),
        F.col("company").alias("_company"),
        F.col("representative").alias("_representative"),
        F.col("precheck").alias("_precheck"),
        F.col("registration_address").alias("_address"),
        amount(F.col("capital_text")).alias("_capital"),
    )
    joined = cases.join(new, "id", "left")
    given = F.col("_given")
    changed = {
        "company_name": F.when(given, first_filled("_company", "company_name")),
        "representative": F.when(given, F.col("_representative")),
        "precheck_no": F.when(given, F.col("_precheck")),
        "address": F.when(given, F.col("_address")),
        "capital": F.when(given, F.col("_capital")),
    }
    return joined.select(
        *[
            F.when(given, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in cases.columns
        ]
    )


def preparation_events(cases: DataFrame, preparation: DataFrame, as_of) -> DataFrame:
    saved = preparation.select(F.col("case_id").alias("id")).distinct()
    return cases.join(saved, "id", "left_semi").select(
        F.col("id").alias("case_id"), F.lit(as_of).alias("event_date"), F.lit("資料準備").alias("event_type"), "status",
        F.lit("已儲存 OCR 與文件準備確認資料").alias("detail"),
    )


def check_approvals(rows: DataFrame) -> DataFrame:
    """Approval rows cleaned, with ``accepted`` telling whether their case sent both agencies in good order."""
    text = lambda c, n: F.nullif(clean_text(c, n), F.lit(""))
    clean = rows.select(
        "case_id", "agency", "status",
        text("approval_date", 10).alias("approval_date"),
        text("document_number", 120).alias("document_number"),
        text("cloud_path", 500).alias("cloud_path"),
    )
    date_ok = F.col("approval_date").isNull() | F.col("approval_date").rlike(r"^\d{4}-\d{2}-\d{2}$")
    good = F.col("agency").isin(vocab.AGENCIES) & F.col("status").isin(vocab.APPROVAL_STATUSES) & date_ok
    verdict = clean.groupBy("case_id").agg(
        F.max((F.col("agency") == vocab.AGENCIES[0]).cast("int")).alias("_city"),
        F.max((F.col("agency") == vocab.AGENCIES[1]).cast("int")).alias("_tax"),
        F.min(good.cast("int")).alias("_good"),
    )
    accepted = (F.col("_city") + F.col("_tax") == 2) & (F.col("_good") == 1)
    return clean.join(verdict.select("case_id", accepted.alias("accepted")), "case_id")


def store_approvals(stored: DataFrame, checked: DataFrame) -> DataFrame:
    """Stored approvals with the accepted rows of ``check_approvals`` laid over them, one per case and agency."""
    values = [c for c in stored.columns if c not in ("case_id", "agency")]
    accepted = checked.filter("accepted").select("case_id", "agency", *values, F.lit(0).alias("_seq"))
    return upsert(stored, accepted, ["case_id", "agency"], ["_seq"])


def store_cards(stored: DataFrame, cards: DataFrame, checked: DataFrame) -> DataFrame:
    """Stored registration cards with those sent beside accepted approvals laid over them, one per case."""
    accepted = checked.filter("accepted").select("case_id").distinct()
    sent = cards.join(accepted, "case_id", "left_semi").withColumn("_seq", F.lit(0))
    return upsert(stored, sent.select(*stored.columns, "_seq"), ["case_id"], ["_seq"])


def approval_events(cases: DataFrame, checked: DataFrame, as_of) -> DataFrame:
    """One event per case whose approvals were accepted, under the case's own status."""
    accepted = checked.filter("accepted").select(F.col("case_id").alias("id")).distinct()
    return cases.join(accepted, "id", "left_semi").select(
        F.col("id").alias("case_id"), F.lit(as_of).alias("event_date"), F.lit("核准公文").alias("event_type"), "status",
        F.lit("已更新核准公文與登記事項卡追蹤").alias("detail"),
    )


def keep_manual(current: DataFrame, parsed: DataFrame, key: str | list[str], fields: list[str]) -> DataFrame:
    """Lay parsed fields over current ones, except where ``manual_<field>`` is set or the parsed value is blank.

    ``key`` may be several columns, such as case and shareholder; a list field is blank when it is empty.
    """
    keys = [key] if isinstance(key, str) else key
    lists = {name for name, kind in current.dtypes if kind.startswith("array")}
    new = parsed.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = current.join(new, keys, "left")
    blank = lambda f: F.coalesce(F.size(f"_new_{f}") if f in lists else F.length(f"_new_{f}"), F.lit(0)) <= 0
    value = lambda f: F.when(
        F.col(f"manual_{f}") | blank(f), F.col(f)
    ).otherwise(F.col(f"_new_{f}"))
    return joined.select(*[value(c).alias(c) if c in fields else F.col(c) for c in current.columns])


