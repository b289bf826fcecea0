"""Document dataset tooling: classification, deduplication, slicing, naming and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import col
from caseflow.operators.ranking import numbered, top_rows
from caseflow.session import checkpointed


def file_category(name, rules: list[tuple[str, str]] = vocab.FILE_CATEGORIES) -> Column:
    """Category of a file by its name; the first matching pattern wins, null without one."""
    result = F.lit(None).cast("string")
    for category, pattern in reversed(rules):
        result = F.when(col(name).rlike(pattern), category).otherwise(result)
    return result


def mark_duplicates(records: DataFrame, category: str, digest: str, place: str, excluded: list[str] = ()) -> DataFrame:
    """Outcome per record: excluded, unreadable, duplicate or kept (the first of its category and digest).

    The first places are an aggregate; they join back on (category, digest, place), which is unique, so a
    digest that very many files share spreads over the shuffle.
    """
    # A missing category is a value of its own.
    left_out = F.coalesce(F.col(category).isin(list(excluded)), F.lit(False))
    firsts = records.filter(~left_out & F.col(digest).isNotNull()).groupBy(category, digest).agg(F.min(place).alias("_place"))
    firsts = firsts.select(F.col(category).alias("_category"), F.col(digest).alias("_digest"), "_place", F.lit(True).alias("_first"))
    same = F.col(category).eqNullSafe(F.col("_category")) & (F.col(digest) == F.col("_digest")) & (F.col(place) == F.col("_place"))
    joined = records.join(firsts, same, "left").drop("_category", "_digest", "_place")
    outcome = (
        F.when(left_out, "excluded_categories")
        .when(F.col(digest).isNull(), "unreadable_files")
        .when(F.col("_first"), "kept")
        .otherwise("duplicates")
    )
    return joined.withColumn("outcome", outcome).drop("_first")


def outcome_counts(records: DataFrame, category: str, outcome: str = "outcome") -> DataFrame:
    return records.groupBy(outcome, category).agg(F.count(F.lit(1)).alias("record_count"))


def cap_per_category(records: DataFrame, category: str, order: list[Column], most: int, existing: DataFrame | None = None) -> DataFrame:
    """At most ``most`` records per category in scan order, counting the ones an existing manifest holds."""
    if existing is None:
        return top_rows(records, [category], order, most, "_place").drop("_place")
    # Categories are a handful.
    held = existing.groupBy(category).agg(F.count(F.lit(1)).alias("_held"))
    ranked = top_rows(records, [category], order, most, "_place")
    return ranked.join(held, category, "left").filter(
        F.col("_place") + F.coalesce("_held", F.lit(0)) <= most
    ).select(*records.columns)


def slice_folders(records: DataFrame, folder: str, prefixes: list[str] = (), offset: int = 0, most: int = 0) -> DataFrame:
    """Records of the sorted distinct folders that pass the prefixes, from offset on, at most ``most`` folders."""
    folders = records.select(folder).distinct()
    if prefixes:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | F.startswith(F.col(folder), F.lit(prefix))
        folders = folders.filter(test)
    folders = folders.orderBy(folder)
    if offset:
        folders = folders.offset(offset)
    if most:
        folders = folders.limit(most)
    return records.join(folders, folder, "left_semi")


def _name_parts(name: Column) -> tuple[Column, Column]:
    """Base and extension; a dot at the very start opens no extension."""
    extension = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension)), extension


def unique_names(entries: DataFrame, name: str, place: str, slice_rows: int = 1_000_000) -> DataFrame:
    """Give repeated names a number: a.pdf, a_2.pdf, ... as if taken one by one in order of place.

    A numbered name may stand in the list itself. It keeps its number when it comes before the copy that
    would take it, and is renumbered as a copy of its own name when it comes after. ``place`` is a whole number; a name that very
    many rows share is numbered in slices of ``slice_rows`` places.
    """
    named = entries.withColumn("_name", F.col(name)).withColumn("_place", F.col(place))
    placed = numbered(named, ["_name"], [F.col("_place")], "_no", _slice(slice_rows))
    firsts = placed.filter("_no = 1").select("_name", F.col("_place").alias("_first"))
    base, extension = _name_parts(F.col("_name"))
    stem = lambda i: F.regexp_extract(base, r"(?s)^(.+)_([1-9]\d{0,8})$", i)
    children = (
        firsts.select(
            F.col("_name").alias("child"), F.concat(stem(1), extension).alias("_name"), stem(2).try_cast("long").alias("k"), "_first"
        )
        .filter("k >= 2")
        .join(firsts.select("_name"), "_name")
    )
    if children.isEmpty():
        return _with_numbers(placed, name, F.col("_no") - 1, F.lit(0))
    children = checkpointed(children)
    held, lost = None, None
    level = children.join(children.select(F.col("child").alias("_name")), "_name", "left_anti")
    # One round per level of nested numbers (a, a_2, a_2_2, ...), which are few.
    while not level.isEmpty():
        settled = checkpointed(_settle(placed, level, lost, slice_rows))
        kept = settled.select("_name", F.col("r.held").alias("_held"))
        moved = settled.select(F.explode("r.lost").alias("_name"))
        held = kept if held is None else held.unionByName(kept)
        lost = moved if lost is None else lost.unionByName(moved)
        level = children.join(level.select(F.col("child").alias("_name")), "_name", "left_semi")
    marked = placed.join(lost.withColumn("_lost", F.lit(1)), "_name", "left").join(held, "_name", "left")
    copy = F.col("_no") - 1 + F.coalesce("_lost", F.lit(0))
    # The i-th kept number h moves every copy from h - i on by one.
    starts = F.transform(F.sort_array("_held"), lambda h, i: h - i - 1)
    return _with_numbers(marked, name, copy, F.coalesce(F.size(F.filter(starts, lambda b: b <= copy)), F.lit(0)))


def _slice(rows: int) -> Column:
    return F.floor(F.col("_place") / rows)


def _settle(placed: DataFrame, level: DataFrame, lost: DataFrame | None, slice_rows: int) -> DataFrame:
    """For the parents of a level: which listed numbers keep their place and which lose it to a copy."""
    rows = placed.join(level.select("_name").distinct(), "_name", "left_semi")
    if lost is not None:
        rows = rows.join(lost.withColumn("_lost", F.lit(True)), "_name", "left")
        rows = rows.filter((F.col("_no") > 1) | F.coalesce("_lost", F.lit(False)))
    else:
        rows = rows.filter("_no > 1")
    marks = level.select("_name", F.col("_first").alias("_place"), "child", "k")
    both = rows.select("_name", "_place", F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("k")).unionByName(marks)
    order = [F.col("_place")]
    among_all = numbered(both, ["_name"], order, "_among_all", _slice(slice_rows)).filter("child IS NOT NULL")
    among_marks = numbered(marks, ["_name"], order, "_among_marks", _slice(slice_rows)).select("child", "_among_marks")
    counted = among_all.join(among_marks, "child").withColumn("copies", F.col("_among_all") - F.col("_among_marks"))
    listed = counted.groupBy("_name").agg(F.sort_array(F.collect_list(F.struct("k", "copies", "child"))).alias("c"))

    def step(done: Column, c: Column) -> Column:
        keeps = c["copies"] + F.size(done["held"]) < c["k"] - 1
        return F.struct(
            F.when(keeps, F.concat(done["held"], F.array(c["k"]))).otherwise(done["held"]).alias("held"),
            F.when(keeps, done["lost"]).otherwise(F.concat(done["lost"], F.array(c["child"]))).alias("lost"),
        )

    start = F.struct(F.array().cast("array<bigint>").alias("held"), F.array().cast("array<string>").alias("lost"))
    return listed.select("_name", F.aggregate("c", start, step).alias("r"))


def _with_numbers(rows: DataFrame, name: str, copy: Column, moved: Column) -> DataFrame:
    base, extension = _name_parts(F.col(name))
    numbered_name = F.concat(base, F.lit("_"), (copy + 1 + moved).cast("string"), extension)
    extra = [c for c in ("_name", "_place", "_no", "_lost", "_held") if c in rows.columns]
    return rows.withColumn("unique_name", F.when(copy == 0, F.col(name)).otherwise(numbered_name)).drop(*extra)


def agreement_report(compared: DataFrame, category: str = "category", expected: str | None = None) -> DataFrame:
    """Matched and baseline fields with their guarded ratio, by category and over all ('all').

    ``expected`` names a boolean column that says which rows the baseline has; without it all rows are the baseline's.
    """
    own = F.lit(True) if expected is None else F.coalesce(F.col(expected), F.lit(False))
    rolled = compared.rollup(category).agg(
        F.count_if(own).alias("baseline_fields"), F.count_if(own & F.col("matched")).alias("matched_fields"),
        F.grouping_id().alias("_level"),
    )
    ratio = F.round(F.col("matched_fields") / F.greatest(F.col("baseline_fields"), F.lit(1)), 4)
    return rolled.select(
        F.when(F.col("_level") == 1, "all").otherwise(F.col(category)).alias(category), "baseline_fields", "matched_fields",
        ratio.alias("field_agreement"),
    )


def policy_report(runs: DataFrame, full: DataFrame) -> DataFrame:
    """Ratios per policy and policy x category over stored runs, against the full-page totals.

    ``runs`` has policy, category, area_basis_points, tokens, duration_ms, baseline_fields, matched_fields;
    ``full`` has tokens and duration_ms of the full-page runs.
    """
    totals = full.agg(F.struct(F.sum("tokens").alias("t"), F.sum("duration_ms").alias("d")).alias("s")).scalar()
    rolled = runs.groupingSets(
        [[F.col("policy")], [F.col("policy"), F.col("category")]], F.col("policy"), F.col("category")
    ).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("area_basis_points").alias("_area"), F.sum("tokens").alias("_tokens"),
        F.sum("duration_ms").alias("_ms"), F.sum("baseline_fields").alias("baseline_fields"),
        F.sum("matched_fields").alias("matched_fields"), F.grouping_id().alias("_level"),
    )
    share = lambda part, whole: F.round(part / F.greatest(whole, F.lit(1)), 4)
    return rolled.select(
        "policy", F.when(F.col("_level") == 1, "all").otherwise(F.col("category")).alias("category"), "pages",
        share(F.col("matched_fields"), F.col("baseline_fields")).alias("field_agreement"),
        F.round(F.col("_area") / F.col("pages") / 10000, 4).alias("mean_area_ratio"),
        share(F.col("_tokens"), totals["t"]).alias("token_ratio"),
        share(F.col("_ms"), totals["d"]).alias("duration_ratio"),
    )
