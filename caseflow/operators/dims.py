"""Reference-data joins: catalogue, jurisdiction, offices, defaults, postal codes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.functions.columns import (
    col, filled, first_filled, let, once, postal_key, roc_parts, tax_address,
)
from caseflow.operators.ranking import first_row, lookup, shuffled, top_rows

# Rows that share one office, bureau or code are spread over so many tasks.
KEY_COPIES = 16

DEFAULT_CHECKBOXES = json.dumps(vocab.PROOF_CHECKBOXES, separators=(",", ":"))


def build_catalogue(raw: DataFrame) -> DataFrame:
    """Trimmed catalogue rows; blank ones go, and the first row of a code (by input_pos) is kept."""
    text = [c for c in raw.columns if c != "input_pos"]
    trimmed = raw.select("input_pos", *[F.trim(c).alias(c) for c in text])
    kept = trimmed.filter((F.col("code") != "") & (F.col("name") != ""))
    return first_row(kept, ["code"], [F.col("input_pos")]).drop("input_pos")


CODE_AND_NAME = r"(?i)^([A-Z]{1,2}\d{5,6})\s*(.*)$"


def split_entry(value) -> Column:
    """(code, name) of a stored ``CODE NAME`` entry; without a code the whole text is the name."""
    text = F.trim(F.coalesce(col(value), F.lit("")))
    coded = text.rlike(CODE_AND_NAME)
    return F.struct(
        F.upper(F.regexp_extract(text, CODE_AND_NAME, 1)).alias("code"),
        F.when(coded, F.trim(F.regexp_extract(text, CODE_AND_NAME, 2))).otherwise(text).alias("name"),
    )


def format_entry(code, name) -> Column:
    return F.concat_ws(" ", filled(F.trim(col(code))), filled(F.trim(col(name))))


def name_entries(entries: DataFrame, catalogue: DataFrame, column: str = "entry") -> DataFrame:
    """Entries split into code and name; a missing name is looked up, an unknown code is kept."""
    split = entries.withColumn("_e", split_entry(column)).select(*entries.columns, "_e.*")
    names = catalogue.select(F.col("code"), F.col("name").alias("_catalogue_name"))
    wanting = (F.col("code") != "") & (F.col("name") == "")
    return lookup(split, names, ["code"], [column], wanting).select(
        *entries.columns, "code", first_filled("name", "_catalogue_name").alias("name")
    )


def search_score(needle: Column) -> Column:
    """0 exact code, 1 code prefix, 2 name prefix, 3 in code, 4 in name, 5 in category; null otherwise."""
    code, name, category = F.col("code"), F.col("name"), F.col("category_name")
    return (
        F.when(needle == "", 0)
        .when(code == needle, 0)
        .when(F.startswith(code, needle), 1)
        .when(F.startswith(name, needle), 2)
        .when(F.contains(code, needle), 3)
        .when(F.contains(name, needle), 4)
        .when(F.contains(category, needle), 5)
    )


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct substrings of exactly ``n`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))), lambda g: F.length(g) == n))


# Queries of so many characters are met by pieces of that length. Codes are numbers, so a piece of three digits is held by a fixed
# share of all rows, and looking up every code by it would take the square of the catalogue.
LONG_GRAMS = (4, 6)


def gram_index(catalogue: DataFrame, gram: int = 3) -> DataFrame:
    """(_gram, code, name, category_name): every piece of up to ``gram`` characters, and of the longer lengths, of a row's three texts."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("code", "name", "category_name")]
    lengths = [*range(1, gram + 1), *[n for n in LONG_GRAMS if n > gram]]
    pieces = F.array_distinct(F.concat(*[_grams(text, n) for text in texts for n in lengths]))
    return catalogue.select(F.explode(pieces).alias("_gram"), "code", "name", "category_name")


def search_catalogue(catalogue: DataFrame, queries: DataFrame | list[str], k: int = 20, gram: int = 3) -> DataFrame:
    """Best ``k`` catalogue rows for each distinct ``query`` text of a table (or list) of any size.

    A query meets the rows that hold its rarest piece of ``gram`` characters, of the longest of ``LONG_GRAMS`` if it has so many (a
    shorter query the rows that hold it), and is then scored. A blank query gives the first rows by code. Rows of a common piece are dealt over salts.
    """
    if isinstance(queries, list):
        queries = catalogue.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    asked = queries.select("query").distinct().withColumn("_needle", F.regexp_replace(F.upper("query"), r"[\s　]+", ""))
    index = gram_index(catalogue, gram)
    blank = catalogue.orderBy("code").limit(k).select(F.lit("").alias("_gram"), "code", "name", "category_name")
    needle = F.col("_needle")
    size = F.least(F.lit(gram), F.length(needle))
    for n in LONG_GRAMS:
        size = F.when(F.length(needle) >= max(n, gram), max(n, gram)).otherwise(size)
    pieces = F.when(needle == "", F.array(F.lit(""))).otherwise(_grams(needle, size))
    offered = asked.select("_needle").distinct().select("_needle", F.explode(pieces).alias("_gram"))
    counts = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
    rarest = offered.join(shuffled(counts), "_gram", "left").groupBy("_needle").agg(
        F.min_by("_gram", F.struct(F.coalesce("_rows", F.lit(0)), "_gram")).alias("_gram")
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(KEY_COPIES - 1)))
    dealt = index.unionByName(blank).withColumn("_salt", F.pmod(F.xxhash64("code"), F.lit(KEY_COPIES)).cast("int"))
    met = rarest.withColumn("_salt", salts).join(shuffled(dealt), ["_gram", "_salt"]).withColumn("score", search_score(needle))
    best = top_rows(met.filter(F.col("score").isNotNull()), ["_needle"], [F.col("score"), F.col("code")], k, "place")
    return asked.join(shuffled(best), "_needle").select("query", "code", "name", "category_name", "score", "place")


def bureau_dimension(spark) -> DataFrame:
    rows = [
        (code, full, short, county) for code, full, short, counties in vocab.BUREAUS for county in counties
    ]
    numbered_rows = [(place, *row) for place, row in enumerate(rows)]
    return spark.createDataFrame(
        numbered_rows, "priority int, bureau_code string, bureau_name string, short_name string, county string"
    )


def first_contained(df: DataFrame, keys: list[str], text: Column, dim: DataFrame, name: str, priority: str, gram: int = 2) -> DataFrame:
    """Add the dimension row whose ``name`` occurs in ``text``; the lowest priority wins, then the lowest name, not the position.

    Each distinct text offers its pieces of ``gram`` characters and fewer. A name is met by the piece of it (of ``gram`` characters,
    or the whole of a shorter name) that the fewest texts offer, and then searched for; a name with a piece that no text offers
    meets none. Texts that offer a name's piece are dealt over salts, and rows of one text over as many.
    Blank names never occur.
    """
    texts = df.select(text.alias("_text")).distinct()
    pieces = F.array_distinct(F.concat(*[_grams(F.col("_text"), n) for n in range(1, gram + 1)]))
    offered = texts.select("_text", F.explode(pieces).alias("_piece"))
    held = offered.groupBy("_piece").agg(F.count(F.lit(1)).alias("_texts"))
    named = dim.filter(F.col(name) != "").withColumn("_name", F.col(name))
    own = named.select("_name").distinct().select("_name", F.explode(_grams(F.col("_name"), F.least(F.lit(gram), F.length("_name")))).alias("_piece"))
    rarest = own.join(held, "_piece", "left").groupBy("_name").agg(
        F.min_by("_piece", F.struct(F.coalesce("_texts", F.lit(0)), "_piece")).alias("_piece")
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(KEY_COPIES - 1)))
    met = named.join(rarest, "_name").drop("_name").withColumn("_salt", salts)
    dealt = offered.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(KEY_COPIES)).cast("int"))
    found = dealt.join(met, ["_piece", "_salt"]).filter(F.contains(F.col("_text"), F.col(name))).drop("_piece", "_salt")
    best = first_row(found, ["_text"], [F.col(priority), F.col(name)])
    return lookup(df.withColumn("_text", text), best, ["_text"], keys, copies=KEY_COPIES).select(*df.columns, *dim.columns)


def bureau_of(address) -> Column:
    """Struct(bureau_code, bureau_name, short_name, county) for an address by the fixed county list."""
    text = tax_address(address)
    result = F.lit(None)
    for code, full, short, counties in reversed(vocab.BUREAUS):
        for county in reversed(counties):
            here = F.struct(
                F.lit(code).alias("bureau_code"), F.lit(full).alias("bureau_name"), F.lit(short).alias("short_name"),
                F.lit(county).alias("county"),
            )
            result = F.when(F.contains(text, F.lit(county)), here).otherwise(result)
    return result


# The district whose branch depends on the side of a road, and the words that tell it.
BOUNDARY_DISTRICT = "中山區"
BOUNDARY_HINTS = {"松江路以東": "east", "松江路以西": "west"}


def resolve_branch(
    located: DataFrame,
    text: Column,
    offices: DataFrame,
    boundary_district: str = BOUNDARY_DISTRICT,
    hints: dict[str, str] = BOUNDARY_HINTS,
) -> DataFrame:
    """Branch office of each address that already has bureau_code and county.

    Offices are folded to one row per (bureau, county) with a list per district, in which a name stands once per boundary, so an
    address tests each district once and carries no more than the names; the rows of a large bureau are spread.
    """
    listed = offices.select("bureau_code", "county", "ordinal", "office_name", "district", "boundary").distinct()
    # A struct, since a plain minimum would pass over a missing ordinal.
    named = listed.groupBy("bureau_code", "county", "district", "office_name", "boundary").agg(
        F.min(F.struct("ordinal")).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    office = F.struct(F.col("_first.ordinal").alias("ordinal"), "office_name", "district", "boundary", F.col("_rows").alias("rows"))
    districts = named.groupBy("bureau_code", "county", "district").agg(F.collect_list(office).alias("offices"))
    table = districts.groupBy("bureau_code", "county").agg(F.collect_list(F.struct("district", "offices")).alias("_offices"))
    spread_by = [c for c in located.columns if c not in ("bureau_code", "county")]
    joined = lookup(located.withColumn("_text", once(text)), shuffled(table), ["bureau_code", "county"], spread_by, copies=KEY_COPIES)
    held = F.filter("_offices", lambda d: F.contains(F.col("_text"), d["district"]))
    hits = F.sort_array(F.flatten(F.transform(held, lambda d: d["offices"])))

    def candidates(found: Column) -> Column:
        rows = F.aggregate(found, F.lit(0).cast("long"), lambda n, o: n + o["rows"])
        at_boundary = (rows > 1) & F.contains(F.col("_text"), F.lit(boundary_district))
        narrowed = found
        for words, side in hints.items():
            on_side = F.filter(found, lambda o: o["boundary"] == side)
            narrowed = F.when(at_boundary & F.contains(F.col("_text"), F.lit(words)), on_side).otherwise(narrowed)
        return F.array_distinct(F.transform(narrowed, lambda o: o["office_name"]))

    names = F.coalesce(let(hits, candidates), F.array().cast("array<string>"))
    return (
        joined.withColumn("branch_candidates", once(names))
        .withColumn("branch_name", F.when(F.size("branch_candidates") == 1, F.get("branch_candidates", F.lit(0))).otherwise(""))
        .withColumn("needs_confirmation", F.size("branch_candidates") > 1)
        .drop("_offices", "_text")
    )


def office_options(asked: DataFrame, bureaus: DataFrame, offices: DataFrame) -> DataFrame:
    """Distinct offices of the bureau that each ``bureau_text`` names by code, short or full name, in list order."""
    names = bureaus.select(
        "bureau_code", F.explode(F.array_distinct(F.array("bureau_code", "bureau_name", "short_name"))).alias("_name")
    ).distinct()
    wanted = asked.select("bureau_text").distinct().withColumn("_name", F.regexp_replace("bureau_text", "^臺北$", "台北"))
    listed = offices.groupBy("bureau_code", "office_name").agg(F.min("ordinal").alias("ordinal"))
    return wanted.join(names, "_name").join(listed, "bureau_code").select(
        "bureau_text", "office_name", "ordinal"
    )


def missing_office_fields() -> Column:
    """Labels of blank required office fields, joined by 、."""
    labels = [F.when(F.trim(F.col(c)) == "", F.lit(label)) for c, label in vocab.OFFICE_REQUIRED]
    return F.array_join(F.array_compact(F.array(*labels)), "、")


def preparation_defaults(cases: DataFrame, preparation: DataFrame) -> DataFrame:
    """Stored preparation values over the case's own; blanks fall through."""
    stored = preparation.select(
        F.col("case_id").alias("id"), *[F.col(c).alias(f"_p_{c}") for c in preparation.columns if c != "case_id"]
    )
    joined = cases.join(stored, "id", "left")
    capital = F.when(F.col("capital") != 0, F.col("capital").cast("string"))
    return joined.select(
        "id",
        F.col("company_name").alias("company"),
        first_filled("_p_representative", "representative").alias("representative"),
        first_filled("_p_national_id").alias("national_id"),
        first_filled("_p_precheck", "precheck_no").alias("precheck"),
        first_filled("_p_contact_address").alias("contact_address"),
        first_filled("_p_registration_address", "address").alias("registration_address"),
        first_filled("_p_contact_phone").alias("contact_phone"),
        first_filled("_p_capital_text", capital).alias("capital_text"),
    )


def default_office(offices: DataFrame) -> Column:
    """Id of the active default office that comes first in list order, as a scalar subquery."""
    chosen = offices.filter("active AND is_default").agg(F.min_by("id", F.struct("name", "id")).alias("id"))
    return chosen.scalar()


def proof_defaults(
    cases: DataFrame, preparation: DataFrame, proofs: DataFrame, approvals: DataFrame, offices: DataFrame, branches: DataFrame, as_of,
    boundary_district: str = BOUNDARY_DISTRICT,
) -> DataFrame:
    """Purchase-proof settings per case: stored, else prepared, else derived from address, approval, branch list or default office.

    ``proofs`` holds what was saved, ``branches`` the branch offices by district as ``resolve_branch`` takes them.
    """
    stored = proofs.select(F.col("case_id").alias("id"), *[F.col(c).alias(f"_s_{c}") for c in proofs.columns if c != "case_id"])
    prepared = preparation_defaults(cases, preparation).select(
        "id",
        F.col("registration_address").alias("_address"),
        F.col("national_id").alias("_national_id"),
        F.col("contact_phone").alias("_phone"),
        F.col("representative").alias("_representative"),
    )
    tax = approvals.filter("agency = 'national_tax'").select(
        F.col("case_id").alias("id"), F.col("status").alias("_tax_status"), roc_parts("approval_date").alias("_official")
    )
    short_names = F.create_map(*[F.lit(x) for code, _, short, _ in vocab.BUREAUS for x in (code, short)])
    office = default_office(offices)
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    kept = (
        cases.select("id", "case_number", "company_name", "tax_id", "tax_bureau_code")
        .join(prepared, "id")
        .join(stored.withColumn("_stored", F.lit(True)), "id", "left")
        .join(tax, "id", "left")
        .withColumn("_bureau", bureau_of("_address"))
        .withColumns({"bureau_code": F.col("_bureau.bureau_code"), "county": F.col("_bureau.county")})
    )
    joined = resolve_branch(kept, tax_address("_address"), branches, boundary_district)
    return joined.select(
        "id",
        first_filled("_s_email").alias("email"),
        first_filled("_s_branch_name", "branch_name").alias("branch_name"),
        first_filled("_s_sales_document_number").alias("sales_document_number"),
        F.coalesce("_s_selected_pages", F.when(F.col("_stored"), F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, (1, 2, 3, 4))))).alias("selected_pages"),
        F.coalesce("_s_checkboxes", F.when(F.col("_stored"), "{}").otherwise(DEFAULT_CHECKBOXES)).alias("checkboxes"),
        F.coalesce("_bureau.short_name", F.lit("")).alias("suggested_bureau"),
        F.col("branch_candidates").alias("suggested_branches"), F.col("needs_confirmation").alias("branch_needs_confirmation"),
        F.coalesce(nonzero("_s_office_id"), office).alias("office_id"),
        F.coalesce(nonzero("_s_page4_office_id"), nonzero("_s_office_id"), office).alias("page4_office_id"),
        first_filled("_s_tax_registration_number").alias("tax_registration_number"),
        first_filled("_s_responsible_person_id", "_national_id").alias("responsible_person_id"),
        first_filled("_s_business_phone", "_phone").alias("business_phone"),
        first_filled("_s_tax_bureau_name", "_bureau.short_name", short_names[F.col("tax_bureau_code")]).alias("tax_bureau_name"),
        first_filled("_s_official_year", "_official.roc_year").alias("official_year"),
        first_filled("_s_official_month", "_official.roc_month").alias("official_month"),
        first_filled("_s_official_day", "_official.roc_day").alias("official_day"),
        first_filled("_s_application_year", F.lit(str(as_of.year - 1911))).alias("application_year"),
        first_filled("_s_application_month", F.lit(str(as_of.month))).alias("application_month"),
        first_filled("_s_application_day").alias("application_day"),
        F.coalesce(F.col("_tax_status").isin("received", "archived"), F.lit(False)).alias("tax_approval_received"),
    )


def proof_eligibility(cases: DataFrame, approvals: DataFrame, proofs: DataFrame, offices: DataFrame) -> DataFrame:
    """Whether a purchase proof can be written for each case, and the first reason why not."""
    tax = approvals.filter("agency = 'national_tax'").select(F.col("case_id").alias("id"), F.col("status").alias("_tax"))
    stored = proofs.select(
        F.col("case_id").alias("id"), F.col("office_id").alias("_office"), F.col("tax_registration_number").alias("_reg"),
        F.col("responsible_person_id").alias("_person"),
    )
    complete = offices.select(F.col("id").alias("_office"), missing_office_fields().alias("_missing"))
    joined = lookup(cases.join(tax, "id", "left").join(stored, "id", "left"), complete, ["_office"], ["id"], copies=KEY_COPIES)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(F.col("_tax").isin("received", "archived"), F.lit(False)), "approval")
        .when(~F.col("tax_id").rlike(r"^\d{8}$"), "tax_id")
        .when(F.coalesce("_office", F.lit(0)) < 1, "office")
        .when(F.col("_missing").isNull(), "unknown_office")
        .when(F.col("_missing") != "", F.concat(F.lit("office:"), F.col("_missing")))
        .when(blank("company_name") | blank("representative") | blank("address"), "case_fields")
        .when(blank("_reg"), "tax_registration_number")
        .when(blank("_person"), "responsible_person_id")
        .otherwise("")
    )
    return joined.select("id", reason.alias("reason")).withColumn("eligible", F.col("reason") == "")


def approval_grid(cases: DataFrame, approvals: DataFrame) -> DataFrame:
    """Every case with every agency; stored approvals laid over the defaults."""
    grid = cases.select(F.col("id").alias("case_id"), F.explode(F.array(*map(F.lit, vocab.AGENCIES))).alias("agency"))
    return grid.join(approvals, ["case_id", "agency"], "left").withColumn(
        "status", F.coalesce("status", F.lit("not_received"))
    )


def registration_cards(cases: DataFrame, cards: DataFrame) -> DataFrame:
    """Registration-card state of every case; without a stored card nothing was received or sent."""
    stored = cards.select(F.col("case_id"), "original_received", "customer_copy_sent", "updated_at")
    return cases.select(F.col("id").alias("case_id")).join(stored, "case_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("original_received", "customer_copy_sent")}
    )


def postal_codes(addresses: DataFrame, zips: DataFrame, column: str = "address") -> DataFrame:
    """Postal code of each address; six digits are preferred to five, and a partial address gets none."""
    keyed = addresses.withColumn("_key", postal_key(column))
    keyed = keyed.withColumn("_key", F.when(F.col("_key").rlike("[縣市].+[路街巷弄號]"), F.col("_key")))
    landed = zips.select(F.col("address_key").alias("_key"), "zipcode6", "zipcode")
    code = (
        F.when(F.col("zipcode6").rlike(r"^\d{6}$"), F.col("zipcode6"))
        .when(F.col("zipcode").rlike(r"^\d{5}$"), F.col("zipcode"))
        .otherwise("")
    )
    return lookup(keyed, landed, ["_key"], addresses.columns).withColumn("postal_code", code).drop("_key", "zipcode6", "zipcode")
