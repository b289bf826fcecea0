"""Ledger inputs derived from the given tables.

There are no ledger tables at hand, so cases come from ``orders``, billing items from ``lineitem``,
history from ``events``, offices from ``supplier`` and so on. Every column is an expression of its
row, so all inputs grow with the tables. ``inputs_sql`` states the same mapping in SQL.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import vocab
from caseflow.sources.tables import TABLES, load_table

# Facts in one small file are read by one task. A caller who wants them dealt out says into how many parts.
INPUT_PARTITIONS = "caseflow.input.partitions"
FACTS = {"orders", "lineitem", "events", "pages", "conversations"}

AS_OF = datetime.date(2001, 12, 31)

# Stored parts of purchase-proof dates are blank for every n-th case.
PROOF_DATES = [
    (11, "application_year"), (7, "application_month"), (4, "application_day"), (6, "official_year"), (5, "official_month"), (3, "official_day"),
]

DISTRICTS = ["中山區", "信義區", "東區", "西屯區", "板橋區", "北區", "大安區"]
EVENT_TYPES = {"view": "進度", "signup": "官方查詢", "click": "請款", "error": "國稅局查詢", "purchase": "收款"}


def pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def day(name: str) -> Column:
    return F.col(name).cast("date")


def address_of(key: Column) -> Column:
    return F.concat(pick(vocab.COUNTIES, key), pick(DISTRICTS, key), F.lit("測試路"), (key % 300).cast("string"), F.lit("號"))


def national_id_of(key: Column) -> Column:
    """An identity number whose last digit is valid for most keys and off by one for some."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letter = F.substring(F.lit(letters), 1, 26)
    letter = F.substr(letter, (key % 26 + 1).cast("int"), F.lit(1))
    return F.concat(letter, (key % 2 + 1).cast("string"), F.format_string("%08d", key % 100000000))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of a table dealt over tasks, for queries that make far more of a row than its file shows: a packed file of some
    hundred megabytes is read by one or two tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Inputs:
    """Lazily loaded tables of one folder, and the ledger tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = load_table(self.spark, self.folder, name)
        parts = self.spark.conf.get(INPUT_PARTITIONS, None)
        return table.repartition(int(parts)) if parts and name in FACTS else table

    @property
    def cases(self) -> DataFrame:
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        received = day("o_orderdate")
        some = lambda n, value: F.when(k % n == 0, value)
        return self.orders.select(
            k.alias("id"),
            F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.format_string("%03d", k)).alias("case_number"),
            received.alias("received_date"),
            F.concat(F.lit("client-"), cust.cast("string")).alias("client_name"),
            F.format_string("Customer#%09d", cust).alias("company_name"),
            F.format_string("%08d", cust % 100000000).alias("tax_id"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "行號").otherwise("公司").alias("entity_type"),
            F.when(F.col("o_orderstatus") == "O", "").otherwise(F.format_string("115%06d", k % 1000000)).alias("precheck_no"),
            F.when(F.col("o_orderstatus") == "F", "新設立").otherwise("變更登記").alias("case_type"),
            F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.col("o_orderpriority")).alias("case_content"),
            pick(vocab.STATUSES, k).alias("status"),
            F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("status_detail"),
            F.floor(F.col("o_totalprice") / 10).cast("long").alias("service_fee"),
            (k % 50 * 100).alias("government_fee"),
            F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("long"))
            .otherwise(F.floor("o_totalprice").cast("long")).alias("paid_amount"),
            some(4, F.date_add(received, 40)).alias("payment_date"),
            F.lit(None).cast("date").alias("closed_date"),
            F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("notes"),
            F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("rep-"), cust.cast("string"))).alias("representative"),
            F.when(k % 8 == 0, "").otherwise(address_of(cust)).alias("address"),
            (k % 7 * 100000).alias("capital"),
            F.when(k % 2 == 0, "臺北市政府").otherwise("").alias("authority"),
            F.when(k % 6 == 0, "").otherwise(F.format_string("%09d", k)).alias("official_receipt_no"),
            F.when(k % 6 == 0, "").otherwise(pick(["審查中", "補正", "核准發文中"], k)).alias("official_status"),
            some(2, F.date_add(received, 3)).alias("submitted_date"),
            pick(vocab.TAX_OFFICE_VALUES, cust).alias("tax_office_required"),
            F.when(k % 5 == 0, "").otherwise(pick(["A05", "H01", "B01", "D01", "E01"], k)).alias("tax_bureau_code"),
            F.when(k % 7 == 0, F.format_string("%010d", k)).otherwise("").alias("tax_receipt_no"),
            F.when(k % 7 == 0, "審核中").otherwise("").alias("tax_official_status"),
            pick(vocab.BILLING_STATUSES, k).alias("billing_status"),
            F.when(k % 4 != 0, F.date_add(received, 20)).alias("billing_date"),
            some(5, F.date_add(received, 30)).alias("next_follow_up_date"),
            F.when(k % 3 == 0, "").otherwise("17").alias("reg_unit_code"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @property
    def items(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("case_id"),
            F.concat(F.lit("item-"), F.col("l_partkey").cast("string")).alias("item_name"),
            F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("amount"),
            F.col("l_returnflag").alias("notes"),
            F.col("l_linenumber").alias("sort_order"),
        )

    @property
    def history(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("case_id"),
            day("ts").alias("event_date"),
            kind[F.col("event_type")].alias("event_type"),
            pick(vocab.STATUSES, F.col("event_id")).alias("status"),
            F.col("props").alias("detail"),
        )

    @property
    def candidates(self) -> DataFrame:
        """External progress records: shipped lines of a case's customer, one receipt per line."""
        roc = F.concat(
            (F.year("l_shipdate") - 1911).cast("string"), F.lit("/"), F.date_format("l_shipdate", "MM/dd")
        )
        k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return self.lineitem.select(
            F.col("l_orderkey").alias("case_id"),
            F.when(F.col("l_linenumber") == 1, F.format_string("%09d", "l_orderkey"))
            .when(F.col("l_partkey") % 3 == 0, F.concat(pick(["A-", "B", "Z-9-"], F.col("l_suppkey")), F.col("l_partkey").cast("string")))
            .otherwise(F.format_string("%09d", F.col("l_partkey"))).alias("receipt_no"),
            roc.alias("received_date"),
            pick(["審查中", "補正通知", "核准發文中", "可自領", "已郵寄"], k).alias("official_status"),
            F.lit("臺北市政府").alias("authority"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"),
        )

    @property
    def offices(self) -> DataFrame:
        k = F.col("s_suppkey")
        gap = lambda n, value: F.when(k % n == 0, "").otherwise(value)
        return self.supplier.select(
            k.alias("id"),
            F.col("s_name").alias("name"),
            gap(5, F.format_string("%08d", k)).alias("unified_number"),
            gap(7, F.concat(F.lit("person-"), k.cast("string"))).alias("responsible_person"),
            gap(3, F.concat(F.lit("A1"), F.format_string("%08d", k))).alias("responsible_person_id"),
            F.concat(F.lit("road "), F.col("s_nationkey").cast("string")).alias("address"),
            gap(4, F.lit("02-0000")).alias("phone"),
            F.lit("M1").alias("media_code"),
            gap(11, F.lit("L1")).alias("license_number"),
            (F.col("s_acctbal") > 5000).alias("active"),
            (k % 10 == 3).alias("is_default"),
        )

    @property
    def page_text(self) -> DataFrame:
        return self.conversations.select(
            F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), F.col("text")
        )

    @property
    def branches(self) -> DataFrame:
        """Branch offices by county and district: some districts have two."""
        from caseflow.operators.dims import bureau_of

        k = F.col("s_suppkey")
        rows = self.supplier.select(
            pick(vocab.COUNTIES, k).alias("county"), pick(DISTRICTS, k).alias("district"),
            F.concat(F.lit("branch "), (k % 20).cast("string")).alias("office_name"), (k % 500).alias("ordinal"), F.lit("").alias("boundary"),
        )
        return rows.withColumn("b", bureau_of("county")).select("b.bureau_code", "b.county", "office_name", "ordinal", "district", "boundary")

    @property
    def preparation(self) -> DataFrame:
        """Prepared document fields for the cases that are not pending."""
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        blank = lambda n, value: F.when(k % n == 0, "").otherwise(value)
        return self.orders.filter("o_orderstatus <> 'P'").select(
            k.alias("case_id"),
            blank(4, F.format_string("Prepared#%09d", cust)).alias("company"),
            blank(3, F.concat(F.lit("prep-"), cust.cast("string"))).alias("representative"),
            national_id_of(cust).alias("national_id"),
            blank(5, F.format_string("114%06d", k % 1000000)).alias("precheck"),
            blank(7, F.concat(F.lit("contact "), k.cast("string"))).alias("contact_address"),
            blank(6, address_of(k)).alias("registration_address"),
            blank(8, F.format_string("09%08d", k % 100000000)).alias("contact_phone"),
            blank(9, F.concat((k % 900).cast("string"), F.lit(",000"))).alias("capital_text"),
        )

    @property
    def approvals(self) -> DataFrame:
        """Tax approvals of closed and open orders, city approvals of closed ones."""
        k = F.col("o_orderkey")
        closed = F.col("o_orderstatus") == "F"
        agencies = F.when(closed, F.array(*map(F.lit, vocab.AGENCIES))).otherwise(F.array(F.lit("national_tax")))
        rows = self.orders.filter("o_orderstatus <> 'P'").withColumn("agency", F.explode(agencies))
        return rows.select(
            k.alias("case_id"),
            "agency",
            pick(vocab.APPROVAL_STATUSES, F.col("o_custkey")).alias("status"),
            F.when(k % 3 != 0, F.date_add(day("o_orderdate"), 10)).alias("approval_date"),
            F.when(k % 4 != 0, F.concat(F.lit("No-"), k.cast("string"))).alias("document_number"),
        )

    @property
    def cards(self) -> DataFrame:
        """Registration cards of a third of the orders."""
        k = F.col("o_orderkey")
        return self.orders.filter("o_orderkey % 3 = 0").select(
            k.alias("case_id"), (k % 2 == 0).alias("original_received"), (k % 5 == 0).alias("customer_copy_sent"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @property
    def proofs(self) -> DataFrame:
        """Purchase-proof settings stored for open orders."""
        k = F.col("o_orderkey")
        blank = lambda n, value: F.when(k % n == 0, "").otherwise(value)
        return self.orders.filter("o_orderstatus = 'O'").select(
            k.alias("case_id"),
            F.when(k % 3 != 0, k % 10).alias("office_id"),
            F.when(k % 2 != 0, k % 7).alias("page4_office_id"),
            blank(4, F.format_string("%09d", k)).alias("tax_registration_number"),
            blank(5, national_id_of(k)).alias("responsible_person_id"),
            blank(6, F.lit("02-1111")).alias("business_phone"),
            blank(7, F.lit("北區")).alias("tax_bureau_name"),
            blank(8, F.lit("竹北分局")).alias("branch_name"),
            blank(3, F.concat(F.lit("mail-"), k.cast("string"))).alias("email"),
            blank(2, F.concat(F.lit("S-"), k.cast("string"))).alias("sales_document_number"),
            F.when(k % 5 != 0, F.array(F.lit(1), (k % 4 + 1).cast("int"))).alias("selected_pages"),
            F.when(k % 6 != 0, F.concat(F.lit('{"page1":'), k.cast("string"), F.lit("}"))).alias("checkboxes"),
            *[blank(n, (k % n).cast("string")).alias(f"{part}") for n, part in PROOF_DATES],
        )

    @property
    def catalogue(self) -> DataFrame:
        """Business catalogue: parts by code, the lowest part key wins a code."""
        from caseflow.operators.dims import build_catalogue

        raw = self.part.select(
            F.col("p_partkey").alias("input_pos"),
            F.format_string("E%06d", F.col("p_partkey") % 1000000).alias("code"),
            F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("name"),
            F.col("p_type").alias("category"),
            F.lower("p_type").alias("category_name"),
        )
        return build_catalogue(raw)

    @property
    def regional_offices(self) -> DataFrame:
        """Branch offices by region (bureau), nation (county) and zone (district)."""
        k = F.col("s_suppkey")
        named = self.supplier.join(
            self.nation, F.col("s_nationkey") == F.col("n_nationkey")
        ).select(
            (k % 500).alias("ordinal"),
            F.col("n_regionkey").cast("string").alias("bureau_code"),
            F.col("n_name").alias("county"),
            F.concat(F.lit("office "), (k % 20).cast("string")).alias("office_name"),
            F.concat(F.lit("zone "), (k % 10).cast("string"), F.lit(";")).alias("district"),
            F.when(k % 10 == 3, F.when(k % 20 == 3, "east").otherwise("west")).otherwise("").alias("boundary"),
        )
        return named.groupBy("bureau_code", "county", "office_name", "district", "boundary").agg(
            F.min("ordinal").alias("ordinal")
        )

    @property
    def regional_addresses(self) -> DataFrame:
        k = F.col("c_custkey")
        hint = F.when(k % 4 == 0, "east side").when(k % 4 == 1, "west side").otherwise("")
        return self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            k.alias("id"),
            F.concat("n_name", F.lit(" zone "), (k % 13).cast("string"), F.lit("; road "), k.cast("string"), F.lit(" "), hint).alias("address"),
        )
