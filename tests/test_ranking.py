"""Numbering and lookups must not depend on how a group is spread."""

from pyspark.sql import functions as F

from caseflow.operators.pages import page_ranges
from caseflow.operators.ranking import first_row, lookup, numbered, top_rows


def skewed(spark, rows=4000):
    """Half of the rows belong to key 0, some to none."""
    return spark.range(rows).select(
        F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 5 != 0, F.col("id") % 37).alias("k"), (F.col("id") * 7919 % rows).alias("v")
    )


def test_numbered_by_slices_equals_window(spark):
    df = skewed(spark).repartition(6)
    for order, part in ((F.col("v").desc(), -F.floor(F.col("v") / 100)), (F.col("v"), F.floor(F.col("v") / 7)), (F.col("v"), F.lit(0))):
        by_window = numbered(df, ["k"], [order], "n")
        by_slice = numbered(df, ["k"], [order], "n", part)
        assert by_window.exceptAll(by_slice).count() == 0 and by_slice.exceptAll(by_window).count() == 0


def test_numbered_without_keys(spark):
    rows = numbered(skewed(spark, 500), [], [F.col("v")], "n", F.floor(F.col("v") / 50)).orderBy("v").collect()
    assert [r["n"] for r in rows] == list(range(1, 501))


def test_empty_input(spark):
    empty = skewed(spark, 10).filter("v < 0")
    assert numbered(empty, ["k"], [F.col("v")], "n", F.col("v")).count() == 0


def test_lookup_is_a_left_join(spark):
    df = skewed(spark)
    dim = spark.createDataFrame([(0, "zero"), (5, "five"), (None, "none")], "k long, name string")
    expected = df.join(dim, "k", "left")
    for copies in (1, 8):
        got = lookup(df, dim, ["k"], ["v"], copies=copies)
        assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    usable = lookup(df, dim, ["k"], ["v"], F.col("k") != 0)
    assert usable.filter("k = 0 AND name IS NOT NULL").count() == 0 and usable.count() == df.count()


def test_first_and_top_rows(spark):
    df = skewed(spark)
    first = first_row(df, ["k"], [-F.col("v")])
    expected = df.groupBy("k").agg(F.max("v").alias("v"))
    assert first.exceptAll(expected).count() == 0
    plan = top_rows(df, ["k"], [F.col("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_page_ranges_do_not_depend_on_slices(spark):
    df = spark.createDataFrame([("a", p) for p in [5, 2, 1, 2]] + [("b", 7)], "f string, page long")
    for pages in (1, 2, 1000):
        got = {r["f"]: r["page_range"] for r in page_ranges(df, ["f"], slice_pages=pages).collect()}
        assert got == {"a": "1-2,5", "b": "7"}


def test_partition_count_does_not_matter(spark):
    df = skewed(spark)
    results = []
    for n in (2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        rows = numbered(df.repartition(n), ["k"], [F.col("v")], "n", F.floor(F.col("v") / 300)).collect()
        results.append(sorted(rows, key=lambda r: r["v"]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
