"""What the plans promise: pruned scans, no products, no nested loops over data, the same answer for any partitioning."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from seamark.operators import freshness as R
from seamark.operators import graph as G
from seamark.plans import catalog

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


#: Queries that join one row of statistics or bounds; the row is the broadcast side.
ONE_ROW = {"A03_bm25", "A07_economics", "C06_references", "A17_unparsed", "A17_cases", "T03_lsh_recall", "Y02_nesting", "C06_page"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - ONE_ROW))
def test_no_products(spark, name):
    p = plan(catalog.queries()[name](spark, DIR))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_pending_sources_reads_no_bodies(spark):
    p = plan(catalog.queries()["p3_found"](spark, DIR))
    assert "ReadSchema" in p and "body" not in p


def test_filters_reach_the_scan(spark):
    p = plan(catalog.queries()["F01_subtree"](spark, DIR))
    assert "StringStartsWith(path,src/graph/)" in p and "body" not in p


def test_a_third_of_the_rows_in_one_file(spark):
    """Half a million points and ranges of one file meet in bins, not in one task or as pairs."""
    points = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 500)).alias("path"), (F.col("id") * 10 + 3).alias("at"))
    ranges = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 500)).alias("path"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"), F.col("id").alias("unit"))
    got = R.enclosing(points, ranges, "path", "at", "start", "end", ["unit"])
    assert got.filter("unit IS NOT NULL AND start <= at AND at < end").count() == 60_000


def test_traversal_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b", True), ("b", "a", True), ("b", "c", False), ("c", "d", True)], "src string, dst string, fresh boolean")
    s = spark.createDataFrame([("a",)], "node string")
    got = {(r["hop"], r["src"], r["dst"]) for r in G.traverse(e, s, 4, None).collect()}
    assert got == {(1, "a", "b"), (2, "b", "a"), (2, "b", "c")}
    assert {r["src"] for r in G.traverse(e, spark.createDataFrame([("d",)], "node string"), 1, None, reverse=True).collect()} == {"c"}


def test_bounded_traversal_keeps_order_and_bounds(spark):
    e = spark.createDataFrame([("a", f"b{i:03}", True) for i in range(100)] + [(f"b{i:03}", "c", i % 2 == 0) for i in range(100)], "src string, dst string, fresh boolean")
    got = G.traverse(e, spark.createDataFrame([("a",)], "node string"), 2, 150).collect()
    # 63 of the hundred are visited besides the seed
    assert len(got) == 100 + 50 and [r["src"] for r in got if r["hop"] == 2] == [f"b{i:03}" for i in range(50)]
    assert len(G.traverse(e, spark.createDataFrame([("a",)], "node string"), 2, 256).collect()) == 100 + 63


def test_long_ranges_touch_few_bins(spark):
    ranges = spark.createDataFrame([("f", 0, 1 << 30, 1), ("f", 10, 20, 2), ("f", 5000, 90_000, 3), ("f", 5000, 90_000, 4)], "path string, start long, end long, unit long")
    points = spark.createDataFrame([("f", 15), ("f", 21), ("f", 6000), ("f", 1 << 30), ("g", 1), ("f", 15)], "path string, at long")
    got = {(r["path"], r["at"]): r["unit"] for r in R.enclosing(points, ranges, "path", "at", "start", "end", ["unit"]).collect()}
    assert got == {("f", 15): 2, ("f", 21): 1, ("f", 6000): 3, ("f", 1 << 30): None, ("g", 1): None}


@pytest.mark.parametrize("name", ["C04_prose_search", "W01_resolver", "p3_found", "p4_found", "R02_debounce"])
def test_partitioning_changes_nothing(spark, name):
    answers = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(sorted(map(str, catalog.queries()[name](spark, DIR).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert answers[0] == answers[1]
