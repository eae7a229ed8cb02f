"""Null keys, text columns, broken cells and equal rows in the core operators."""

import re

import pytest
from pyspark.sql import functions as F

from tillscope.operators import clean, cleaning, lookup, metrics, panel, report
from tillscope.plans import views


def test_shares_keep_groups_without_a_key(spark):
    rows = [("a", "web", 10.0), ("b", "web", 30.0), (None, "web", 60.0), ("a", None, 5.0), (None, None, 15.0)]
    sales = spark.createDataFrame(rows, "category string, channel string, selling_price double").withColumn("quantity", F.lit(1.0))
    got = {(r["channel"], r["category"]): r["value"] for r in metrics.share_by(sales, "category", ["channel"]).collect()}
    assert got == {("web", "a"): 10.0, ("web", "b"): 30.0, (None, "a"): 25.0}
    assert {r["category"]: r["value"] for r in metrics.share_by(sales, "category").collect()} == {"a": 12.5, "b": 25.0}


def test_mode_of_a_text_column(spark):
    rows = [("x", "red"), ("x", "red"), ("x", "blue"), ("x", None), ("y", None), (None, "green"), (None, None)]
    frame = spark.createDataFrame(rows, "k string, v string")
    got = sorted((r["k"] or "-", r["v"]) for r in clean.impute_by_group(frame, "v", "k", "mode").collect())
    assert got == [("-", "green"), ("-", "red"), ("x", "blue"), ("x", "red"), ("x", "red"), ("x", "red"), ("y", "red")]


def test_a_broken_cell_fails_its_own_steps_only(spark):
    rows = [(i, "n/a" if i == 3 else str(10 + i), None if i == 5 else float(i), f"name {i % 3}") for i in range(20)]
    frame = spark.createDataFrame(rows, "row_id int, price string, quantity double, product_name string")
    out, log = cleaning.apply_cleaning(frame, "row_id")
    status = {r["step_id"]: r["status"] for r in log.collect()}
    assert status["price_handle_outliers"] == "failed" and status["quantity_fill_missing"] == "applied"
    got = {r["row_id"]: (r["price"], r["quantity"]) for r in out.collect()}
    assert len(got) == 20 and got[3][0] == "n/a" and got[5][1] is not None


def test_equal_rows_of_a_hot_key_are_spread(spark):
    rows = spark.range(40_000, numPartitions=16).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    stats = spark.createDataFrame([("hot", 7)], "k string, s int")
    joined = lookup.salted_join(rows, stats, ["k"], 64)
    assert joined.where("s = 7").count() == 40_000
    salted = rows.select(F.pmod(F.xxhash64(F.spark_partition_id(), "k", "v"), F.lit(64)).alias("s")).distinct().count()
    assert salted > 8


WIDE = [(1, "a", None, 0.0, [1]), (2, None, "a", 0.0, [1]), (3, "a", None, -0.0, [1]), (4, "a", None, 0.0, [1]), (5, "a", None, float("nan"), None), (6, "a", None, float("nan"), None), (7, "", None, None, []), (8, None, None, None, [])]


def test_duplicates_by_fingerprint(spark):
    frame = spark.createDataFrame(WIDE, "id int, x string, y string, z double, v array<int>")
    assert sorted(r["id"] for r in clean.drop_duplicates(frame, "id").collect()) == [1, 2, 5, 7, 8]
    assert tuple(clean.duplicate_report(frame, "id").first()) == (3, "3,4,6")
    assert clean.drop_duplicates(frame.limit(0), "id").collect() == [] and clean.duplicate_report(frame.limit(0), "id").first()["duplicates"] == 0


def test_rows_of_one_fingerprint_are_compared(spark, monkeypatch):
    monkeypatch.setattr(clean, "fingerprint", lambda df, columns: [F.lit(1).alias("_print1"), F.lit(2).alias("_print2")])
    frame = spark.createDataFrame(WIDE, "id int, x string, y string, z double, v array<int>")
    assert sorted(r["id"] for r in clean.drop_duplicates(frame, "id").collect()) == [1, 2, 5, 7, 8]


def test_wide_cells_are_not_shuffled_to_find_duplicates(spark):
    frame = spark.range(100).select("id", *[F.repeat(F.col("id").cast("string"), 50).alias(f"c{i}") for i in range(20)])
    plan = clean.drop_duplicates(frame, "id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(c\d", plan)


@pytest.mark.parametrize("columns", [["x"], ["x", "y", "z", "v"]])
def test_fingerprints_tell_nulls_apart(spark, columns):
    frame = spark.createDataFrame(WIDE, "id int, x string, y string, z double, v array<int>")
    prints = frame.select("id", *clean.fingerprint(frame, columns)).collect()
    same = {tuple(r[1:]) for r in prints}
    assert len(same) == {1: 3, 4: 5}[len(columns)]


def test_one_value_decides_the_order_of_a_column(spark):
    rows = [(1, "03/04/2024", "03/04/2024", "5-6-2024"), (2, "25/12/2024", "12/25/2024", "13-1-2024"), (3, "2024-02-01", "1/2/2024 10:30", "1-13-2024"), (4, None, "x", "")]
    frame = spark.createDataFrame(rows, "id int, a string, b string, c string")
    found = {r["column"]: (r["first_over"], r["second_over"], r["ambiguous"], r["order"]) for r in clean.date_orders(frame, ["a", "b", "c"]).collect()}
    assert found == {"a": (1, 0, 1, "dmy"), "b": (0, 1, 2, "mdy"), "c": (1, 1, 1, None)}
    orders = clean.decided_orders(frame, ["a", "b", "c"])
    assert orders == {"a": "dmy", "b": "mdy"}
    got = clean.parse_dates(frame, ["a", "b", "c"], orders).orderBy("id").collect()
    assert [str(r["a"])[:10] for r in got] == ["2024-04-03", "2024-12-25", "2024-02-01", "None"]
    assert [str(r["b"])[:16] for r in got] == ["2024-03-04 00:00", "2024-12-25 00:00", "2024-01-02 10:30", "None"]
    assert str(clean.parse_dates(frame, ["a"]).where("id = 1").first()["a"])[:10] == "2024-03-04"  # value by value, months first


def test_own_metrics_reach_pack_panel_and_cards(spark, folder):
    sales = views.sales(spark, folder)
    own = [
        metrics.OwnMetric("Buyers", {"d": metrics.distinct_estimate("customer_id")}, lambda s: s["d"], ("customer_id",)),
        metrics.OwnMetric("Median Quantity", {"q": metrics.quantile_estimate("quantity", 0.5)}, lambda s: s["q"], ("quantity",)),
        metrics.OwnMetric("Smallest Price", {"m": metrics.smallest("selling_price")}, lambda s: s["m"], ("selling_price",)),
        metrics.OwnMetric("Needs More", {"m": metrics.smallest("margin")}, lambda s: s["m"], ("margin",)),
    ]
    pack = {r["kpi"]: r for r in metrics.kpi_pack(sales, own=own).where("category is null").collect()}
    exact = sales.agg(F.count_distinct("customer_id").alias("d"), F.median("quantity").alias("q"), F.min("selling_price").alias("m")).first()
    assert abs(pack["Buyers"]["value"] / exact["d"] - 1) < 0.05 and abs(pack["Median Quantity"]["value"] - float(exact["q"])) <= 2
    assert pack["Smallest Price"]["value"] == float(exact["m"]) and not pack["Needs More"]["success"]
    months = panel.kpi_panel(sales, "order_date", "month", own=own)
    assert {m.name for m in own[:3]} <= {r["kpi"] for r in months.select("kpi").distinct().collect()}
    cards = report.kpi_cards(months.drop("success", "error")).where("kpi = 'Buyers'").collect()
    assert len(cards) == 1 and cards[0]["display"] != "N/A"
    plan = metrics.scalar_panel(sales, own=own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1
    with pytest.raises(ValueError):
        metrics.scalar_panel(sales, own=[metrics.OwnMetric("Total Orders", {}, lambda s: F.lit(1.0))])
