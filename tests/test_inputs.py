"""Inputs outside the test tables: odd CSV files, marker signs, equal rows on one key, sparse keys, gaps, text ids."""

import datetime

import pytest
from pyspark.sql import functions as F

from tillscope.functions.text import title_case
from tillscope.operators import clean, lookup, matching, metrics, panel, quantiles, texts
from tillscope.sources import csv


def test_csv_header_is_the_first_line_only(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'"k","v"\n1,x\nk,v\n\n2,"two\nlines"\n')
    (tmp_path / "b c.csv").write_bytes("k,v\n3,\xe9t\xe9\n".encode("latin-1"))
    rows = csv.csv_scan_any(spark, str(tmp_path), "k string, v string", multiLine=True)
    assert sorted((r["k"], r["v"]) for r in rows.collect()) == [("1", "x"), ("2", "two\nlines"), ("3", "été"), ("k", "v")]
    opened = {r["file"].rpartition("/")[2]: r["open_lines"] for r in csv.split_records(spark, str(tmp_path)).collect()}
    assert opened == {"a.csv": 2, "b%20c.csv": 0}


def test_private_signs_in_texts(spark):
    rows = spark.createDataFrame([(1, "# a\nx\u0001y\n## Insights\n- one\u0001two\n")], "id long, md string")
    assert {(r["heading"], r["body"]) for r in texts.text_sections(rows, "id", "md").collect()} == {("a", "x\u0001y"), ("Insights", "- one\u0001two")}
    assert [r["content"] for r in texts.named_sections(rows, "id", "md").collect()] == ["one\u0001two"]
    assert rows.select(title_case(F.lit("x\u0001 y-z")).alias("t")).first()["t"] == "X\u0001 Y-Z"


def test_equal_rows_on_one_key_have_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "fits_broadcast", lambda table: False)
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    rows = spark.range(30_000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 20_000, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert quantiles.exact_quantiles(rows, ["k"], "v", [0.25, 0.9]).select("n", "q0", F.round("q1", 6)).first() == (30_000, 5.0, 26_999.1)


def test_missed_enclosures_are_widened(spark, monkeypatch):
    rows = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") % 997).cast("double").alias("v"))
    real, seen = quantiles._quantiles, []

    def once(df, keys, value, probs, accuracy):
        found, small = real(df, keys, value, probs, accuracy)
        seen.append(accuracy)
        return (found.withColumn("_missed", F.lit(len(seen) == 1)), small)

    monkeypatch.setattr(quantiles, "_quantiles", once)
    assert quantiles.exact_quantiles(rows, ["k"], "v", [0.5]).first()["q0"] == 496.5 and len(seen) == 2


@pytest.mark.parametrize("gap", [1, 10_000_000])
def test_ordered_fill_on_sparse_keys(spark, monkeypatch, gap):
    monkeypatch.setattr(clean, "MAX_RANGES", 50)
    rows = spark.range(2000).select((F.col("id") * gap).alias("id"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))
    got = [r["v"] for r in clean.fill_in_order(rows, ["v"], "id", 100).orderBy("id").collect()]
    assert got == [3 if i < 3 else (i - 3) // 7 * 7 + 3 for i in range(2000)]


def test_gaps_are_not_compared(spark):
    month = lambda m: datetime.date(2024, m, 1)
    rows = spark.createDataFrame([("x", month(1), 100.0), ("x", month(2), 110.0), ("x", month(4), 99.0)], "kpi string, period date, value double")
    assert [r["previous"] for r in panel.period_change(rows).orderBy("period").collect()] == [None, 100.0, None]
    assert [r["period"] for r in panel.seasonal_performance(rows).collect()] == [month(2)]
    weeks = rows.withColumn("period", F.expr("date_add(date'2024-01-01', case value when 100 then 0 when 110 then 7 else 21 end)"))
    assert [r["previous"] for r in panel.period_change(weeks, unit="week").orderBy("period").collect()] == [None, 100.0, None]


def test_panel_keyed_by_a_dimension_with_null_keys(spark):
    rows = [("a", "web", 10.0), ("a", None, 30.0), ("b", "web", 60.0), (None, None, 5.0)]
    sales = spark.createDataFrame(rows, "category string, channel string, selling_price double").withColumns({"quantity": F.lit(1), "product": F.lit("p"), "order_id": F.lit(1)})
    by = {(r["channel"], r["kpi"], r["category"]): r["value"] for r in metrics.category_panel(sales, ["channel"]).collect()}
    assert by["web", "Sales per Channel", "web"] == 70.0 and by["web", "Category Contribution Percentage", "b"] == pytest.approx(60 / 70 * 100)
    assert by[None, "Category Contribution Percentage", "a"] == pytest.approx(30 / 35 * 100)
    pack = metrics.kpi_pack(sales, ["category"])
    assert "dimension_value" in pack.columns and pack.where("category = 'a' and kpi = 'Sales per Category'").first()["value"] == 40.0


def test_cosine_with_text_ids_and_missing_vectors(spark):
    left = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", None), (None, [0.0, 1.0])], "id string, v array<double>")
    right = spark.createDataFrame([("c2", [2.0, 0.0]), ("c1", [1.0, 0.0]), ("c3", None)], "id string, v array<double>")
    found = {r["id"]: (r["match"], r["score"]) for r in matching.cosine_match(left, right, "id", "v").collect()}
    assert found["q1"] == ("c1", 1.0) and found["q2"] == (None, None) and set(found) == {"q1", "q2", None}
    assert {r["match"] for r in matching.cosine_match(left, right.limit(0), "id", "v").collect()} == {None}


def test_latest_by_key_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "c"), (2, None, "d")], "k long, p long, v string")
    for parts in (1, 4):
        got = {r["k"]: (r["p"], r["v"]) for r in matching.latest_by_key(rows.repartition(parts), "k", "p").collect()}
        assert got == {1: (5, "b"), 2: (None, "d")}


def test_the_number_of_files_is_exact(spark):
    rows = spark.range(30011).selectExpr("named_struct('file_name', concat('part-', id % 15011)) as _metadata", "id as day")
    assert csv.load_metadata(rows).first()["filename"] == "15011 files"
