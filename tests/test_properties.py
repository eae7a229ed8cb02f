"""Operators against brute force, and laws that hold for any data."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillscope.functions.numbers import rounded
from tillscope.functions.text import indel_ratio, standardize, title_case, token_set_ratio
from tillscope.operators import clean, lookup, matching, metrics, panel, quantiles, trend
from tillscope.plans import views
from tillscope.sources import csv

PROBS = [0.25, 0.5, 0.75]


def _skewed(n, seed, ties):
    """A third of the rows share one key; values are heavy-tailed or full of ties."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.34, 0, rng.integers(1, max(2, n // 20), n))
    values = rng.integers(0, 7, n).astype(float) if ties else np.exp(rng.normal(0, 4, n))
    return pd.DataFrame({"k": keys, "v": values})


@pytest.mark.parametrize("n,ties,accuracy", [(1, True, 100), (2, False, 100), (37, True, 100), (500, False, 100),
                                             (20000, False, 50), (20000, True, 50), (30000, False, 1000)])
def test_quantiles_are_exact(spark, monkeypatch, n, ties, accuracy):
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0 if n != 500 else 1000)  # by enclosures, and once by Spark's percentile
    data = _skewed(n, n + ties, ties)
    frame = spark.createDataFrame(data).repartition(5)
    got = quantiles.exact_quantiles(frame, ["k"], "v", PROBS, accuracy).toPandas().set_index("k").sort_index()
    want = data.groupby("k")["v"].quantile(PROBS).unstack()
    np.testing.assert_allclose(got[["q0", "q1", "q2"]].to_numpy(), want.to_numpy(), rtol=1e-12)
    assert (got["n"] == data.groupby("k").size()).all()
    whole = quantiles.exact_quantiles(frame, [], "v", PROBS, accuracy).toPandas()
    np.testing.assert_allclose(whole[["q0", "q1", "q2"]].to_numpy()[0], data["v"].quantile(PROBS), rtol=1e-12)


def test_quantiles_ignore_nulls_and_may_be_empty(spark):
    frame = spark.createDataFrame([(1, None), (1, 3.0), (None, 9.0)], "k int, v double")
    assert [tuple(r) for r in quantiles.exact_quantiles(frame, ["k"], "v", [0.5]).collect()] == [(1, 1, 3.0)]
    empty = frame.where("k > 5")
    assert quantiles.exact_quantiles(empty, ["k"], "v", [0.5]).count() == 0
    assert quantiles.exact_quantiles(empty, [], "v", [0.5]).count() == 0


def test_salted_join_equals_broadcast_join(spark, monkeypatch):
    rows = spark.createDataFrame(_skewed(3000, 1, True)).withColumn("k", F.expr("nullif(k, 3)"))
    stats = rows.where("k is not null and k % 2 = 0").groupBy("k").agg(F.avg("v").alias("m"))
    small = lookup.attach(rows, stats, ["k"]).toPandas()
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    large = lookup.attach(rows, stats, ["k"])
    assert "_salt" in large._jdf.queryExecution().toString()
    order = ["k", "v"]
    pd.testing.assert_frame_equal(
        small.sort_values(order).reset_index(drop=True), large.toPandas()[small.columns].sort_values(order).reset_index(drop=True)
    )


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_fill_in_order(spark, width):
    rng = random.Random(width)
    values = [None if i < 5 or rng.random() < 0.6 else rng.randint(0, 99) for i in range(300)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v int").repartition(6)
    got = [r["v"] for r in clean.fill_in_order(frame, ["v"], "id", width).orderBy("id").collect()]
    want = pd.Series(values, dtype="float").ffill().bfill().astype(int).tolist()
    assert got == want


def test_clipped_values_lie_within_the_fences(spark):
    data = _skewed(5000, 9, False)
    out = clean.clip_outliers_by_group(spark.createDataFrame(data), ["v"], "k").toPandas()
    low, mid, high = (data.groupby("k")["v"].quantile(q) for q in PROBS)
    size = data.groupby("k").size()
    for key, part in out.groupby("k"):
        if size[key] >= 4:
            reach = 3 * (high[key] - low[key])
            assert part["v"].between(low[key] - reach - 1e-9, high[key] + reach + 1e-9).all()
    medians = out.groupby("k")["v"].median()
    np.testing.assert_allclose(medians, mid)


def test_result_does_not_depend_on_partitions(spark, folder):
    sales = views.sales(spark, folder)
    one = panel.kpi_panel(sales.coalesce(1), "order_date").orderBy("period", "kpi").collect()
    many = panel.kpi_panel(sales.repartition(13), "order_date").orderBy("period", "kpi").collect()
    assert one == many


def test_categories_and_periods_add_up(spark, folder):
    sales = views.sales(spark, folder)
    total = metrics.scalar_panel(sales).where("kpi = 'Total Sales Amount'").first()["value"]
    by_category = metrics.sales_by(sales, "category").agg(F.sum("value")).first()[0]
    by_month = panel.kpi_panel(sales, "order_date").where("kpi = 'Total Sales Amount'").agg(F.sum("value")).first()[0]
    assert by_category == pytest.approx(total) and by_month == pytest.approx(total)
    shares = metrics.share_by(sales, "category").agg(F.sum("value")).first()[0]
    assert shares == pytest.approx(100)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _ratio(a, b):
    return 100.0 if not a and not b else 200 * _lcs(a, b) / (len(a) + len(b))


def _token_set(a, b):
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (ta & tb, ta - tb, tb - ta))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {x}".strip() for x in (left, right))
    # Only the differing words are aligned; the shared ones count as equal.
    apart = len(left) + len(right) - 2 * _lcs(left, right)
    scores = [100 * (1 - apart / (len(one) + len(two)))]
    if both:
        scores += [100 * (1 - (len(x) - len(both)) / (len(both) + len(x))) for x in (one, two)]
    return max(scores)


def test_similarity(spark):
    rng = random.Random(4)
    words = ["total", "sales", "amount", "order", "id", "unit", "price", "Sales", "amt", "cust"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(150)]
    pairs += [("kitten", "sitting"), ("", ""), ("a", "")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    rows = frame.select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r"), token_set_ratio(F.col("a"), F.col("b")).alias("t"))
    for row in rows.collect():
        assert row["r"] == pytest.approx(_ratio(row["a"], row["b"])), row
        assert row["t"] == pytest.approx(_token_set(row["a"], row["b"])), row


def test_title_case_is_pythons(spark):
    texts = ["o'neil T-SHIRT abc3d", "ßx straße", "éa\nüb\tc -ßy", "  MANY   spaces ", "", "x", "ÀB cD1eF_g"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", title_case(F.col("t")).alias("x"), standardize(F.col("t")).alias("s")).collect():
        assert row["x"] == row["t"].title()
        assert row["s"] == " ".join(row["t"].split()).title()


def test_rounding_is_pythons(spark):
    values = [0.5, 1.5, 2.675, 947.60625, 4.99185, 0.03125, -1.005, 1e-7, 123456789.12345]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for row in frame.select("v", rounded(F.col("v"), 2).alias("a"), rounded(F.col("v"), 4).alias("b")).collect():
        assert (row["a"], row["b"]) == (round(row["v"], 2), round(row["v"], 4))


def test_cosine_blocks_do_not_change_the_result(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    left, right = vectors.where("label < 5"), vectors.where("label >= 5")
    whole = matching.cosine_match(left, right, "vec_id", "embedding").toPandas().set_index("vec_id").sort_index()
    tiny = matching.cosine_match(left, right, "vec_id", "embedding", query_block=40, candidate_block=30)
    tiny = tiny.toPandas().set_index("vec_id").sort_index()
    np.testing.assert_allclose(whole["score"], tiny["score"], rtol=1e-9)
    a = np.vstack(left.orderBy("vec_id").toPandas()["embedding"])
    b = np.vstack(right.toPandas()["embedding"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    np.testing.assert_allclose(whole["score"], (unit(a) @ unit(b).T).max(axis=1), rtol=1e-5)


def test_seasonal_fit_is_least_squares(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2019-01-01", periods=900)
    t = (days - pd.Timestamp("2000-01-01")).days.to_numpy(float)
    y = 50 + 3 * t / 365.25 + 8 * np.sin(2 * np.pi * t / 365.25) + 2 * np.cos(2 * np.pi * t / 7) + rng.normal(0, 1, len(t))
    frame = spark.createDataFrame(pd.DataFrame({"s": np.arange(len(t)) % 2, "day": days.date, "y": y}))
    got = trend.seasonal_fit(frame, "day", "y", ["s"], yearly=1, weekly=1).toPandas()
    for s, part in got.groupby("s"):
        m = np.arange(len(t)) % 2 == s
        a = [np.ones(m.sum()), t[m] / 365.25]
        for period in (365.25, 7.0):
            a += [np.sin(2 * np.pi * t[m] / period), np.cos(2 * np.pi * t[m] / period)]
        want = np.linalg.lstsq(np.column_stack(a), y[m], rcond=None)[0]
        np.testing.assert_allclose(part["coefficient"], want, rtol=1e-4, atol=1e-4)


def test_last_definition_wins_and_supplements_only_add(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    extra = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    assert sorted(map(tuple, matching.override_union(base, extra, "k").collect())) == [("a", 1), ("b", 20), ("c", 30)]
    assert sorted(map(tuple, matching.supplement_union(base, extra, "k").collect())) == [("a", 1), ("b", 2), ("c", 30)]


def test_empty_and_all_null_columns(spark):
    frame = spark.createDataFrame([(None, None, None)], "selling_price decimal(12,2), quantity decimal(5,0), order_id long")
    values = {r["kpi"]: (r["value"], r["success"]) for r in metrics.scalar_panel(frame).collect()}
    assert values["Total Sales Amount"] == (0.0, True)
    assert values["Total Orders"] == (0.0, True)
    assert values["Average Order Value"] == (None, False)
    assert values["Average Selling Price per Item"] == (None, False)


def test_week_starts_on_monday(spark):
    frame = spark.createDataFrame([(datetime.datetime(2024, 1, 7, 23), ), (datetime.datetime(2024, 1, 8),)], "ts timestamp")
    weeks = [r["period"].isoformat() for r in panel.add_period(frame, "ts").orderBy("ts").collect()]
    assert weeks == ["2024-01-01", "2024-01-08"]


@pytest.mark.parametrize("formula,error", [
    ('sum("nope")', "Columns not found"),
    ('avg("s")', "needs a numeric column"),
    ('open("s")', "Only quoted columns"),
    ('sum("v") if 1 else 2', "Only quoted columns"),
    ('sum("v").__class__', "Only quoted columns"),
    ('sum("v") + "v"', "all aggregated or none"),
    ("1 + 1", "must use columns"),
    ('sum("v"', "not a valid expression"),
])
def test_formulas_are_refused(spark, formula, error):
    frame = spark.createDataFrame([(1.0, "x")], "v double, s string")
    with pytest.raises(metrics.FormulaError, match=error):
        metrics.formula_column(frame, formula)


def test_a_load_needs_rows(spark):
    with pytest.raises(csv.LoadError):
        csv.require_rows(spark.range(3), 4)
    assert csv.require_rows(spark.range(3), 3).count() == 3


def test_definitions_as_a_table(spark):
    rows = {r["kpi"]: r for r in matching.metric_definitions(spark.range(1)).collect()}
    assert len(rows) == 12
    assert rows["Average Order Value"]["needs"] == ["Total Sales Amount", "Total Orders"]
