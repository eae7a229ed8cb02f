"""Planted bends, seasons and holidays are found again."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillscope.operators import bends
from tillscope.operators.calendars import Rule

START = datetime.date(2018, 1, 1)


def series(rng, days, places, slopes, noise=1.0, yearly=0.0, weekly=0.0):
    """Daily values whose line has the given slopes (per year) between the given days."""
    t = np.arange(days)
    y = 100.0 + slopes[0] * t / 365.25
    for place, before, after in zip(places, slopes, slopes[1:]):
        y = y + (after - before) * np.maximum(0, t - place) / 365.25
    return t, y + yearly * np.sin(2 * np.pi * t / 365.25) + weekly * np.cos(2 * np.pi * t / 7) + noise * rng.normal(size=days)


PLANTED = {
    "straight": ([], [12.0]),
    "one": ([700], [10.0, -20.0]),
    "two": ([400, 1300], [30.0, 0.0, 25.0]),
    "three": ([500, 900, 1500], [-10.0, 20.0, -15.0, 10.0]),
}


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(11)
    rows = []
    for name, (places, slopes) in PLANTED.items():
        t, y = series(rng, 2200, places, slopes, noise=3.0, yearly=6.0, weekly=2.0)
        rows += [(name, START + datetime.timedelta(int(d)), float(v)) for d, v in zip(t, y)]
    rows += [("straight", None, 1.0), ("straight", START, None)]
    frame = spark.createDataFrame(rows, "series string, day date, y double").repartition(7)
    return bends.trend_bends(frame, "day", "y", ["series"], holidays=None)


def test_bends_are_found_within_a_month(found):
    rows = found.bends.orderBy("series", "day").collect()
    got = {name: [(r["day"] - START).days for r in rows if r["series"] == name] for name in PLANTED}
    assert {k: len(v) for k, v in got.items()} == {k: len(p) for k, (p, _) in PLANTED.items()}
    assert all(abs(a - b) <= 31 for name, (places, _) in PLANTED.items() for a, b in zip(got[name], places))
    change = {(r["series"], i): r["slope_change"] for name in PLANTED for i, r in enumerate(x for x in rows if x["series"] == name)}
    for name, (_, slopes) in PLANTED.items():
        for i, (before, after) in enumerate(zip(slopes, slopes[1:])):
            assert abs(change[name, i] - (after - before)) < 0.2 * abs(after - before)


def test_interval_holds_its_share(found):
    share = found.components.groupBy("series").agg(F.avg(F.col("mean").between(F.col("lower"), F.col("upper")).cast("double")).alias("share")).collect()
    assert all(0.77 < r["share"] < 0.83 for r in share)
    parts = found.components.withColumn("sum", F.col("trend") + F.col("yearly") + F.col("weekly") + F.col("monthly") + F.col("holiday"))
    assert parts.where(F.abs(F.col("sum") - F.col("fitted")) > 1e-6).count() == 0


def test_small_and_empty_series(spark):
    rows = [("one", START, 5.0), ("same", START, 1.0), ("same", START, 3.0), ("two", START, 1.0), ("two", START + datetime.timedelta(400), 2.0), (None, START, 7.0), (None, START + datetime.timedelta(3), 7.0)]
    frame = spark.createDataFrame(rows, "series string, day date, y double")
    got = bends.trend_bends(frame, "day", "y", ["series"])
    fitted = {(r["series"], r["day"]): r["fitted"] for r in got.components.collect()}
    assert abs(fitted["one", START] - 5.0) < 1e-6 and abs(fitted["same", START] - 2.0) < 1e-6 and abs(fitted[None, START] - 7.0) < 1e-6
    assert got.bends.count() == 0
    assert bends.trend_bends(frame.limit(0), "day", "y").components.collect() == []


def test_holidays_with_windows(spark):
    rules = [Rule("Easter", "positive", "easter", before=7)]
    t = np.arange(365 * 5)
    days = [START + datetime.timedelta(int(d)) for d in t]
    easter = [datetime.date(2018, 4, 1), datetime.date(2019, 4, 21), datetime.date(2020, 4, 12), datetime.date(2021, 4, 4), datetime.date(2022, 4, 17)]
    y = [50.0 + (30.0 if any(e - datetime.timedelta(7) <= d <= e for e in easter) else 0.0) for d in days]
    frame = spark.createDataFrame(pd.DataFrame({"day": days, "y": y}))
    got = bends.trend_bends(frame, "day", "y", yearly=0, weekly=0, holidays=rules)
    holiday = {r["day"]: r["holiday"] for r in got.components.where("holiday <> 0").collect()}
    assert len(holiday) == 8 * 5 and all(abs(v - 30) < 1.5 for v in holiday.values())


def test_lasso_agrees_with_its_conditions():
    """At the optimum, the gradient equals the penalty on active terms and stays below it elsewhere."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12))
    y = x[:, 3] * 2 - x[:, 7] + rng.normal(size=200)
    gram, moments = x.T @ x / 200, x.T @ y / 200
    penalty, ridge = np.full(12, 0.3), np.full(12, 0.01)
    penalty[0] = 0.0
    c = np.zeros(12)
    for _ in range(30):
        c = bends._lasso(gram, moments, penalty, ridge, c)
    slope = moments - gram @ c - ridge * c
    on = c != 0
    assert np.allclose(slope[on], penalty[on] * np.sign(c[on]), atol=1e-4) and (np.abs(slope[~on]) <= penalty[~on] + 1e-4).all()
