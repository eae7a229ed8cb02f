"""The published sample panel: changes, arrows, verdicts and card texts."""

import datetime

import pytest

from tillscope.operators import metrics, panel, report, trend

MONTHS = {
    "2022-01-01": (7398.50, 96.08, 57, 3.29, 42.86),
    "2022-11-01": (8200.00, 112.33, 59, 3.10, 39.73),
    "2022-12-01": (3549.00, 82.53, 38, 2.90, 27.91),
    "2023-11-01": (22961.50, 124.79, 111, 3.09, 33.70),
    "2023-12-01": (20261.50, 103.91, 118, 3.06, 30.77),
}
KPIS = ("Total Revenue", "Average Price", "Unique Customers", "Average Rating", "High Rating Percent")


@pytest.fixture(scope="module")
def months(spark):
    rows = [
        (kpi, datetime.date.fromisoformat(day), float(value))
        for day, values in MONTHS.items()
        for kpi, value in zip(KPIS, values)
    ]
    return spark.createDataFrame(rows, "kpi string, period date, value double")


def test_latest_change(months):
    last = {r["kpi"]: r for r in panel.period_change(months).where("period = '2023-12-01'").collect()}
    shown = {k: (round(r["change_pct"], 1), r["arrow"]) for k, r in last.items()}
    assert shown["Total Revenue"] == (-11.8, "↓")
    assert shown["Average Price"] == (-16.7, "↓")
    assert shown["Unique Customers"] == (6.3, "↑")
    assert shown["Average Rating"] == (-1.0, "→")
    assert last["Average Rating"]["reported_unit"] == "points"


def test_seasonal_verdict(months):
    row = panel.seasonal_performance(months).where("kpi = 'Total Revenue' and period = '2023-12-01'").first()
    assert (row["expected_change"], row["variance"], row["assessment"]) == (-8.0, -3.8, "on_track")


def test_cards(months):
    cards = {r["kpi"]: r for r in report.kpi_cards(months).collect()}
    assert cards["Total Revenue"]["display"] == "$20,261.50"
    assert cards["Total Revenue"]["description"] == "↓ -11.8% vs 2023-11 (was $22,961.50)"
    assert cards["Unique Customers"]["display"] == "118"
    assert cards["Average Rating"]["display"] == "3.06 / 5.0"
    assert cards["Average Rating"]["description"] == "→ -0.03 points vs 2023-11 (was 3.09)"
    assert cards["High Rating Percent"]["display"] == "30.8%"
    assert cards["Total Revenue"]["sparkline"] == [v[0] for v in MONTHS.values()]


def test_trend_facts(months):
    facts = {r["kpi"]: r for r in trend.trend_facts(months).collect()}
    revenue = facts["Total Revenue"]
    assert (revenue["trend"], revenue["change"], revenue["peak"], revenue["low"]) == ("upward", "+173.9%", "22,962", "3,549")
    assert revenue["volatility"] == "high"


def test_ratios(spark):
    rows = spark.createDataFrame([(i % 57, 1.0) for i in range(77)], "customer long, amount double")
    row = metrics.per_entity(rows, "customer", rows["amount"]).first()
    assert (row["rows"], row["entities"], round(row["rows_per_entity"], 2)) == (77, 57, 1.35)


def test_anomalies_need_three_points_and_a_spread(spark):
    flat = [("flat", datetime.date(2024, m, 1), 5.0) for m in range(1, 7)]
    short = [("short", datetime.date(2024, 1, 1), 1.0), ("short", datetime.date(2024, 2, 1), 99.0)]
    spike = [("spike", datetime.date(2024, m, 1), 100.0 if m == 7 else 1.0) for m in range(1, 13)]
    frame = spark.createDataFrame(flat + short + spike, "kpi string, period date, value double")
    assert [(r["kpi"], r["index"]) for r in trend.anomalies(frame).collect()] == [("spike", 6)]


def test_zero_previous_gives_no_change(spark):
    rows = [("k", datetime.date(2024, 1, 1), 0.0), ("k", datetime.date(2024, 2, 1), 5.0)]
    frame = spark.createDataFrame(rows, "kpi string, period date, value double")
    assert panel.period_change(frame).where("period = '2024-02-01'").first()["arrow"] is None
    assert panel.seasonal_performance(frame).first()["assessment"] == "insufficient_data"
    assert report.kpi_cards(frame).first()["description"] == "Period: 2024-02"
