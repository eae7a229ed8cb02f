"""Holiday rules against known dates and Python's calendar."""

import calendar
import datetime

import pytest
from pyspark.sql import functions as F

from tillscope.operators import calendars, trend
from tillscope.operators.calendars import Rule

D = datetime.date


def dates(spark, rules, first, last):
    rows = calendars.rule_dates(calendars.rule_table(spark, rules), F.lit(first), F.lit(last)).collect()
    return {(r["name"], r["date"]) for r in rows}


def test_known_dates(spark):
    found = dates(spark, calendars.SHOPPING, D(2024, 1, 1), D(2024, 12, 31))
    assert {("Easter", D(2024, 3, 31)), ("Thanksgiving", D(2024, 11, 28)), ("Black Friday", D(2024, 11, 29)), ("Cyber Monday", D(2024, 12, 2)),
            ("Mother's Day", D(2024, 5, 12)), ("Memorial Day", D(2024, 5, 27)), ("Father's Day", D(2024, 6, 16)), ("Labor Day", D(2024, 9, 2))} <= found
    assert len(found) == 15 and {r.name for r in calendars.SHOPPING} == {h[2] for h in trend.HOLIDAYS}
    assert {r.name: r.impact for r in calendars.SHOPPING} == {h[2]: h[3] for h in trend.HOLIDAYS}


def test_easter_of_many_years(spark):
    known = {1818: (3, 22), 1886: (4, 25), 1943: (4, 25), 1954: (4, 18), 1981: (4, 19), 1999: (4, 4), 2000: (4, 23), 2008: (3, 23), 2019: (4, 21), 2021: (4, 4), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25), 2049: (4, 18), 2076: (4, 19), 2285: (3, 22)}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select("y", calendars.easter(F.col("y")).alias("d")).collect()
    assert {r["y"]: (r["d"].month, r["d"].day) for r in rows} == known
    eastern = {2008: (4, 27), 2013: (5, 5), 2016: (5, 1), 2021: (5, 2), 2023: (4, 16), 2024: (5, 5), 2025: (4, 20)}
    rows = spark.createDataFrame([(y,) for y in eastern], "y int").select("y", calendars.orthodox_easter(F.col("y")).alias("d")).collect()
    assert {r["y"]: (r["d"].month, r["d"].day) for r in rows} == eastern


@pytest.mark.parametrize("nth", [1, 2, 3, 4, 5, -1, -2, -5])
def test_weekdays_of_a_month(spark, nth):
    rules = [Rule(f"{m}-{w}", "neutral", "weekday", m, None, w, nth) for m in range(1, 13) for w in range(1, 8)]
    expected = set()
    for year in (2023, 2024):
        for m in range(1, 13):
            for w in range(1, 8):
                days = [D(year, m, d) for d in range(1, calendar.monthrange(year, m)[1] + 1) if D(year, m, d).isoweekday() == w]
                if len(days) >= abs(nth):
                    expected.add((f"{m}-{w}", days[nth - 1 if nth > 0 else nth]))
    assert dates(spark, rules, D(2023, 1, 1), D(2024, 12, 31)) == expected


def test_moved_and_limited_days(spark):
    rules = [
        Rule("a", kind="fixed", month=1, day=1, observed="nearest"), Rule("b", kind="fixed", month=12, day=25, observed="monday"), Rule("c", kind="fixed", month=2, day=29),
        Rule("d", kind="before", month=5, day=24, weekday=1), Rule("e", kind="after", month=6, day=20, weekday=6), Rule("f", month=3, day=3, first_year=2022, last_year=2022), Rule("g", kind="unknown"),
    ]
    found = dates(spark, rules, D(2021, 12, 1), D(2024, 12, 31))
    assert found == {
        ("a", D(2021, 12, 31)), ("a", D(2023, 1, 2)), ("a", D(2024, 1, 1)), ("b", D(2021, 12, 27)), ("b", D(2022, 12, 26)), ("b", D(2023, 12, 25)), ("b", D(2024, 12, 25)), ("c", D(2024, 2, 29)),
        ("d", D(2022, 5, 23)), ("d", D(2023, 5, 22)), ("d", D(2024, 5, 20)), ("e", D(2022, 6, 25)), ("e", D(2023, 6, 24)), ("e", D(2024, 6, 22)), ("f", D(2022, 3, 3)),
    }


def test_windows_in_effects_and_models(spark):
    """Sales double in the week before Easter and on no other day."""
    rules = [Rule("Easter", "positive", "easter", before=7), Rule("Nothing", month=8, day=20, before=2, after=2)]
    rows = spark.range(365 * 4).select(F.date_add(F.lit(D(2021, 1, 1)), F.col("id").cast("int")).alias("day"))
    near = F.lit(False)
    for d in (D(2021, 4, 4), D(2022, 4, 17), D(2023, 4, 9), D(2024, 3, 31)):
        near = near | F.col("day").between(d - datetime.timedelta(7), d)
    sales = rows.withColumn("y", F.when(near, 200.0).otherwise(100.0))
    found = {r["name"]: r for r in trend.holiday_effect(sales, "day", "y", days=None, holidays=calendars.rule_table(spark, rules)).collect()}
    assert found["Easter"]["rows"] == 32 and abs(found["Easter"]["difference"] - 100) < 1 and abs(found["Nothing"]["difference"]) < 5
    fit = {r["term"]: r["coefficient"] for r in trend.seasonal_fit(sales, "day", "y", yearly=0, holidays=rules).collect()}
    assert abs(fit["holiday Easter"] - 100) < 1e-6 and abs(fit["holiday Nothing"]) < 1e-6
    panel = spark.createDataFrame([("k", D(2024, 3, 28), 1.0), ("k", D(2024, 6, 1), 2.0)], "kpi string, period date, value double")
    shown = trend.holidays_near_points(panel, holidays=calendars.rule_table(spark, calendars.SHOPPING)).collect()
    assert [(r["name"], r["date"]) for r in shown] == [("Easter", D(2024, 3, 31)), ("Memorial Day", D(2024, 5, 27))]
