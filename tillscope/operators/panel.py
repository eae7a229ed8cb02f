"""Periods, KPI panels and period-over-period facts.

A panel is a long table (series keys..., kpi, period, value). A series has one
row per week or month, so windows over a series are bounded by the calendar and
not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import period_start
from tillscope.functions.numbers import rounded
from tillscope.operators import metrics

# Shortest span in days for monthly periods; thresholds of the arrows in percent.
MONTHLY_FROM_DAYS = 30
ARROW_PCT = 2.0
SPARKLINE_PERIODS = 10
# Typical change against the previous month, in percent, January to December.
SEASONAL_BASELINE = {
    1: -15, 2: -5, 3: 0, 4: 5, 5: 8, 6: 3, 7: 2, 8: -3, 9: 5, 10: 10, 11: 25, 12: -8,
}
SEASONAL_MARGIN = 5.0

# Words in a KPI name that choose its display.
CURRENCY_WORDS = ("revenue", "amount", "price")
PERCENT_WORDS = ("percent", "rate")
RATING_WORDS = ("rating", "score")


def names_with(name: Column, words: Sequence[str]) -> Column:
    return F.rlike(F.lower(name), F.lit("|".join(words)))


# ---------------------------------------------------------------- periods


def period_type(df: DataFrame, when: str, keys: Sequence[str] = ()) -> DataFrame:
    """WoW if the dates span less than 30 full days, else MoM."""
    first, last = F.min(when), F.max(when)
    spans = df.groupBy(*keys).agg(first.alias("first"), last.alias("last"))
    days = F.timestamp_diff("DAY", F.col("first"), F.col("last"))
    return spans.select(
        *keys, days.alias("days"), F.when(days < MONTHLY_FROM_DAYS, "WoW").otherwise("MoM").alias("period_type")
    )


def add_period(df: DataFrame, when: str, unit: str | None = None) -> DataFrame:
    """Add the ``period`` each row falls in; rows without a date are left out.

    Without a unit, the span of the whole table decides between week and month.
    """
    if unit:
        period = period_start(F.col(when), unit)
    else:
        kind = period_type(df, when).select("period_type").scalar()
        period = F.when(kind == "WoW", period_start(F.col(when), "week")).otherwise(period_start(F.col(when), "month"))
    return df.where(F.col(when).isNotNull()).withColumn("period", period)


def kpi_panel(
    sales: DataFrame,
    when: str,
    unit: str | None = None,
    keys: Sequence[str] = (),
    formulas: Mapping[str, str] | None = None,
    own: Sequence[metrics.OwnMetric] = (),
) -> DataFrame:
    """Every scalar metric per series and period, the caller's ``own`` ones too, from one aggregation, and formulas beside them.

    Without a unit the span of the dates decides between weeks and months, which takes a scan of them.
    What follows (changes, cards, trends, the report) reads own metrics like any other.
    """
    dated, by = add_period(sales, when, unit), [*keys, "period"]
    out = metrics.scalar_panel(dated, by, own)
    if formulas:
        own = metrics.custom_metrics(dated, formulas, by)
        out = out.unionByName(own.select(out.columns))
    return out


def category_panel(sales: DataFrame, when: str, unit: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Every categorical metric per series and period."""
    return metrics.category_panel(add_period(sales, when, unit), [*keys, "period"])


def broadcast_metric(panel: DataFrame, totals: DataFrame) -> DataFrame:
    """Copy whole-table metrics (kpi, value) onto every period of the panel."""
    record = totals.agg(F.collect_list(F.struct("kpi", "value")).alias("kpis")).scalar()
    return panel.select("period").distinct().select("period", F.inline(record))


def _by_series(keys: Sequence[str]):
    return Window.partitionBy(*keys, "kpi")


def latest_previous(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last two periods of the panel, side by side per series and KPI.

    The two periods are those of the whole panel, so a series that stops early
    has no latest value.
    """
    periods = panel.groupBy("period").agg(F.lit(1).alias("one")).orderBy(F.desc("period")).limit(2)
    last_two = periods.agg(F.struct(F.max("period").alias("latest"), F.min("period").alias("previous")).alias("p")).scalar()
    latest, previous = last_two.getField("latest"), last_two.getField("previous")
    return (
        panel.where(F.col("period") >= previous)
        .groupBy(*keys, "kpi")
        .agg(
            F.max(F.when(F.col("period") == latest, F.col("value"))).alias("value"),
            F.max(F.when((F.col("period") == previous) & (previous < latest), F.col("value"))).alias("previous"),
        )
        .select(*keys, "kpi", latest.alias("period"), previous.alias("previous_period"), "value", "previous")
    )


def change_columns(value: Column, previous: Column, kpi: Column) -> dict[str, Column]:
    """Change, percent change and arrow; nothing when the previous value is null or zero.

    Percentages and ratings report their change in points, the rest in percent.
    """
    usable = previous.isNotNull() & (previous != 0)
    change = F.when(usable, value - previous)
    percent = F.when(usable, (value - previous) / F.abs(previous) * 100)
    in_points = (names_with(kpi, PERCENT_WORDS) | names_with(kpi, RATING_WORDS)) & ~names_with(kpi, CURRENCY_WORDS)
    return {
        "change": change,
        "change_pct": percent,
        "arrow": F.when(percent > ARROW_PCT, "↑").when(percent < -ARROW_PCT, "↓").when(percent.isNotNull(), "→"),
        "reported": F.when(in_points, change).otherwise(percent),
        "reported_unit": F.when(in_points, "points").otherwise("%"),
    }


def _previous(keys: Sequence[str], unit: str) -> Column:
    """The value one week or month before; null where the series has no such period."""
    order = _by_series(keys).orderBy("period")
    before = F.date_sub("period", 7) if unit == "week" else F.add_months("period", -1)
    return F.when(F.lag("period").over(order) == before, F.lag("value").over(order))


def period_change(panel: DataFrame, keys: Sequence[str] = (), unit: str = "month") -> DataFrame:
    """Each period against the one just before it; a gap has nothing to compare with."""
    lagged = panel.withColumn("previous", _previous(keys, unit))
    return lagged.withColumns(change_columns(F.col("value"), F.col("previous"), F.col("kpi")))


def sparkline(panel: DataFrame, keys: Sequence[str] = (), periods: int = SPARKLINE_PERIODS) -> DataFrame:
    """The last periods' values in order; zeros and nulls are dropped."""
    recent = panel.groupBy("period").agg(F.lit(1).alias("one")).orderBy(F.desc("period")).limit(periods)
    start = recent.agg(F.min("period")).scalar()
    kept = panel.where((F.col("period") >= start) & (F.col("value") != 0))
    points = F.array_sort(F.collect_list(F.struct("period", "value")))
    return kept.groupBy(*keys, "kpi").agg(F.transform(points, lambda p: p.getField("value")).alias("sparkline"))


def seasonal_columns(value: Column, previous: Column, month: Column) -> dict[str, Column]:
    """Actual against typical change of the month; nulls where either value is missing."""
    baseline = F.create_map(*[F.lit(x) for pair in SEASONAL_BASELINE.items() for x in pair])
    usable = value.isNotNull() & previous.isNotNull()
    flat = previous == 0
    actual = F.try_divide(value - previous, previous) * 100
    expected = F.try_element_at(baseline, month).cast("double")
    variance = actual - expected
    assessment = (
        F.when(variance > SEASONAL_MARGIN, "outperforming")
        .when(variance < -SEASONAL_MARGIN, "underperforming")
        .otherwise("on_track")
    )

    def unless_flat(column: Column, when_flat) -> Column:
        return F.when(usable, F.when(flat, F.lit(when_flat)).otherwise(column))

    return {
        "actual_change": unless_flat(rounded(actual, 1), 0.0),
        "expected_change": unless_flat(expected, 0.0),
        "variance": unless_flat(rounded(variance, 1), 0.0),
        "assessment": unless_flat(assessment, "insufficient_data"),
    }


def seasonal_performance(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each month's change against its typical change from the month before."""
    lagged = panel.withColumn("previous", _previous(keys, "month")).where(
        F.col("previous").isNotNull() & F.col("value").isNotNull()
    )
    columns = seasonal_columns(F.col("value"), F.col("previous"), F.month("period"))
    return lagged.select(*keys, "kpi", "period", *[c.alias(n) for n, c in columns.items()])


def yoy(df: DataFrame, when: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Yearly totals against the year before; available only if that total is positive."""
    totals = df.where(F.col(when).isNotNull()).groupBy(*keys, F.year(when).alias("year")).agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("current")
    )
    before = totals.select(*keys, (F.col("year") + 1).alias("year"), F.col("current").alias("last_year"))
    joined = totals.join(before, [*keys, "year"], "left")
    available = F.coalesce(F.col("last_year") > 0, F.lit(False))
    change = F.col("current") - F.col("last_year")
    return joined.select(
        *keys,
        "year",
        "current",
        "last_year",
        F.when(available, change).alias("yoy_change"),
        F.when(available, rounded(change / F.col("last_year") * 100, 1)).alias("yoy_pct"),
        available.alias("available"),
    )
