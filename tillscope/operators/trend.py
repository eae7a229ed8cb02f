"""Anomalies, trend, volatility, holidays and seasonal structure of series."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.functions.numbers import finite, fixed
from tillscope.functions.text import let
from tillscope.operators.calendars import Rule, is_rules, rule_dates, rule_hit

# Anomaly threshold in deviations, fewest points, trend and volatility bands.
ANOMALY_Z = 2.0
ANOMALY_POINTS = 3
UP, DOWN = 1.1, 0.9
HIGH_VOLATILITY, MODERATE_VOLATILITY = 0.3, 0.1
HOLIDAY_DAYS = 7
WINDOW_DAYS = 31  # a holiday's own window reaches no farther

# Shopping calendar as month, day, name, expected impact.
HOLIDAYS = (
    (1, 1, "New Year's Day", "neutral"),
    (2, 14, "Valentine's Day", "positive"),
    (4, 17, "Easter", "positive"),
    (5, 14, "Mother's Day", "positive"),
    (5, 29, "Memorial Day", "positive"),
    (6, 18, "Father's Day", "positive"),
    (7, 4, "Independence Day", "positive"),
    (9, 4, "Labor Day", "positive"),
    (10, 31, "Halloween", "positive"),
    (11, 23, "Thanksgiving", "positive"),
    (11, 24, "Black Friday", "very_positive"),
    (11, 27, "Cyber Monday", "very_positive"),
    (12, 25, "Christmas", "very_positive"),
    (12, 26, "Boxing Day", "positive"),
    (12, 31, "New Year's Eve", "neutral"),
)


def _whole(keys: Sequence[str]):
    return Window.partitionBy(*keys, "kpi")


def chart_points(panel: DataFrame) -> DataFrame:
    """Points that can be drawn: numeric and finite."""
    return panel.withColumn("value", finite(F.col("value"))).where(F.col("value").isNotNull())


def anomalies(panel: DataFrame, keys: Sequence[str] = (), threshold: float = ANOMALY_Z) -> DataFrame:
    """Points more than ``threshold`` population deviations from their series' mean."""
    whole = _whole(keys)
    order = whole.orderBy("period")
    scored = chart_points(panel).withColumns(
        {
            "index": F.row_number().over(order) - 1,
            "_n": F.count("value").over(whole),
            "_mean": F.avg("value").over(whole),
            "_sd": F.stddev_pop("value").over(whole),
        }
    )
    z = F.abs((F.col("value") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    return scored.where((F.col("_n") >= ANOMALY_POINTS) & (z > threshold)).select(
        *keys, "kpi", "period", "index", "value", z.alias("z")
    )


def _direction(first: Column, last: Column) -> tuple[Column, Column]:
    up, down = last > first * UP, last < first * DOWN
    percent = F.try_divide(last - first, first) * 100
    return (
        F.when(up, "upward").when(down, "downward").otherwise("stable"),
        F.when(up | down, percent).otherwise(0.0),
    )


def _series(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: first and last value, extremes, mean and spread, in one aggregation."""
    return (
        chart_points(panel)
        .groupBy(*keys, "kpi")
        .agg(
            F.count("value").alias("points"),
            F.min_by("value", "period").alias("first"),
            F.max_by("value", "period").alias("last"),
            F.max("value").alias("peak"),
            F.min("value").alias("low"),
            F.avg("value").alias("average"),
            F.stddev_pop("value").alias("spread"),
        )
    )


def trend_direction(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether a series ends over 10 % above or below its first value."""
    trend, percent = _direction(F.col("first"), F.col("last"))
    return _series(panel, keys).select(*keys, "kpi", trend.alias("trend"), percent.alias("change_pct"))


def _volatility() -> Column:
    return (
        F.when(F.col("spread") > F.col("average") * HIGH_VOLATILITY, "high")
        .when(F.col("spread") > F.col("average") * MODERATE_VOLATILITY, "moderate")
        .otherwise("low")
    )


def volatility(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of a series relative to its mean."""
    return _series(panel, keys).select(*keys, "kpi", "average", "spread", _volatility().alias("volatility"))


def trend_facts(
    panel: DataFrame, keys: Sequence[str] = (), kpis: Sequence[str] | None = None, charts: int | None = None
) -> DataFrame:
    """Report text per series with at least two points; ``charts`` keeps only the first of the chosen KPIs."""
    if kpis is not None:
        panel = panel.where(F.col("kpi").isin(*kpis[:charts]))
    trend, percent = _direction(F.col("first"), F.col("last"))
    odd = anomalies(panel, keys).groupBy(*keys, "kpi").agg(F.count(F.lit(1)).alias("anomalies"))
    facts = _series(panel, keys).where(F.col("points") >= 2)
    for key in keys:
        facts = facts.where(F.col(key).isNotNull())
    return facts.join(odd, [*keys, "kpi"], "left").select(
        *keys,
        "kpi",
        trend.alias("trend"),
        F.when(percent == 0, "minimal change")
        .otherwise(F.concat(fixed(percent, 1, grouped=False, signed=True), F.lit("%")))
        .alias("change"),
        fixed(F.col("peak"), 0).alias("peak"),
        fixed(F.col("low"), 0).alias("low"),
        fixed(F.col("average"), 0).alias("average"),
        _volatility().alias("volatility"),
        F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
    )


def chart_series(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series the (ISO date, value) points in order."""
    points = F.array_sort(
        F.collect_list(F.struct(F.date_format("period", "yyyy-MM-dd").alias("x_axis"), F.col("value").alias("y_axis")))
    )
    return chart_points(panel).groupBy(*keys, "kpi").agg(points.alias("points"))


# ---------------------------------------------------------------- holidays


def holiday_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLIDAYS, "month int, day int, name string, impact string")


def holidays_between(span: DataFrame, holidays: DataFrame | None = None, windows: bool = False) -> DataFrame:
    """Holidays of every year between a one-row (first, last) span: as many rows per year as there are holidays.

    ``holidays`` has a month and a day for each, the same every year, or is a table of
    rules (``calendars.rule_table``). With ``windows`` also the days before and after that
    each has an effect on (none in the fixed table).
    """
    holidays = holidays if holidays is not None else holiday_table(span.sparkSession)
    bounds = span.select(F.struct(F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last")).alias("s")).scalar()
    first, last = bounds.getField("first"), bounds.getField("last")
    more = ["before", "after"] if windows else []
    if is_rules(holidays):
        return rule_dates(holidays, first, last).select("date", "name", "impact", *more)
    years = F.explode(F.sequence(F.year(first), F.year(last)))
    dated = holidays.withColumn("year", years).select(
        F.expr("try_make_timestamp(year, month, day, 0, 0, 0)").cast("date").alias("date"),
        "name",
        "impact",
        *[F.lit(0).alias(c) for c in more],
    )
    return dated.where(F.col("date").between(first, last))


def holidays_near_points(
    panel: DataFrame,
    keys: Sequence[str] = (),
    days: int = HOLIDAY_DAYS,
    shown: int | None = None,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Holidays inside a series' span and within ``days`` of one of its points; ``shown`` keeps the first few.

    Each holiday is spread over the days around it, which turns the range
    condition into an equality on the date.
    """
    points = chart_points(panel).select(*keys, "kpi", "period")
    span = points.agg(F.min("period").alias("first"), F.max("period").alias("last"))
    calendar = holidays_between(span, holidays)
    around = calendar.withColumn(
        "period", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days)))
    )
    ends = points.groupBy(*keys, "kpi").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    near = points.join(around, "period").groupBy(*keys, "kpi", "date", "name", "impact").agg(F.lit(1).alias("one"))
    inside = near.join(ends, [*keys, "kpi"]).where(F.col("date").between(F.col("first"), F.col("last")))
    order = _whole(keys).orderBy("date", "name")
    numbered = inside.withColumn("position", F.row_number().over(order))
    kept = numbered if shown is None else numbered.where(F.col("position") <= shown)
    return kept.select(*keys, "kpi", "position", "date", "name", "impact")


def charts(panel: DataFrame, keys: Sequence[str] = (), holidays: DataFrame | None = None) -> DataFrame:
    """Per series its points in order, the positions of its anomalies and the holidays near its points."""
    by = [*keys, "kpi"]
    odd = anomalies(panel, keys).groupBy(*by).agg(F.array_sort(F.collect_list("index")).alias("anomalies"))
    near = holidays_near_points(panel, keys, holidays=holidays).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("date", "name", "impact"))).alias("holidays")
    )
    empty = F.array()
    joined = chart_series(panel, keys).join(odd, by, "left").join(near, by, "left")
    return joined.select(*by, "points", F.coalesce("anomalies", empty).alias("anomalies"), F.coalesce("holidays", empty).alias("holidays"))


# ---------------------------------------------------------------- trend model


def _days(when: str) -> Column:
    return F.date_diff(F.col(when), F.lit("1970-01-01").cast("date")).cast("double")


def trend_fit(df: DataFrame, when: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per series over days; rows lacking the date or the value are left out."""
    rows = df.where(F.col(when).isNotNull() & F.col(value).isNotNull())
    y, x = F.col(value).cast("double"), _days(when)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def daily_totals(df: DataFrame, when: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, sum and sum of squares per series and day.

    Every model below is a sum over rows of functions of the day, so this
    table, one row per day and series, replaces the raw rows.
    """
    rows = df.where(F.col(when).isNotNull() & F.col(value).isNotNull())
    y = F.col(value).cast("double")
    return rows.groupBy(*keys, F.col(when).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_yy")
    )


def _line(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The least-squares line from daily totals, centred on the mean day."""
    x, n = _days("day"), F.col("n")
    centre = days.groupBy(*keys).agg(
        (F.sum(n * x) / F.sum(n)).alias("mean_x"), (F.sum("sum_y") / F.sum(n)).alias("mean_y")
    )
    joined = _with_line(days, centre, keys)
    dx = _days("day") - F.col("mean_x")
    slope = F.try_divide(F.sum(dx * (F.col("sum_y") - n * F.col("mean_y"))), F.sum(n * dx * dx))
    return joined.groupBy(*keys, "mean_x", "mean_y").agg(F.coalesce(slope, F.lit(0.0)).alias("slope"))


def _with_line(days: DataFrame, line: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return days.join(line, list(keys))
    names = line.columns
    record = line.select(F.struct(*names)).scalar()
    return days.withColumns({c: record.getField(c) for c in names})


def seasonal_components(df: DataFrame, when: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean deviation from the trend line by month of year and by day of week."""
    days = daily_totals(df, when, value, keys)
    residual = _residuals(days, keys)
    parts = F.array(
        F.struct(F.lit("month").alias("component"), F.month("day").alias("level")),
        F.struct(F.lit("weekday").alias("component"), (F.weekday("day") + 1).alias("level")),
    )
    exploded = residual.select(*keys, "n", "residual", F.inline(parts))
    return exploded.groupBy(*keys, "component", "level").agg(
        F.sum("n").alias("rows"), (F.sum("residual") / F.sum("n")).alias("effect")
    )


def _residuals(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of deviations from the trend line per day."""
    lined = _with_line(days, _line(days, keys), keys)
    fitted = F.col("mean_y") + F.col("slope") * (_days("day") - F.col("mean_x"))
    return lined.withColumn("residual", F.col("sum_y") - F.col("n") * fitted)


def holiday_effect(
    df: DataFrame,
    when: str,
    value: str,
    keys: Sequence[str] = (),
    days: int | None = 3,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Mean deviation from trend within ``days`` of each holiday, against all other days.

    Without ``days`` each holiday counts in the window its rule states.
    """
    totals = daily_totals(df, when, value, keys)
    residual = _residuals(totals, keys)
    span = totals.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    margin = WINDOW_DAYS if days is None else days
    wide = span.select(F.date_sub("first", margin).alias("first"), F.date_add("last", margin).alias("last"))
    before, after = (F.col(c) if days is None else F.lit(days) for c in ("before", "after"))
    around = holidays_between(wide, holidays, windows=True).select(
        "name", F.explode(F.sequence(F.date_sub("date", before), F.date_add("date", after))).alias("day")
    )
    # Windows of two dates of one holiday may meet; a day counts once.
    around = around.distinct()
    near = residual.join(around, "day").groupBy(*keys, "name").agg(
        F.sum("n").alias("rows"), F.sum("residual").alias("near")
    )
    whole = residual.groupBy(*keys).agg(F.sum("n").alias("all_rows"), F.sum("residual").alias("all_sum"))
    joined = _with_line(near, whole, keys)
    effect = F.col("near") / F.col("rows")
    other = F.try_divide(F.col("all_sum") - F.col("near"), F.col("all_rows") - F.col("rows"))
    return joined.select(
        *keys, "name", "rows", effect.alias("near_effect"), other.alias("other_effect"), (effect - other).alias("difference")
    )


# A regressor: the part of the model it belongs to, its name and its value on a day.
Term = tuple[str, str, Column]
MONTH_DAYS = 30.5


def _regressors(
    when: str, origin: Column, yearly: int, weekly: int, monthly: int, holidays: bool | Sequence[Rule], hinges: Sequence[datetime.date] = ()
) -> list[Term]:
    """Intercept, years since the origin and since each hinge, Fourier terms of the year, week and month, and one indicator per holiday.

    ``holidays`` is true for the fixed table, or lists rules, whose indicators hold in their windows.
    """
    t = F.date_diff(F.col(when), origin).cast("double")
    terms: list[Term] = [("trend", "level", F.lit(1.0)), ("trend", "trend", t / 365.25)]
    terms += [("trend", f"hinge {day}", F.greatest(F.date_diff(F.col(when), F.lit(day)).cast("double"), F.lit(0.0)) / 365.25) for day in hinges]
    for part, name, period, order in (
        ("yearly", "year", 365.25, yearly), ("weekly", "week", 7.0, weekly), ("monthly", "month", MONTH_DAYS, monthly),
    ):
        for k in range(1, order + 1):
            angle = t * (2 * math.pi * k / period)
            terms += [(part, f"{name}_sin{k}", F.sin(angle)), (part, f"{name}_cos{k}", F.cos(angle))]
    if holidays and holidays is not True:
        terms += [("holiday", f"holiday {rule.name}", rule_hit(F.col(when), rule).cast("double")) for rule in holidays]
    elif holidays:
        for month, day, name, _ in HOLIDAYS:
            hit = (F.month(when) == month) & (F.dayofmonth(when) == day)
            terms.append(("holiday", f"holiday {name}", hit.cast("double")))
    return terms


def _solution(system: Column, size: int) -> Column:
    """Solve a small symmetric system (rows with their right side at the end) by elimination, one fold per pivot.

    A regressor without variation of its own (a holiday that never came) gets zero.
    """

    def eliminate(rows: Column, i: Column) -> Column:
        pivot = F.get(F.get(rows, i), i)
        scaled = F.transform(F.get(rows, i), lambda x: F.when(pivot > PIVOT, x / pivot).otherwise(0.0))
        return let(
            scaled,
            lambda own: F.transform(
                rows, lambda row, r: F.when(r == i, own).otherwise(F.zip_with(row, own, lambda a, b: a - F.get(row, i) * b))
            ),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


# Fixed value: below this pivot, of mean squares, a regressor is a combination of others.
PIVOT = 1e-11
ORIGIN = "2000-01-01"


def _coefficients(days: DataFrame, terms: Sequence[Term], keys: Sequence[str]) -> DataFrame:
    """One row per series with the coefficients as an array, from daily totals.

    Spark sums the normal equations map-side, so each series is solved as a single
    small row however many rows it had, inside the JVM.
    """
    size = len(terms)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    one, two = (F.array(*[F.lit(p[k]) for p in pairs]) for k in (0, 1))
    x = F.array(*[c for _, _, c in terms])
    design = days.select(*keys, "n", "sum_y", x.alias("_x"))
    # One long row per day and product, summed up before the shuffle: hundreds of sums side by side take longer to plan than to run.
    products = F.concat(
        F.zip_with(one, two, lambda i, j: F.col("n") * F.get("_x", i) * F.get("_x", j)), F.transform("_x", lambda v: v * F.col("sum_y"))
    )
    sums = design.select(*keys, F.posexplode(products).alias("_p", "_v")).groupBy(*keys, "_p").agg(F.sum("_v").alias("_v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s.getField("_v"))
    # The first product is the number of rows: everything becomes a mean.
    means = sums.groupBy(*keys).agg(ordered.alias("_s")).where(F.size("_s") > 0)
    means = means.select(*keys, F.transform("_s", lambda v: v / F.get("_s", F.lit(0))).alias("_s"))

    def cell(i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        place = low * size - (low * (low - 1) / 2).cast("int") + high - low
        return F.when(j == size, F.get("_s", F.lit(len(pairs)) + i)).otherwise(F.get("_s", place.cast("int")))

    steps = lambda last: F.sequence(F.lit(0), F.lit(last))
    system = F.transform(steps(size - 1), lambda i: F.transform(steps(size), lambda j: cell(i, j)))
    return means.select(*keys, _solution(system, size).alias("_c"))


def seasonal_fit(
    df: DataFrame,
    when: str,
    value: str,
    keys: Sequence[str] = (),
    yearly: int = 3,
    weekly: int = 0,
    monthly: int = 0,
    holidays: bool | Sequence[Rule] = False,
    hinges: Sequence[datetime.date] = (),
) -> DataFrame:
    """Additive trend, seasonality and holidays by least squares: one row per coefficient.

    The trend's line bends at the given ``hinges``; ``bends.trend_bends`` finds such days.
    """
    terms = _regressors("day", F.lit(ORIGIN).cast("date"), yearly, weekly, monthly, holidays, hinges)
    solved = _coefficients(daily_totals(df, when, value, keys), terms, keys)
    labelled = F.arrays_zip(F.array(*[F.lit(n) for _, n, _ in terms]).alias("term"), F.col("_c").alias("coefficient"))
    return solved.select(*keys, F.inline(labelled)).toDF(*keys, "term", "coefficient")


def trend_components(
    df: DataFrame,
    when: str,
    value: str,
    keys: Sequence[str] = (),
    yearly: int = 3,
    weekly: int = 2,
    monthly: int = 0,
    holidays: bool | Sequence[Rule] = True,
    hinges: Sequence[datetime.date] = (),
    interval: float | None = None,
) -> DataFrame:
    """The fitted model day by day: rows, mean, trend, yearly, weekly, monthly and holiday parts, and their sum.

    With ``interval`` also lower and upper, between which that share of single rows lies
    by the deviation of all rows of the series from the fit.
    """
    terms = _regressors("day", F.lit(ORIGIN).cast("date"), yearly, weekly, monthly, holidays, hinges)
    days = daily_totals(df, when, value, keys)
    known = _with_line(days, _coefficients(days, terms, keys), keys)
    parts = {}
    for part in ("trend", "yearly", "weekly", "monthly", "holiday"):
        own = [F.get("_c", F.lit(i)) * c for i, (of, _, c) in enumerate(terms) if of == part]
        parts[part] = sum(own[1:], own[0]) if own else F.lit(0.0)
    out = known.select(*keys, "day", F.col("n").alias("rows"), (F.col("sum_y") / F.col("n")).alias("mean"), *[c.alias(n) for n, c in parts.items()])
    out = out.withColumn("fitted", F.col("trend") + F.col("yearly") + F.col("weekly") + F.col("monthly") + F.col("holiday"))
    if interval is None:
        return out
    fitted = out.join(days.select(*keys, "day", "sum_y", "sum_yy"), [*keys, "day"]) if keys else out.join(days.select("day", "sum_y", "sum_yy"), "day")
    off = F.sum(F.col("sum_yy") - 2 * F.col("fitted") * F.col("sum_y") + F.col("rows") * F.col("fitted") * F.col("fitted"))
    free = F.greatest(F.sum("rows") - F.lit(len(terms)), F.lit(1))
    spread = fitted.groupBy(*keys).agg(F.sqrt(F.greatest(off, F.lit(0.0)) / free).alias("_spread"))
    reach = F.col("_spread") * NormalDist().inv_cdf(0.5 + interval / 2)
    banded = _with_line(out, spread, keys)
    return banded.withColumn("lower", F.col("fitted") - reach).withColumn("upper", F.col("fitted") + reach).drop("_spread")
