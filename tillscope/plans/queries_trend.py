"""Periods, panels, change, anomalies, seasons and trend."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tillscope.operators import panel, trend
from tillscope.operators.metrics import scalar_panel
from tillscope.plans import ctes, views
from tillscope.plans.queries_metrics import pack_sql
from tillscope.plans.registry import query
from tillscope.session import durable
from tillscope.sources.tables import table

_K = ["category"]
_P = ctes.panel(_K)
_S = ctes.SALES
_MONTHLY = f"{_S}, dated as (select *, cast(date_trunc('month', order_date) as date) as period from sales)"


def monthly_panel(spark, folder, keys=_K):
    """The panel, computed once: every fact below reads this small table several times."""
    return durable(panel.kpi_panel(views.sales(spark, folder), "order_date", "month", keys).drop("success", "error"))


@query(
    "period_type",
    """select 'orders' as source, date_diff('day', min(o_orderdate), max(o_orderdate)) as days,
    case when date_diff('day', min(o_orderdate), max(o_orderdate)) < 30 then 'WoW' else 'MoM' end as period_type from orders
    union all select 'events', date_sub('day', min(ts), max(ts)),
    case when date_sub('day', min(ts), max(ts)) < 30 then 'WoW' else 'MoM' end from events""",
)
def period_type(spark, folder):
    def one(name, column):
        kind = panel.period_type(table(spark, folder, name), column)
        return kind.select(F.lit(name).alias("source"), "days", "period_type")

    return one("orders", "o_orderdate").unionByName(one("events", "ts"))


@query(
    "add_period",
    """select event_id, cast(date_trunc('week', ts) as date) as period from events""",
)
def add_period(spark, folder):
    return panel.add_period(table(spark, folder, "events"), "ts").select("event_id", "period")


@query(
    "add_period_monthly",
    """select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as period from orders""",
)
def add_period_monthly(spark, folder):
    return panel.add_period(table(spark, folder, "orders"), "o_orderdate").select("o_orderkey", "period")


@query("kpi_panel", f"with {ctes.panel()} select period, kpi, value, true as success, null::varchar as error from panel")
def kpi_panel(spark, folder):
    return panel.kpi_panel(views.sales(spark, folder), "order_date", "month")


@query("kpi_panel_by_category", f"with {_P} select category, period, kpi, value from panel")
def kpi_panel_by_category(spark, folder):
    return panel.kpi_panel(views.sales(spark, folder), "order_date", "month", _K).drop("success", "error")


@query(
    "kpi_panel_weekly",
    f"""with w as (select cast(date_trunc('week', ts) as date) as period, user_id, cast(value as decimal(12,2)) as value from events)
    select period, kpi, value from (select period, cast(count(distinct user_id) as double) as "Total Orders",
    {ctes.rounded('cast(sum(value) as double) / count(value)', 4)} as "Average Selling Price per Item" from w group by period)
    unpivot (value for kpi in ("Total Orders", "Average Selling Price per Item"))""",
)
def kpi_panel_weekly(spark, folder):
    """A table with only two roles yields only the metrics these support."""
    rows = table(spark, folder, "events").selectExpr("ts", "user_id as order_id", "cast(value as decimal(12,2)) as selling_price")
    return panel.kpi_panel(rows, "ts", "week").drop("success", "error")


_OWN = {"Units per Order": 'sum("quantity") / nunique("order_id")', "Median Price": 'median("selling_price")', "Margin": 'sum("cost")'}


def _own_panel_sql() -> str:
    return f"""{ctes.SALES}, dated as (select *, cast(date_trunc('month', order_date) as date) as period from sales),
    panel as (({ctes.scalars(['period'], 'dated')}) union all
      select period, 'Units per Order', cast(sum(quantity) as double) / count(distinct order_id) from dated group by 1 union all
      select period, 'Median Price', median(cast(selling_price as double)) from dated group by 1 union all
      select distinct period, 'Margin', null::double from dated)"""


@query("kpi_panel_custom", f"with {_own_panel_sql()} select period, kpi, round(value, 4) as value, value is not null as success from panel")
def kpi_panel_custom(spark, folder):
    """Own formulas beside the pack; one names a column that is not there."""
    out = panel.kpi_panel(views.sales(spark, folder), "order_date", "month", formulas=_OWN)
    return out.select("period", "kpi", F.round("value", 4).alias("value"), "success")


@query(
    "kpi_panel_auto",
    f"""with s as (select date_diff('second', min(ts), max(ts)) / 86400 < 30 as short from events), w as (select
      cast(case when s.short then date_trunc('week', ts) else date_trunc('month', ts) end as date) as period, user_id, cast(value as decimal(12,2)) as value
      from events, s)
    select period, kpi, value from (select period, cast(count(distinct user_id) as double) as "Total Orders",
    {ctes.rounded('cast(sum(value) as double) / count(value)', 4)} as "Average Selling Price per Item" from w group by period)
    unpivot (value for kpi in ("Total Orders", "Average Selling Price per Item"))""",
)
def kpi_panel_auto(spark, folder):
    """The span of the dates picks the period."""
    rows = table(spark, folder, "events").selectExpr("ts", "user_id as order_id", "cast(value as decimal(12,2)) as selling_price")
    return panel.kpi_panel(rows, "ts").drop("success", "error")


@query(
    "category_panel",
    f"""with {_MONTHLY}, p as ({pack_sql(['period'], 'dated')}) select period, kpi, category, round(value, 6) as value, label from p
    where kpi in ('Sales per Category', 'Sales per Channel', 'Category Contribution Percentage', 'Top-Selling Category', 'Top-Selling Product')""",
)
def category_panel(spark, folder):
    out = panel.category_panel(views.sales(spark, folder), "order_date", "month")
    return out.withColumn("value", F.round("value", 6))


@query(
    "broadcast_metric",
    f"""with {ctes.panel()}, t as ({ctes.scalars()}) select period, t.kpi, t.value
    from (select distinct period from panel), t""",
)
def broadcast_metric(spark, folder):
    sales = views.sales(spark, folder)
    return panel.broadcast_metric(panel.kpi_panel(sales, "order_date", "month"), scalar_panel(sales))


@query(
    "latest_previous",
    f"""with {_P}, m as (select max(period) as latest, (select max(period) from panel
      where period < (select max(period) from panel)) as prior from panel)
    select category, kpi, latest as period, prior as previous_period,
    max(case when period = latest then value end) as value, max(case when period = prior then value end) as previous
    from panel, m where period >= prior group by category, kpi, latest, prior""",
)
def latest_previous(spark, folder):
    return panel.latest_previous(monthly_panel(spark, folder), _K)


_CURRENCY = "regexp_matches(lower(kpi), 'revenue|amount|price')"
_POINTS = f"regexp_matches(lower(kpi), 'percent|rate|rating|score') and not {_CURRENCY}"


def changes(source: str, value: str = "value", previous: str = "previous") -> str:
    return f"""select *, case when {previous} <> 0 then {value} - {previous} end as change,
    case when {previous} <> 0 then ({value} - {previous}) / abs({previous}) * 100 end as change_pct from {source}"""


_ARROW = "case when change_pct > 2 then '↑' when change_pct < -2 then '↓' when change_pct is not null then '→' end"


@query(
    "period_change",
    f"""with {_P}, l as (select *, case when lag(period) over w = period - interval 1 month then lag(value) over w end as previous from panel window w as (partition by category, kpi order by period)),
    c as ({changes('l')}) select *, {_ARROW} as arrow, case when {_POINTS} then change else change_pct end as reported,
    case when {_POINTS} then 'points' else '%' end as reported_unit from c""",
)
def period_change(spark, folder):
    return panel.period_change(monthly_panel(spark, folder), _K)


_SPARK_TEXT = "string_agg(cast(cast(value as decimal(38,4)) as varchar), ',' order by period)"
_RECENT = "period in (select distinct period from panel order by period desc limit 10) and value <> 0"


@query("sparkline", f"with {_P} select category, kpi, {_SPARK_TEXT} as sparkline from panel where {_RECENT} group by 1, 2")
def sparkline(spark, folder):
    out = panel.sparkline(monthly_panel(spark, folder), _K)
    text = F.array_join(F.transform("sparkline", lambda v: v.cast("decimal(38,4)").cast("string")), ",")
    return out.withColumn("sparkline", text)


_BASELINE = (
    "case month(period) " + " ".join(f"when {m} then {p}::double" for m, p in panel.SEASONAL_BASELINE.items()) + " end"
)


@query(
    "seasonal_performance",
    f"""with {_P}, l as (select *, case when lag(period) over w = period - interval 1 month then lag(value) over w end as previous from panel window w as (partition by category, kpi order by period)),
    a as (select *, (value - previous) / previous * 100 as actual, {_BASELINE} as expected from l
      where previous is not null and value is not null)
    select category, kpi, period, case when previous = 0 then 0 else {ctes.rounded('actual', 1)} end as actual_change,
    case when previous = 0 then 0 else expected end as expected_change,
    case when previous = 0 then 0 else {ctes.rounded('actual - expected', 1)} end as variance,
    case when previous = 0 then 'insufficient_data' when actual - expected > 5 then 'outperforming'
    when actual - expected < -5 then 'underperforming' else 'on_track' end as assessment from a""",
)
def seasonal_performance(spark, folder):
    return panel.seasonal_performance(monthly_panel(spark, folder), _K)


@query(
    "yoy",
    f"""with y as (select o_orderpriority, cast(year(o_orderdate) as int) as year, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as current
      from orders group by 1, 2)
    select a.o_orderpriority, a.year, a.current, b.current as last_year, case when b.current > 0 then a.current - b.current end as yoy_change,
    case when b.current > 0 then {ctes.rounded('(a.current - b.current) / b.current * 100', 1)} end as yoy_pct,
    coalesce(b.current > 0, false) as available
    from y a left join y b on a.o_orderpriority = b.o_orderpriority and a.year = b.year + 1""",
)
def yoy(spark, folder):
    orders = table(spark, folder, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return panel.yoy(orders, "o_orderdate", "amount", ["o_orderpriority"])


# ---------------------------------------------------------------- facts per series

def scored_sql(keys=("category",)):
    by = ", ".join([*keys, "kpi"])
    return f"""{ctes.panel(keys)}, scored as (select *, row_number() over (partition by {by} order by period) - 1 as index,
    count(value) over w as n, avg(value) over w as mean, stddev_pop(value) over w as sd from panel
    window w as (partition by {by}))"""


_ODD = "n >= 3 and sd <> 0 and abs((value - mean) / sd) > 2"


@query(
    "anomalies",
    f"with {scored_sql()} select category, kpi, period, cast(index as int) as index, value, round(abs((value - mean) / sd), 6) as z from scored where {_ODD}",
)
def anomalies(spark, folder):
    return trend.anomalies(monthly_panel(spark, folder), _K).withColumn("z", F.round("z", 6))


def series_sql(keys=("category",)):
    by = ", ".join([*keys, "kpi"])
    return f"""{scored_sql(keys)}, series as (select {by}, count(value) as points, arg_min(value, period) as first,
    arg_max(value, period) as last, max(value) as peak, min(value) as low, avg(value) as average, stddev_pop(value) as spread,
    count_if({_ODD}) as anomalies from scored group by {by}),
    facts as (select *, case when last > first * 1.1 then 'upward' when last < first * 0.9 then 'downward' else 'stable' end as trend,
    case when last > first * 1.1 or last < first * 0.9 then case when first <> 0 then (last - first) / first * 100 end else 0 end as pct,
    case when spread > average * 0.3 then 'high' when spread > average * 0.1 then 'moderate' else 'low' end as volatility from series)"""


@query("trend_direction", f"with {series_sql()} select category, kpi, trend, round(pct, 6) as change_pct from facts")
def trend_direction(spark, folder):
    return trend.trend_direction(monthly_panel(spark, folder), _K).withColumn("change_pct", F.round("change_pct", 6))


@query(
    "volatility",
    f"with {series_sql()} select category, kpi, round(spread / nullif(average, 0), 6) as relative_spread, volatility from facts",
)
def volatility(spark, folder):
    out = trend.volatility(monthly_panel(spark, folder), _K)
    return out.select("category", "kpi", F.round(F.try_divide("spread", "average"), 6).alias("relative_spread"), "volatility")




@query(
    "trend_facts",
    f"""with {series_sql()} select category, kpi, trend, case when pct = 0 then 'minimal change' else format('{{:+.1f}}%', pct) end as change,
    format('{{:,.0f}}', peak) as peak, format('{{:,.0f}}', low) as low, format('{{:,.0f}}', average) as average, volatility, anomalies
    from facts where points >= 2""",
)
def trend_facts(spark, folder):
    return trend.trend_facts(monthly_panel(spark, folder), _K, kpis=tuple(ctes.KPIS))


@query(
    "chart_series",
    f"""with {_P} select category, kpi, string_agg(strftime(period, '%Y-%m-%d') || '=' || cast(cast(value as decimal(38,4)) as varchar), ';'
    order by period) as points from panel where value is not null group by 1, 2""",
)
def chart_series(spark, folder):
    out = trend.chart_series(monthly_panel(spark, folder), _K)
    point = lambda p: F.concat(p.getField("x_axis"), F.lit("="), p.getField("y_axis").cast("decimal(38,4)").cast("string"))
    return out.withColumn("points", F.array_join(F.transform("points", point), ";"))


# ---------------------------------------------------------------- holidays

_HOLIDAYS = "holidays(month, day, name, impact) as (values " + ", ".join(
    "({}, {}, '{}', '{}')".format(m, d, n.replace("'", "''"), i) for m, d, n, i in trend.HOLIDAYS
) + ")"


def _calendar(first: str, last: str) -> str:
    return f"""calendar as (select make_date(y, month, day) as date, name, impact
      from holidays, range((select year({first})), (select year({last})) + 1) r(y)
      where make_date(y, month, day) between cast({first} as date) and cast({last} as date))"""


@query(
    "holidays_in_period",
    f"""with {_HOLIDAYS}, {_calendar('(select min(o_orderdate) from orders)', '(select max(o_orderdate) from orders)')}
    select * from calendar""",
)
def holidays_in_period(spark, folder):
    span = table(spark, folder, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return trend.holidays_between(span)


@query(
    "holidays_near_points",
    f"""with {_P}, {_HOLIDAYS}, {_calendar('(select min(period) from panel)', '(select max(period) from panel)')},
    near as (select distinct category, kpi, date, name, impact from panel, calendar where abs(date_diff('day', period, date)) <= 7
      and date between (select min(period) from panel p where p.category = panel.category and p.kpi = panel.kpi)
      and (select max(period) from panel p where p.category = panel.category and p.kpi = panel.kpi))
    select category, kpi, cast(row_number() over w as int) as position, date, name, impact from near
    window w as (partition by category, kpi order by date, name)""",
)
def holidays_near_points(spark, folder):
    return trend.holidays_near_points(monthly_panel(spark, folder), _K)


@query(
    "report_charts",
    f"""with {scored_sql()}, {_HOLIDAYS}, {_calendar('(select min(period) from panel)', '(select max(period) from panel)')},
    pts as (select category, kpi, string_agg(strftime(period, '%Y-%m-%d') || '=' || cast(cast(value as decimal(38,4)) as varchar), ';'
      order by period) as points, string_agg(case when {_ODD} then cast(index as varchar) end, ',' order by period) as odd
      from scored where value is not null group by 1, 2),
    near as (select distinct category, kpi, date, name from panel, calendar where abs(date_diff('day', period, date)) <= 7
      and date between (select min(period) from panel p where p.category = panel.category and p.kpi = panel.kpi)
      and (select max(period) from panel p where p.category = panel.category and p.kpi = panel.kpi)),
    h as (select category, kpi, string_agg(strftime(date, '%Y-%m-%d') || ' ' || name, ';' order by date, name) as holidays from near group by 1, 2)
    select category, kpi, points, coalesce(odd, '') as anomalies, coalesce(holidays, '') as holidays from pts left join h using (category, kpi)""",
)
def report_charts(spark, folder):
    """Every chart with its points, the positions of its anomalies and the holidays near its points."""
    out = trend.charts(monthly_panel(spark, folder), _K)
    point = lambda p: F.concat(p.getField("x_axis"), F.lit("="), p.getField("y_axis").cast("decimal(38,4)").cast("string"))
    day = lambda h: F.concat(F.date_format(h.getField("date"), "yyyy-MM-dd"), F.lit(" "), h.getField("name"))
    return out.select(
        "category",
        "kpi",
        F.array_join(F.transform("points", point), ";").alias("points"),
        F.array_join("anomalies", ",").alias("anomalies"),
        F.array_join(F.transform("holidays", day), ";").alias("holidays"),
    )


# ---------------------------------------------------------------- trend model

_DAYS = "date_diff('day', date '1970-01-01', cast(o_orderdate as date))"


@query(
    "trend_fit",
    f"""select o_orderpriority, count(*) as rows, round(regr_slope(o_totalprice, {_DAYS}), 4) as slope,
    round(regr_intercept(o_totalprice, {_DAYS}), 2) as intercept, round(regr_r2(o_totalprice, {_DAYS}), 6) as r2
    from orders group by 1""",
)
def trend_fit(spark, folder):
    out = trend.trend_fit(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])
    return out.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 2), "r2": F.round("r2", 6)})


_RESIDUAL = f"""fit as (select o_orderpriority as g, avg({_DAYS}) as mx, avg(o_totalprice) as my, regr_slope(o_totalprice, {_DAYS}) as b
      from orders group by 1),
    residual as (select o_orderpriority, cast(o_orderdate as date) as day, o_totalprice - my - b * ({_DAYS} - mx) as r
      from orders join fit on g = o_orderpriority)"""


@query(
    "seasonal_components",
    f"""with {_RESIDUAL} select o_orderpriority, 'month' as component, cast(month(day) as int) as level, count(*) as rows, round(avg(r), 4) as effect
    from residual group by 1, 3 union all
    select o_orderpriority, 'weekday', cast(isodow(day) as int), count(*), round(avg(r), 4) from residual group by 1, 3""",
)
def seasonal_components(spark, folder):
    out = trend.seasonal_components(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])
    return out.withColumn("effect", F.round("effect", 4))


def _terms_sql(yearly: int, weekly: int, monthly: int, holidays: bool) -> list[tuple[str, str, str]]:
    """(part, name, SQL) of the regressors over a column ``day`` and its number ``t``."""
    terms = [("trend", "level", "1.0::double"), ("trend", "trend", "t / 365.25")]
    for part, name, period, order in (("yearly", "year", 365.25, yearly), ("weekly", "week", 7.0, weekly), ("monthly", "month", 30.5, monthly)):
        for k in range(1, order + 1):
            terms += [(part, f"{name}_{f}{k}", f"{f}(t * {2 * math.pi * k / period!r})") for f in ("sin", "cos")]
    if holidays:
        terms += [
            ("holiday", f"holiday {n}", f"(case when month(day) = {m} and day(day) = {d} then 1.0 else 0.0 end)::double") for m, d, n, _ in trend.HOLIDAYS
        ]
    return terms


def _model_sql(terms) -> str:
    """CTEs ending in ``solved`` (g, c): the normal equations per priority, eliminated pivot by pivot."""
    size = len(terms)
    rows = ", ".join(
        "[" + ", ".join([*[f"sum(x{i} * x{j} * n) / sum(n)" for j in range(size)], f"sum(x{i} * sum_y) / sum(n)"]) + "]" for i in range(size)
    )
    return f"""recursive daily as (select o_orderpriority as g, cast(o_orderdate as date) as day, count(*) as n, sum(o_totalprice) as sum_y,
      cast(date_diff('day', date '2000-01-01', cast(o_orderdate as date)) as double) as t from orders group by all),
    design as (select *, {', '.join(f'{sql} as x{i}' for i, (_, _, sql) in enumerate(terms))} from daily),
    systems as (select g, [{rows}] as m from design group by g),
    steps(g, i, m) as (select g, 1, m from systems union all select g, i + 1, list_transform(m, lambda row, r: case when r = i
      then list_transform(m[i], lambda x: case when m[i][i] > 1e-11 then x / m[i][i] else 0 end)
      else list_transform(row, lambda x, k: x - row[i] * case when m[i][i] > 1e-11 then m[i][k] / m[i][i] else 0 end) end) from steps where i <= {size}),
    solved as (select g, list_transform(m, lambda row: row[{size + 1}]) as c from steps where i = {size + 1})"""


_FIT_TERMS = _terms_sql(3, 2, 2, True)


@query(
    "seasonal_fit",
    f"""with {_model_sql(_FIT_TERMS)} select g as o_orderpriority, unnest([{', '.join("'" + n.replace("'", "''") + "'" for _, n, _ in _FIT_TERMS)}]) as term,
    round(unnest(c), 2) as coefficient from solved""",
)
def seasonal_fit(spark, folder):
    """Coefficients of trend, year, week, month and holidays."""
    orders = table(spark, folder, "orders")
    out = trend.seasonal_fit(orders, "o_orderdate", "o_totalprice", ["o_orderpriority"], yearly=3, weekly=2, monthly=2, holidays=True)
    return out.withColumn("coefficient", F.round("coefficient", 2))


# On days of few rows the fit is exact and ends in halves of a cent: this moves them off the edge of rounding.
_OFF = 0.0013
_PART_TERMS = _terms_sql(3, 2, 0, True)


def _part_sql(part: str) -> str:
    return " + ".join(f"c[{i + 1}] * x{i}" for i, (of, _, _) in enumerate(_PART_TERMS) if of == part) or "0.0"


@query(
    "trend_components",
    f"""with {_model_sql(_PART_TERMS)} select d.g as o_orderpriority, day, n as rows, round(sum_y / n + {_OFF}, 2) as mean,
    {', '.join(f'round({_part_sql(p)} + {_OFF}, 2) as {p}' for p in ('trend', 'yearly', 'weekly', 'monthly', 'holiday'))},
    round({' + '.join(f'({_part_sql(p)})' for p in ('trend', 'yearly', 'weekly', 'monthly', 'holiday'))} + {_OFF}, 2) as fitted
    from design d join solved s on s.g = d.g""",
)
def trend_components(spark, folder):
    """The model's parts on every day."""
    out = trend.trend_components(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])
    return out.withColumns({c: F.round(F.col(c) + _OFF, 2) for c in ("mean", "trend", "yearly", "weekly", "monthly", "holiday", "fitted")})


@query(
    "holiday_effect",
    f"""with {_RESIDUAL}, {_HOLIDAYS}, {_calendar("(select min(o_orderdate) - interval 3 day from orders)", "(select max(o_orderdate) + interval 3 day from orders)")},
    near as (select o_orderpriority, name, count(*) as n, sum(r) as s from residual join calendar on abs(date_diff('day', day, date)) <= 3 group by 1, 2),
    whole as (select o_orderpriority, count(*) as n, sum(r) as s from residual group by 1)
    select near.o_orderpriority, name, near.n as rows, round(near.s / near.n, 4) as near_effect,
    round((whole.s - near.s) / (whole.n - near.n), 4) as other_effect,
    round(near.s / near.n - (whole.s - near.s) / (whole.n - near.n), 4) as difference
    from near join whole on whole.o_orderpriority = near.o_orderpriority""",
)
def holiday_effect(spark, folder):
    out = trend.holiday_effect(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])
    return out.withColumns({c: F.round(c, 4) for c in ("near_effect", "other_effect", "difference")})
