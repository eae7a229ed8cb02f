"""Metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.functions.dates import period_start
from tillscope.operators import metrics
from tillscope.plans import ctes, views
from tillscope.plans.registry import query
from tillscope.sources.tables import table

_S = ctes.SALES


def _amount():
    return F.col("selling_price") * F.col("quantity")


def _scalar(key: str, kpi: str, *roles: str) -> None:
    """One metric of the pack on its own; only the tables its roles need are read."""

    @query(key, f"with {_S} select '{kpi}' as kpi, {ctes.KPIS[kpi]} as value from sales")
    def run(spark, folder):
        panel = metrics.scalar_panel(views.sales(spark, folder, roles))
        return panel.where(F.col("kpi") == kpi).select("kpi", "value")


_scalar("total_sales", "Total Sales Amount", "selling_price", "quantity")
_scalar("total_orders", "Total Orders", "order_id")
_scalar("total_units", "Total Units Sold", "quantity")
_scalar("avg_order_value", "Average Order Value", "selling_price", "quantity", "order_id")
_scalar("avg_selling_price", "Average Selling Price per Item", "selling_price")
_scalar("avg_discount", "Average Discount Percentage", "discount_percent")
_scalar("discount_utilization", "Discount Utilization Rate", "discount_percent", "order_id")

_BY = "cast(sum(selling_price * quantity) as double)"


@query(
    "sales_by_category",
    f"with {_S} select category, {_BY} as value from sales where category is not null group by category",
)
def sales_by_category(spark, folder):
    return metrics.sales_by(views.sales(spark, folder, ["selling_price", "quantity", "category"]), "category")


@query(
    "sales_by_channel",
    f"with {_S} select channel as category, {_BY} as value from sales where channel is not null group by channel",
)
def sales_by_channel(spark, folder):
    return metrics.sales_by(views.sales(spark, folder, ["selling_price", "quantity", "channel"]), "channel")


@query(
    "category_share",
    f"""with {_S} select category, round({_BY} / (select {_BY} from sales) * 100, 6) as value
    from sales where category is not null group by category""",
)
def category_share(spark, folder):
    out = metrics.share_by(views.sales(spark, folder, ["selling_price", "quantity", "category"]), "category")
    return out.withColumn("value", F.round("value", 6))


@query(
    "category_share_monthly",
    f"""with {_S}, m as (select *, cast(date_trunc('month', order_date) as date) as period from sales)
    select period, category, round({_BY} / (select {_BY} from m t where t.period = m.period) * 100, 6) as value
    from m where category is not null group by period, category""",
)
def category_share_monthly(spark, folder):
    sales = views.sales(spark, folder).withColumn("period", period_start(F.col("order_date"), "month"))
    return metrics.share_by(sales, "category", ["period"]).withColumn("value", F.round("value", 6))


def _top(column: str) -> str:
    return f"with {_S} select {column} as label, {_BY} as value from sales where {column} is not null group by 1 order by 2 desc, 1 limit 1"


@query("top_category", _top("category"))
def top_category(spark, folder):
    return metrics.top_by(views.sales(spark, folder, ["selling_price", "quantity", "category"]), "category")


@query("top_product", _top("product"))
def top_product(spark, folder):
    return metrics.top_by(views.sales(spark, folder, ["selling_price", "quantity", "product"]), "product")


@query(
    "top_product_monthly",
    f"""with {_S} select cast(date_trunc('month', order_date) as date) as period, product as label, {_BY} as value from sales
    group by 1, 2 qualify row_number() over (partition by period order by value desc, label) = 1""",
)
def top_product_monthly(spark, folder):
    sales = views.sales(spark, folder).withColumn("period", period_start(F.col("order_date"), "month"))
    return metrics.top_by(sales, "product", ["period"])


# ---------------------------------------------------------------- shapes

_SHAPE_NUMBERS = ("value", "user_id")
_SHAPE_COUNTS = ("event_type", "user_id")


def _shapes_sql() -> str:
    parts = []
    for c in _SHAPE_NUMBERS:
        exact = f"cast({c} as decimal(18,2))"
        parts += [
            f"select 'sum {c}' as kpi, round(cast(sum({exact}) as double), 4) as value from events",
            f"select 'mean {c}', {ctes.rounded(f'cast(sum({exact}) as double) / count({c})', 4)} from events",
            f"select 'min {c}', cast(min({c}) as double) from events",
            f"select 'max {c}', cast(max({c}) as double) from events",
        ]
    for c in _SHAPE_COUNTS:
        parts += [
            f"select 'count {c}', cast(count({c}) as double) from events",
            f"select 'nunique {c}', cast(count(distinct {c}) as double) from events",
        ]
    return " union all ".join(parts)


@query("kpi_shapes", _shapes_sql())
def kpi_shapes(spark, folder):
    events = table(spark, folder, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return metrics.column_shapes(events, _SHAPE_NUMBERS, _SHAPE_COUNTS)


_RATED = "select *, 1 + user_id % 5 as rating, cast(date_trunc('week', ts) as date) as period from events"


def _rated(spark, folder):
    return table(spark, folder, "events").withColumns(
        {"rating": F.expr("1 + user_id % 5"), "period": period_start(F.col("ts"), "week")}
    )


@query(
    "pct_where",
    f"""select period, count(*) as rows, count_if(rating >= 4) as matching,
    {ctes.rounded('100.0::double * count_if(rating >= 4) / count(*)', 2)} as percent from ({_RATED}) group by period""",
)
def pct_where(spark, folder):
    return metrics.share_where(_rated(spark, folder), F.col("rating") >= 4, ["period"])


@query(
    "mode_label",
    f"""select period, event_type as label, count(*) as count from ({_RATED}) group by 1, 2
    qualify row_number() over (partition by period order by count(*) desc, event_type) = 1""",
)
def mode_label(spark, folder):
    return metrics.mode_label(_rated(spark, folder), "event_type", ["period"])


_CUSTOMERS = ["selling_price", "quantity", "customer_id", "category"]


@query(
    "per_entity_ratio",
    f"""with {_S} select category, count(*) as rows, count(distinct customer_id) as entities,
    {ctes.rounded('count(*) / count(distinct customer_id)', 4)} as rows_per_entity,
    {ctes.rounded('cast(sum(selling_price * quantity) as double) / count(distinct customer_id)', 4)} as amount_per_entity
    from sales group by category""",
)
def per_entity_ratio(spark, folder):
    return metrics.per_entity(views.sales(spark, folder, _CUSTOMERS), "customer_id", _amount(), ["category"])


@query(
    "customer_lifetime_value",
    f"""with {_S}, c as (select customer_id, sum(selling_price * quantity) as s from sales group by 1)
    select count(*) as entities, {ctes.rounded('cast(sum(s) as double) / count(*)', 4)} as mean_sum from c""",
)
def customer_lifetime_value(spark, folder):
    return metrics.mean_of_sums(views.sales(spark, folder, _CUSTOMERS), "customer_id", _amount())


@query(
    "high_value_share",
    f"""with {_S} select category, count(*) as rows, count_if(selling_price * quantity > 40000) as matching,
    {ctes.rounded('100.0::double * count_if(selling_price * quantity > 40000) / count(*)', 2)} as percent from sales group by category""",
)
def high_value_share(spark, folder):
    return metrics.share_where(views.sales(spark, folder, _CUSTOMERS), _amount() > 40000, ["category"])


# ---------------------------------------------------------------- formulas

_ROWS = """rows as (select o_orderkey as order_id, o_custkey as customer_id, cast(o_totalprice as decimal(18,2)) as revenue,
    cast(o_totalprice as decimal(18,2)) * 0.5 as cost, o_orderkey % 50 as quantity, o_orderstatus as status,
    case when o_orderkey % 4 = 0 then o_custkey end as conversions, o_orderkey as visitors from orders)"""


def _rows(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as order_id",
        "o_custkey as customer_id",
        "cast(o_totalprice as decimal(18,2)) as revenue",
        "cast(o_totalprice as decimal(18,2)) * 0.5 as cost",
        "o_orderkey % 50 as quantity",
        "o_orderstatus as status",
        "case when o_orderkey % 4 = 0 then o_custkey end as conversions",
        "o_orderkey as visitors",
    )


FORMULAS = {
    "per order": 'SUM("revenue") / count("order_id")',
    "margin": '((sum("revenue") - sum("cost")) / sum("revenue")) * 100',
    "customers": "nunique('customer_id') + 0",
    "spread": "max([quantity]) - min([quantity])",
    "zero": 'sum("revenue") / (count("order_id") - count("order_id"))',
    "unknown": 'sum("profit")',
    "text": 'avg("status")',
    "call": '__import__("status")',
    "middle": 'median("quantity") + median(["cost"])',
}


@query(
    "custom_metric",
    f"""with {_ROWS} select 'per order' as kpi, round(cast(sum(revenue) as double) / count(order_id), 4) as value, true as success,
    null as error from rows
    union all select 'margin', round((cast(sum(revenue) as double) - cast(sum(cost) as double)) / cast(sum(revenue) as double) * 100, 4), true, null from rows
    union all select 'customers', cast(count(distinct customer_id) as double), true, null from rows
    union all select 'spread', cast(max(quantity) - min(quantity) as double), true, null from rows
    union all select 'middle', round(median(quantity) + median(cast(cost as double)), 4), true, null from rows
    union all select 'zero', null, false, '{metrics.INVALID_VALUE}'
    union all select 'unknown', null, false, 'Columns not found: profit'
    union all select 'text', null, false, 'avg() needs a numeric column, status is none'
    union all select 'call', null, false, 'Only quoted columns, numbers, + - * / and the listed aggregates may be used'""",
)
def custom_metric(spark, folder):
    return metrics.custom_metrics(_rows(spark, folder), FORMULAS).withColumn("value", F.round("value", 4))


@query(
    "metric_status",
    f"""with {_ROWS}, g as (select status, sum(revenue) as r, count_if(quantity = 0 and status = 'F') as z from rows group by status)
    select status, 'ratio' as kpi, case when z <> 0 then round(cast(r as double) / z, 4) end as value, z <> 0 as success,
    case when z = 0 then '{metrics.INVALID_VALUE}' end as error from g""",
)
def metric_status(spark, folder):
    grouped = _rows(spark, folder).groupBy("status").agg(
        F.sum("revenue").cast("double").alias("r"), F.count_if((F.col("quantity") == 0) & (F.col("status") == "F")).alias("z")
    )
    ratio = grouped.select("status", F.lit("ratio").alias("kpi"), F.round(F.try_divide("r", F.col("z").cast("double")), 4).alias("value"))
    return metrics.metric_status(ratio)


@query(
    "metric_templates",
    f"""with {_ROWS} select 'Average Order Value' as kpi, round(cast(sum(revenue) as double) / count(order_id), 4) as value from rows
    union all select 'Conversion Rate', round(cast(count(conversions) as double) / count(visitors) * 100, 4) from rows
    union all select 'Average Revenue Per Customer', round(cast(sum(revenue) as double) / count(customer_id), 4) from rows
    union all select 'Profit Margin', round((cast(sum(revenue) as double) - cast(sum(cost) as double)) / cast(sum(revenue) as double) * 100, 4) from rows
    union all select 'Average Transaction Size', round(cast(sum(quantity) as double) / count(order_id), 4) from rows""",
)
def metric_templates(spark, folder):
    out = metrics.custom_metrics(_rows(spark, folder), metrics.TEMPLATES)
    return out.select("kpi", F.round("value", 4).alias("value"))


@query(
    "vector_result",
    f"""with {_ROWS} select order_id, round(cast(revenue as double) - cast(cost as double) * 2 / nullif(quantity, 0), 4) as value
    from rows""",
)
def vector_result(spark, folder):
    out = metrics.vector_metric(_rows(spark, folder), '"revenue" - "cost" * 2 / "quantity"', "order_id")
    return out.withColumn("value", F.round("value", 4))


# ---------------------------------------------------------------- the whole pack

_NO = "null::varchar"


def pack_sql(by: list[str] = (), source: str = "sales") -> str:
    """Body of the twelve metrics as long rows."""
    keys = "".join(f"{b}, " for b in by)
    same = " and ".join(f"t.{b} is not distinct from s.{b}" for b in by) or "true"
    part = "partition by " + ", ".join(by) if by else ""
    named = "dimension_value" if "category" in by else "category"
    return f"""select {keys}kpi, {_NO} as {named}, value, {_NO} as label, true as success, {_NO} as error
      from ({ctes.scalars(by, source)})
    union all select {keys}'Sales per Category', category, {_BY}, null, true, null from {source}
      where category is not null group by {keys}category
    union all select {keys}'Sales per Channel', channel, {_BY}, null, true, null from {source}
      where channel is not null group by {keys}channel
    union all select {keys}'Category Contribution Percentage', category,
      {_BY} / (select {_BY} from {source} t where {same}) * 100, null, true, null from {source} s
      where category is not null group by {keys}category
    union all select {keys}'Top-Selling Category', null, null, category, true, null from (
      select {keys}category, {_BY} as v from {source} where category is not null group by {keys}category
      qualify row_number() over ({part} order by v desc, category) = 1)
    union all select {keys}'Top-Selling Product', null, null, product, true, null from (
      select {keys}product, {_BY} as v from {source} where product is not null group by {keys}product
      qualify row_number() over ({part} order by v desc, product) = 1)"""


@query("kpi_pack", f"with {_S}, p as ({pack_sql()}) select * replace (round(value, 6) as value) from p")
def kpi_pack(spark, folder):
    return metrics.kpi_pack(views.sales(spark, folder)).withColumn("value", F.round("value", 6))


@query(
    "kpi_pack_monthly",
    f"with {_S}, dated as (select *, cast(date_trunc('month', order_date) as date) as period from sales), "
    f"p as ({pack_sql(['period'], 'dated')}) select * replace (round(value, 6) as value) from p",
)
def kpi_pack_monthly(spark, folder):
    sales = views.sales(spark, folder).withColumn("period", period_start(F.col("order_date"), "month"))
    return metrics.kpi_pack(sales, ["period"]).withColumn("value", F.round("value", 6))


def _keyed(key):
    return f"with {_S}, p as ({pack_sql([key])}) select * replace (round(value, 6) as value) from p"


@query("kpi_pack_by_category", _keyed("category"))
def kpi_pack_by_category(spark, folder):
    """A dimension as the key: its value column then has another name."""
    return metrics.kpi_pack(views.sales(spark, folder), ["category"]).withColumn("value", F.round("value", 6))


_GROUPED = "('Sales per Category', 'Sales per Channel', 'Category Contribution Percentage', 'Top-Selling Category', 'Top-Selling Product')"


@query("category_panel_by_channel", f"select channel, kpi, category, value, label from ({_keyed('channel')}) where kpi in {_GROUPED}")
def category_panel_by_channel(spark, folder):
    return metrics.category_panel(views.sales(spark, folder), ["channel"]).withColumn("value", F.round("value", 6))


_MISSING = [m.name for m in metrics.METRICS if m.name not in metrics.applicable(["order_id", "quantity"])]


@query(
    "kpi_pack_partial",
    f"""with {_S}, g as (select o_orderpriority as channel, count(distinct l_orderkey) as orders, sum(l_quantity) as units
      from lineitem join orders on l_orderkey = o_orderkey group by 1)
    select channel as segment, 'Total Orders' as kpi, {_NO} as category, cast(orders as double) as value, {_NO} as label, true as success, {_NO} as error from g
    union all select channel, 'Total Units Sold', null, cast(units as double), null, true, null from g
    union all select channel, unnest([{', '.join(f"'{n}'" for n in _MISSING)}]), null, null, null, false, '{metrics.NOT_CALCULABLE}' from g""",
)
def kpi_pack_partial(spark, folder):
    """Metrics the table cannot give are failed rows of every group."""
    sales = views.sales(spark, folder, ["order_id", "quantity", "channel"]).withColumnRenamed("channel", "segment")
    return metrics.kpi_pack(sales, ["segment"])
