"""Business metrics: a registry, one-pass evaluation, and user formulas."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.numbers import rounded
from tillscope.operators.lookup import join_measured
from tillscope.operators.profile import is_numeric
from tillscope.operators.quantiles import measured_quantiles
from tillscope.session import durable

# Role columns of the sales view.
PRICE, QUANTITY, ORDER = "selling_price", "quantity", "order_id"
DISCOUNT, CATEGORY, CHANNEL, PRODUCT = "discount_percent", "category", "channel", "product"

# What a failed metric says.
NOT_CALCULABLE = "Not calculable (missing dependencies or columns)"
INVALID_VALUE = "Calculation resulted in an invalid value"


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str
    roles: tuple[str, ...]
    description: str
    needs: tuple[str, ...] = field(default=())


# The metric pack by name, kind, roles and dependencies.
METRICS = (
    Metric("Total Sales Amount", "numeric", (PRICE, QUANTITY), "Money from all sales"),
    Metric("Total Orders", "numeric", (ORDER,), "Distinct orders"),
    Metric("Total Units Sold", "numeric", (QUANTITY,), "Items sold"),
    Metric(
        "Average Order Value", "ratio", (PRICE, QUANTITY, ORDER), "Sales per order",
        ("Total Sales Amount", "Total Orders"),
    ),
    Metric("Average Selling Price per Item", "numeric", (PRICE,), "Mean selling price"),
    Metric("Average Discount Percentage", "percentage", (DISCOUNT,), "Mean discount"),
    Metric("Discount Utilization Rate", "percentage", (DISCOUNT, ORDER), "Share of orders with a discount"),
    Metric("Sales per Category", "categorical", (CATEGORY, PRICE, QUANTITY), "Sales by category", ("Total Sales Amount",)),
    Metric("Sales per Channel", "categorical", (CHANNEL, PRICE, QUANTITY), "Sales by channel", ("Total Sales Amount",)),
    Metric(
        "Category Contribution Percentage", "percentage", (CATEGORY, PRICE, QUANTITY), "Category share of sales",
        ("Sales per Category", "Total Sales Amount"),
    ),
    Metric("Top-Selling Category", "categorical", (CATEGORY, PRICE, QUANTITY), "Category with most sales", ("Sales per Category",)),
    Metric("Top-Selling Product", "categorical", (PRODUCT, PRICE, QUANTITY), "Product with most sales", ("Total Sales Amount",)),
)
SCALARS = tuple(m.name for m in METRICS[:7])


def applicable(columns: Sequence[str], metrics: Sequence[Metric] = METRICS) -> list[str]:
    """Metrics whose roles are all present."""
    return [m.name for m in metrics if set(m.roles) <= set(columns)]


# ---------------------------------------------------------------- metrics of the caller


@dataclass(frozen=True)
class State:
    """A partial aggregate that merges: of the rows of an order, then of orders, then read as a number.

    Values are SQL expressions, so that metrics can be stated before there is a session.
    """

    of_rows: Callable[[], Column]
    merged: Callable[[str], Column]
    read: Callable[[Column], Column] = lambda total: total.cast("double")


def summed(value: str) -> State:
    return State(lambda: F.sum(F.expr(value)), F.sum)


def counted(value: str) -> State:
    """Rows where the value is not null."""
    return State(lambda: F.count(F.expr(value)), F.sum)


def smallest(value: str) -> State:
    return State(lambda: F.min(F.expr(value)), F.min)


def largest(value: str) -> State:
    return State(lambda: F.max(F.expr(value)), F.max)


def distinct_estimate(value: str) -> State:
    """Distinct values by a sketch of fixed size, within about two percent."""
    return State(lambda: F.hll_sketch_agg(F.expr(value)), F.hll_union_agg, lambda sketch: F.hll_sketch_estimate(sketch).cast("double"))


def quantile_estimate(value: str, share: float) -> State:
    """A quantile by a sketch of bounded size, within about one percent of the ranks."""
    sketch = lambda: F.kll_sketch_agg_double(F.expr(value).cast("double"))
    return State(sketch, F.kll_merge_agg_double, lambda total: F.kll_sketch_get_quantile_double(total, F.lit(share)))


@dataclass(frozen=True)
class OwnMetric:
    """A metric of the caller: named partial states over the columns of a sale, and what they make together.

    States join the one aggregation by order that the built-in metrics come from, so a
    metric costs no scan of its own, in the pack and in the panel and what is made of it.
    """

    name: str
    states: Mapping[str, State]
    value: Callable[[Mapping[str, Column]], Column]
    roles: tuple[str, ...] = ()


def _own_states(own: Sequence[OwnMetric], columns: Sequence[str]) -> dict[str, State]:
    taken = {*(m.name for m in METRICS)}
    for m in own:
        if m.name in taken:
            raise ValueError(f"a metric named {m.name!r} exists already")
        taken.add(m.name)
    return {f"_own{i}_{name}": state for i, m in enumerate(own) if set(m.roles) <= set(columns) for name, state in m.states.items()}


def _own_values(own: Sequence[OwnMetric], columns: Sequence[str]) -> list[Column]:
    known = [(i, m) for i, m in enumerate(own) if set(m.roles) <= set(columns)]
    read = lambda i, m: {name: state.read(F.col(f"_own{i}_{name}")) for name, state in m.states.items()}
    return [rounded(m.value(read(i, m)).cast("double"), 4).alias(m.name) for i, m in known]


# ---------------------------------------------------------------- scalar metrics


def _sums(sales: DataFrame) -> list[Column]:
    """The sums every scalar metric is made of; roles the table lacks sum to nothing."""
    have = set(sales.columns)

    def role(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("decimal(12,2)")

    return [
        F.sum(role(PRICE) * role(QUANTITY)).alias("_amount"),
        F.sum(role(QUANTITY)).alias("_units"),
        F.sum(role(PRICE)).alias("_price"),
        F.count(role(PRICE)).alias("_priced"),
        F.sum(role(DISCOUNT)).alias("_discount"),
        F.count(role(DISCOUNT)).alias("_discounts"),
        F.max(F.when(role(DISCOUNT) > 0, 1)).alias("_discounted"),
    ]


def _with_order(sales: DataFrame) -> DataFrame:
    return sales if ORDER in sales.columns else sales.withColumn(ORDER, F.lit(None).cast("long"))


def order_grain(sales: DataFrame, by: Sequence[str] = (), own: Sequence[OwnMetric] = ()) -> DataFrame:
    """Partial sums per order, those of the caller's metrics among them.

    Both distinct-order metrics become plain counts over this table, so the
    pack needs one narrow shuffle instead of an expanded row per distinct count.
    """
    states = _own_states(own, sales.columns)
    return _with_order(sales).groupBy(*by, ORDER).agg(*_sums(sales), *[s.of_rows().alias(n) for n, s in states.items()])


def _totals(states: Mapping[str, State] | None = None) -> list[Column]:
    """The same sums over orders, and the two counts of orders."""
    return [
        *[s.merged(n).alias(n) for n, s in (states or {}).items()],
        *[F.sum(c).alias(c) for c in ("_amount", "_units", "_price", "_priced", "_discount", "_discounts")],
        F.count(ORDER).alias("_orders"),
        F.count(F.when(F.col("_discounted") == 1, F.col(ORDER))).alias("_discounted_orders"),
    ]


def _scalar_columns(columns: Sequence[str]) -> list[Column]:
    """The scalar metrics these roles allow, from the totals, rounded to four places."""
    number = lambda name: F.col(name).cast("double")
    total = F.coalesce(number("_amount"), F.lit(0.0))
    values = {
        "Total Sales Amount": total,
        "Total Orders": number("_orders"),
        "Total Units Sold": F.coalesce(number("_units"), F.lit(0.0)),
        "Average Order Value": F.try_divide(total, number("_orders")),
        "Average Selling Price per Item": F.try_divide(number("_price"), number("_priced")),
        "Average Discount Percentage": F.try_divide(number("_discount"), number("_discounts")),
        "Discount Utilization Rate": F.try_divide(number("_discounted_orders"), number("_orders")) * 100,
    }
    return [rounded(values[n], 4).alias(n) for n in SCALARS if n in applicable(columns)]


def scalar_metrics(sales: DataFrame, by: Sequence[str] = (), own: Sequence[OwnMetric] = ()) -> DataFrame:
    """Wide: one column per scalar metric, one row per ``by``."""
    totals = order_grain(sales, by, own).groupBy(*by).agg(*_totals(_own_states(own, sales.columns)))
    return totals.select(*by, *_scalar_columns(sales.columns), *_own_values(own, sales.columns))


def to_long(wide: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long rows (by, kpi, value)."""
    return wide.unpivot([F.col(c) for c in by], [F.col(f"`{n}`") for n in names], "kpi", "value")


def metric_status(long: DataFrame) -> DataFrame:
    """Add success and error; NaN and infinite values fail."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == F.lit(float("inf")))
    return long.withColumns(
        {
            "value": F.when(~bad, F.col("value")),
            "success": ~bad,
            "error": F.when(bad, INVALID_VALUE),
        }
    )


def scalar_panel(sales: DataFrame, by: Sequence[str] = (), own: Sequence[OwnMetric] = ()) -> DataFrame:
    """Long scalar metrics per ``by`` with their status."""
    names = [n for n in SCALARS if n in applicable(sales.columns)] + [m.name for m in own if set(m.roles) <= set(sales.columns)]
    return metric_status(to_long(scalar_metrics(sales, by, own), by, names))


# ---------------------------------------------------------------- categorical metrics


def sales_by(sales: DataFrame, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """Sales per value of a dimension; rows without one are left out."""
    known = sales.where(F.col(dimension).isNotNull())
    return known.groupBy(*by, F.col(dimension).alias("category")).agg(
        F.coalesce(F.sum(F.col(PRICE) * F.col(QUANTITY)), F.lit(0)).cast("double").alias("value")
    )


def share_by(sales: DataFrame, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent of all sales per value of a dimension; the total keeps rows without one."""
    amount = F.sum(F.col(PRICE) * F.col(QUANTITY))
    plain = lambda total: F.coalesce(total, F.lit(0)).cast("double")
    share = lambda total: (F.try_divide(F.col("value"), total) * 100).alias("value")
    if not by:
        total = sales.agg(plain(amount).alias("_total")).scalar()
        return sales_by(sales, dimension).select("category", share(total))
    # One aggregate; the totals are sums over its groups, those without a value of the dimension or of a key included.
    parts = sales.groupBy(*by, F.col(dimension).alias("category")).agg(amount.alias("_amount"))
    whole = parts.withColumn("_total", plain(F.sum("_amount").over(Window.partitionBy(*by)))).withColumn("value", plain(F.col("_amount")))
    return whole.where(F.col("category").isNotNull()).select(*by, "category", share(F.col("_total")))


def top_by(sales: DataFrame, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """The dimension value with most sales, the first in order on ties."""
    parts = sales_by(sales, dimension, by)
    if not by:
        return parts.orderBy(F.desc("value"), "category").limit(1).select(F.col("category").alias("label"), "value")
    order = Window.partitionBy(*by).orderBy(F.desc("value"), "category")
    best = parts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1)
    return best.select(*by, F.col("category").alias("label"), "value")


def _dimensions(columns: Sequence[str]) -> list[str]:
    names = applicable(columns)
    wanted = ((CATEGORY, "Sales per Category"), (CHANNEL, "Sales per Channel"), (PRODUCT, "Top-Selling Product"))
    return [d for d, kpi in wanted if kpi in names]


def _categorical(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """All categorical metrics from sales per dimension value (by, _level, _name, value, _total)."""
    column = dimension_column(by)
    none = lambda kind: F.lit(None).cast(kind)
    sums = parts.where(F.col("_level").isin(CATEGORY, CHANNEL)).select(
        *by,
        F.when(F.col("_level") == CATEGORY, "Sales per Category").otherwise("Sales per Channel").alias("kpi"),
        F.col("_name").alias(column),
        "value",
        none("string").alias("label"),
    )
    shares = parts.where(F.col("_level") == CATEGORY).select(
        *by,
        F.lit("Category Contribution Percentage").alias("kpi"),
        F.col("_name").alias(column),
        (F.try_divide(F.col("value"), F.col("_total")) * 100).alias("value"),
        none("string").alias("label"),
    )
    order = Window.partitionBy(*by, "_level").orderBy(F.desc("value"), "_name")
    best = parts.where(F.col("_level").isin(CATEGORY, PRODUCT)).withColumn("_r", F.row_number().over(order))
    tops = best.where(F.col("_r") == 1).select(
        *by,
        F.when(F.col("_level") == CATEGORY, "Top-Selling Category").otherwise("Top-Selling Product").alias("kpi"),
        none("string").alias(column),
        none("double").alias("value"),
        F.col("_name").alias("label"),
    )
    return sums.unionByName(shares).unionByName(tops)


def dimension_column(by: Sequence[str]) -> str:
    """Name of the column of dimension values: ``category``, unless that is a key of the panel."""
    return "dimension_value" if "category" in by else "category"


def category_panel(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All categorical metrics from one scan: (by, kpi, category, value, label).

    A dimension may also be a key of the panel: it is grouped by under a private
    name, so that being a key and being a level of the grouping sets stay apart.
    """
    dims = _dimensions(sales.columns)
    own = {d: f"_d{i}" for i, d in enumerate(dims)}
    sales = sales.select(*by, (F.col(PRICE) * F.col(QUANTITY)).alias("_sales"), *[F.col(d).alias(own[d]) for d in dims])
    # The grouping sets are partially aggregated before the single shuffle, and
    # kept, because the metrics below read them several times.
    sets = [[F.col(c) for c in (*by, own[d])] for d in dims] + [[F.col(c) for c in by]]
    cells = sales.groupingSets(sets, *by, *own.values()).agg(
        F.coalesce(F.sum("_sales"), F.lit(0)).cast("double").alias("value"),
        *[F.grouping(own[d]).alias(f"_g{own[d]}") for d in dims],
    )
    level = F.coalesce(*[F.when(F.col(f"_g{own[d]}") == 0, d) for d in dims], F.lit("total"))
    name = F.coalesce(*[F.when(F.col(f"_g{own[d]}") == 0, F.col(own[d])) for d in dims])
    cells = durable(cells.select(*by, level.alias("_level"), name.alias("_name"), "value"))
    parts = cells.where((F.col("_level") != "total") & F.col("_name").isNotNull())
    totals = cells.where(F.col("_level") == "total").select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("value").alias("_total"))
    if by:
        same = F.lit(True)
        for key in by:  # a null key is a group of its own and has its own total
            same = same & F.col(key).eqNullSafe(F.col(f"_t_{key}"))
        parts = parts.join(totals, same, "left").drop(*[f"_t_{c}" for c in by])
    else:
        parts = parts.withColumn("_total", totals.scalar())
    return _categorical(parts, by)


def kpi_pack(sales: DataFrame, by: Sequence[str] = (), own: Sequence[OwnMetric] = ()) -> DataFrame:
    """Every metric, the caller's own among them, as (by, kpi, category, value, label, success, error).

    A metric whose roles or dependencies the table lacks is one failed row per group.

    Two scans of the columns in use, one for the scalars and one for all the
    categories: measured on skewed data, one scan with a grouping set per order
    as well takes a third longer than both.
    """
    none = F.lit(None).cast("string")
    known = applicable(sales.columns)
    order = ("kpi", dimension_column(by), "value", "label", "success", "error")
    pack = None
    if any(n in known for n in SCALARS) or any(set(m.roles) <= set(sales.columns) for m in own):
        pack = scalar_panel(sales, by, own).withColumns({dimension_column(by): none, "label": none}).select(*by, *order)
    missing = [m.name for m in METRICS if m.name not in known] + [m.name for m in own if not set(m.roles) <= set(sales.columns)]
    if missing:
        groups = sales.groupBy(*by).agg(F.lit(1).alias("_one")) if by else sales.sparkSession.range(1)
        failed = groups.select(*by, F.explode(F.array(*[F.lit(n) for n in missing])).alias("kpi")).withColumns(
            {order[1]: none, "value": F.lit(None).cast("double"), "label": none, "success": F.lit(False), "error": F.lit(NOT_CALCULABLE)}
        )
        pack = failed.select(*by, *order) if pack is None else pack.unionByName(failed)
    if not _dimensions(sales.columns):
        return pack
    grouped = category_panel(sales, by).withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    return grouped.select(*by, *order) if pack is None else pack.unionByName(grouped)


# ---------------------------------------------------------------- generic shapes


def column_shapes(df: DataFrame, numeric: Sequence[str], countable: Sequence[str]) -> DataFrame:
    """Independent metrics by rule: sum, mean, min, max of numbers; count and distinct of the rest."""
    aggregates = []
    for column in numeric:
        number = F.col(f"`{column}`").cast("double")
        aggregates += [
            F.coalesce(F.sum(F.col(f"`{column}`")), F.lit(0)).cast("double").alias(f"sum {column}"),
            F.try_divide(F.sum(F.col(f"`{column}`")).cast("double"), F.count(number).cast("double")).alias(f"mean {column}"),
            F.min(number).alias(f"min {column}"),
            F.max(number).alias(f"max {column}"),
        ]
    aggregates += [F.count(F.col(f"`{c}`")).cast("double").alias(f"count {c}") for c in countable]
    wide = df.agg(*aggregates)
    long = to_long(wide, [], wide.columns)
    for column in countable:
        # One distinct count per column shuffles only that column, already combined.
        values = df.where(F.col(f"`{column}`").isNotNull()).groupBy(f"`{column}`").agg(F.lit(1).alias("one"))
        long = long.unionByName(
            values.agg(F.count("one").cast("double").alias("value")).select(F.lit(f"nunique {column}").alias("kpi"), "value")
        )
    return long.withColumn("value", rounded(F.col("value"), 4))


def share_where(df: DataFrame, condition: Column, by: Sequence[str | Column] = ()) -> DataFrame:
    """Rows meeting a condition: count and percent per group."""
    hits, rows = F.count_if(condition), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        rows.alias("rows"),
        hits.alias("matching"),
        rounded(F.try_divide(hits.cast("double") * 100, rows.cast("double")), 2).alias("percent"),
    )


def mode_label(df: DataFrame, column: str, by: Sequence[str | Column] = ()) -> DataFrame:
    """The most frequent value per group, the smallest on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("label")).agg(
        F.count(F.lit(1)).alias("count")
    )
    names = [c for c in counts.columns if c not in ("label", "count")]
    order = Window.partitionBy(*names).orderBy(F.desc("count"), "label")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def per_entity(df: DataFrame, entity: str, amount: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows and amount per distinct entity of each group."""
    grain = df.groupBy(*by, entity).agg(F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_amount"))
    entities = F.count(entity)
    return grain.groupBy(*by).agg(
        F.sum("_rows").alias("rows"),
        entities.alias("entities"),
        rounded(F.try_divide(F.sum("_rows").cast("double"), entities.cast("double")), 4).alias("rows_per_entity"),
        rounded(F.try_divide(F.sum("_amount").cast("double"), entities.cast("double")), 4).alias("amount_per_entity"),
    )


def mean_of_sums(df: DataFrame, entity: str, amount: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sum per entity, then the mean of these sums."""
    sums = df.where(F.col(entity).isNotNull()).groupBy(*by, entity).agg(F.sum(amount).alias("_sum"))
    mean = F.try_divide(F.sum("_sum").cast("double"), F.count("_sum").cast("double"))
    return sums.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"), rounded(mean, 4).alias("mean_sum"))


# ---------------------------------------------------------------- user formulas

# The aggregate names a formula may use.
AGGREGATES = {
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "count": F.count,
    "nunique": F.count_distinct,
    "min": F.min,
    "max": F.max,
    "median": lambda column: F.max(column),  # of the group's exact median, attached to its rows before
}
ANY_TYPE = ("count", "nunique")

# Formula templates over role names.
TEMPLATES = {
    "Average Order Value": 'sum("revenue") / count("order_id")',
    "Conversion Rate": '(count("conversions") / count("visitors")) * 100',
    "Average Revenue Per Customer": 'sum("revenue") / count("customer_id")',
    "Profit Margin": '((sum("revenue") - sum("cost")) / sum("revenue")) * 100',
    "Average Transaction Size": 'sum("quantity") / count("order_id")',
}

class FormulaError(ValueError):
    """A formula that is refused before any job runs."""


def formula_column(df: DataFrame, formula: str) -> tuple[Column, bool]:
    """The formula as a Spark column, and whether it aggregates.

    Python's own grammar reads the text; only quoted column names, the listed
    aggregates, numbers and ``+ - * / ( )`` are turned into Spark columns and
    everything else is refused. Dividing by zero yields NULL.
    """
    quoted = re.sub(r"""\[\s*['"]?([^\]'"]+)['"]?\s*\]""", r'"\1"', formula)
    try:
        tree = ast.parse(quoted.strip(), mode="eval").body
    except SyntaxError as error:
        raise FormulaError("Formula validation error: not a valid expression") from error
    names = [n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    if unknown := [n for n in names if n not in df.columns]:
        raise FormulaError(f"Columns not found: {', '.join(unknown)}")
    calls = sum(isinstance(n, ast.Call) for n in ast.walk(tree))
    if not names or 0 < calls < len(names):
        raise FormulaError("Formula must use columns, either all aggregated or none")
    return _formula_node(df, tree), bool(calls)


def _formula_node(df: DataFrame, node: ast.expr) -> Column:
    match node:
        case ast.Constant(value=str(name)):
            return F.col(f"`{name}`").cast("double")
        case ast.Constant(value=(int() | float()) as number) if not isinstance(number, bool):
            return F.lit(float(number))
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_formula_node(df, inner)
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _formula_node(df, inner)
        case ast.BinOp(left=left, op=op, right=right):
            a, b = _formula_node(df, left), _formula_node(df, right)
            match op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.try_divide(a, b)
        case ast.Call(func=ast.Name(id=name), args=[ast.Constant(value=str(column))], keywords=[]):
            function = name.lower()
            if function in AGGREGATES:
                if function not in ANY_TYPE and not is_numeric(df.schema[column].dataType):
                    raise FormulaError(f"{function}() needs a numeric column, {column} is none")
                source = F.col(_median_column(column)) if function == "median" else F.col(f"`{column}`")
                return AGGREGATES[function](source).cast("double")
    raise FormulaError("Only quoted columns, numbers, + - * / and the listed aggregates may be used")


def _median_column(column: str) -> str:
    return f"_median of {column}"


def _with_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Attach the exact median of each column's group; no task holds a group. Rows with a null key get none."""
    for column in columns:
        medians, small = measured_quantiles(df, by, column, [0.5])
        if by:
            stats = medians.select(*by, F.col("q0").alias(_median_column(column)))
            df = join_measured(df, stats, by, small)
        else:
            df = df.withColumn(_median_column(column), medians.select("q0").scalar())
    return df


def custom_metrics(df: DataFrame, formulas: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """All formulas in one aggregation; refused ones are rows with their error."""
    asked = {m for f in formulas.values() for m in re.findall(r"""(?i)median\s*\(\s*(?:"|'|\[\s*['"]?)([^"'\]]+)""", f)}
    medians = [c for c in df.columns if c in asked and is_numeric(df.schema[c].dataType)]
    df = _with_medians(df, medians, by)
    accepted, refused = {}, {}
    for name, formula in formulas.items():
        try:
            column, aggregates = formula_column(df, formula)
            if not aggregates:
                raise FormulaError("Formula does not aggregate")
            accepted[name] = column.cast("double")
        except FormulaError as error:
            refused[name] = str(error)
    out = None
    if accepted:
        wide = df.groupBy(*by).agg(*[c.alias(n) for n, c in accepted.items()])
        out = metric_status(to_long(wide, by, list(accepted)))
    if refused:
        rows = F.array(*[F.struct(F.lit(n).alias("kpi"), F.lit(e).alias("error")) for n, e in refused.items()])
        groups = df.groupBy(*by).agg(F.lit(1).alias("_one")) if by else df.sparkSession.range(1)
        failed = groups.select(*by, F.inline(rows)).select(
            *by, "kpi", F.lit(None).cast("double").alias("value"), F.lit(False).alias("success"), "error"
        )
        out = failed if out is None else out.unionByName(failed)
    return out


def vector_metric(df: DataFrame, formula: str, order_by: str, rows: int | None = None) -> DataFrame:
    """A row-wise formula; with ``rows`` only its first rows in key order."""
    column, aggregates = formula_column(df, formula)
    if aggregates:
        raise FormulaError("Formula gives a single value")
    values = df.select(order_by, column.cast("double").alias("value"))
    return values if rows is None else values.orderBy(order_by).limit(rows)
