"""Report tables: cards, families, breakdowns, scaled series, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.numbers import abbreviate, finite, fixed
from tillscope.operators import panel as panels
from tillscope.operators import trend

TITLE = "Sales Analysis Report"
# List lengths of the report.
TOP_ITEMS, TOP_SUMMARY = 10, 5
# Breakdowns shown as money when the KPI's name has one of these words.
MONEY_BREAKDOWN_WORDS = ("revenue", "sales", "amount")
# Explanation families by name keyword, first hit wins; the fourth needs both lists.
FAMILIES = (
    ("Revenue & Sales", ("revenue", "sales", "income", "profit"), ()),
    ("Customer Growth", ("customer", "buyer", "client", "user"), ()),
    ("Transaction Volume", ("transaction", "order", "purchase"), ()),
    ("Average Purchase Value", ("average", "avg", "mean"), ("price", "value", "amount")),
    ("Customer Satisfaction", ("rating", "review", "satisfaction", "score"), ()),
    ("Product Performance", ("product", "item", "sku", "category"), ()),
    ("Payment Preferences", ("payment", "method", "card", "cash"), ()),
)


def display_value(kpi: Column, value: Column) -> Column:
    """Money, percent, rating or whole number by KPI name; N/A without a finite value."""
    value = finite(value)
    return (
        F.when(value.isNull(), "N/A")
        .when(panels.names_with(kpi, panels.CURRENCY_WORDS), F.concat(F.lit("$"), fixed(value, 2)))
        .when(panels.names_with(kpi, panels.PERCENT_WORDS), F.concat(fixed(value, 1, grouped=False), F.lit("%")))
        .when(panels.names_with(kpi, panels.RATING_WORDS), F.concat(fixed(value, 2, grouped=False), F.lit(" / 5.0")))
        .otherwise(fixed(value, 0))
    )


def _description(kpi: Column, value: Column, previous: Column, period: Column, previous_period: Column) -> Column:
    money = panels.names_with(kpi, panels.CURRENCY_WORDS)
    points = panels.names_with(kpi, panels.PERCENT_WORDS) | panels.names_with(kpi, panels.RATING_WORDS)
    change = panels.change_columns(value, previous, kpi)
    versus = F.concat(F.lit(" vs "), F.date_format(previous_period, "yyyy-MM"), F.lit(" (was "))
    percent = F.concat(fixed(change["change_pct"], 1, grouped=False, signed=True), F.lit("%"))
    delta = F.concat(fixed(change["change"], 2, grouped=False, signed=True), F.lit(" points"))
    arrow = F.concat(change["arrow"], F.lit(" "))
    return (
        F.when(finite(value).isNull(), "Calculation failed or no data available")
        .when(previous.isNull() | (previous == 0), F.concat(F.lit("Period: "), F.date_format(period, "yyyy-MM")))
        .when(money, F.concat(arrow, percent, versus, F.lit("$"), fixed(previous, 2), F.lit(")")))
        .when(points, F.concat(arrow, delta, versus, fixed(previous, 2, grouped=False), F.lit(")")))
        .otherwise(F.concat(arrow, percent, versus, fixed(previous, 0), F.lit(")")))
    )


def kpi_cards(panel: DataFrame, keys: Sequence[str] = (), kpis: Sequence[str] | None = None) -> DataFrame:
    """One card per series and KPI: text, comparison, sparkline and seasonal verdict."""
    if kpis is not None:
        panel = panel.where(F.col("kpi").isin(*kpis))
    pair = panels.latest_previous(panel, keys).where(F.col("period").isNotNull())
    value, previous, kpi = F.col("value"), F.col("previous"), F.col("kpi")
    known = F.when(value != 0, value)
    seasonal = panels.seasonal_columns(known, F.when(previous != 0, previous), F.month("period"))
    cards = pair.select(
        *keys,
        "kpi",
        display_value(kpi, value).alias("display"),
        _description(kpi, value, previous, F.col("period"), F.col("previous_period")).alias("description"),
        seasonal["variance"].alias("seasonal_variance"),
        seasonal["assessment"].alias("seasonal"),
    )
    sparks = panels.sparkline(panel, keys).select(
        *[F.col(k).alias(f"_s_{k}") for k in keys], F.col("kpi").alias("_s_kpi"), "sparkline"
    )
    same = F.col("kpi") == F.col("_s_kpi")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_s_{key}"))
    return cards.join(sparks, same, "left").drop("_s_kpi", *[f"_s_{k}" for k in keys])


def label_cards(categories: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One card per series and metric whose value is a name: the latest period's, and the one before if it differs."""
    periods = categories.groupBy("period").agg(F.lit(1).alias("_one")).orderBy(F.desc("period")).limit(2)
    pair = periods.agg(F.struct(F.max("period").alias("latest"), F.min("period").alias("prior")).alias("p")).scalar()
    latest, prior = pair.getField("latest"), pair.getField("prior")
    labels = categories.where(F.col("label").isNotNull() & (F.col("period") >= prior)).groupBy(*keys, "kpi").agg(
        F.max(F.when(F.col("period") == latest, F.col("label"))).alias("label"),
        F.max(F.when((F.col("period") == prior) & (prior < latest), F.col("label"))).alias("previous"),
    )
    was = F.when(F.col("label") != F.col("previous"), F.concat(F.lit(" (was "), F.col("previous"), F.lit(")"))).otherwise("")
    return labels.select(
        *keys,
        "kpi",
        F.coalesce("label", F.lit("N/A")).alias("display"),
        F.concat(F.lit("Period: "), F.date_format(latest, "yyyy-MM"), F.coalesce(was, F.lit(""))).alias("description"),
    )


def kpi_family(names: DataFrame, column: str, custom: str | None = None) -> DataFrame:
    """Explanation family per distinct name; a name no rule fits is its own family."""
    rows = names.where(~F.col(custom)) if custom else names
    lowered = F.lower("name")
    family = None
    for title, words, also in FAMILIES:
        hit = F.rlike(lowered, F.lit("|".join(words)))
        if also:
            hit = hit & F.rlike(lowered, F.lit("|".join(also)))
        family = F.when(hit, title) if family is None else family.when(hit, title)
    distinct = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return distinct.withColumn("family", family.otherwise(F.col("name")))


def family_titles(families: DataFrame) -> DataFrame:
    """One entry per family: its first name."""
    return families.groupBy("family").agg(F.min("name").alias("name"), F.sum("rows").alias("rows"))


def category_breakdown(categories: DataFrame, keys: Sequence[str] = (), top: int = TOP_ITEMS) -> DataFrame:
    """The largest categories of the latest period per KPI, formatted, with the number of all."""
    latest = categories.agg(F.max("period")).scalar()
    now = categories.where((F.col("period") == latest) & F.col("category").isNotNull() & F.col("value").isNotNull())
    group = [*keys, "kpi"]
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "category")
    totals = now.groupBy(*group).agg(F.count(F.lit(1)).alias("total_categories"))
    best = now.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    money = panels.names_with(F.col("kpi"), MONEY_BREAKDOWN_WORDS)
    return best.join(totals, group).select(
        *group,
        "rank",
        F.col("category").alias("name"),
        F.when(money, F.concat(F.lit("$"), fixed(F.col("value"), 2))).otherwise(fixed(F.col("value"), 0)).alias("display"),
        F.col("value").alias("raw_value"),
        "total_categories",
        money.alias("is_currency"),
    )


def categories_hidden(breakdown: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many categories a breakdown leaves out."""
    return breakdown.groupBy(*keys, "kpi").agg(
        F.max("total_categories").alias("total_categories"),
        F.count(F.lit(1)).alias("shown"),
        (F.max("total_categories") - F.count(F.lit(1))).alias("hidden"),
    )


def share_of_max(breakdown: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bar length: each shown value in percent of the largest."""
    whole = Window.partitionBy(*keys, "kpi")
    share = F.try_divide(F.col("raw_value"), F.max("raw_value").over(whole)) * 100
    return breakdown.select(*keys, "kpi", "rank", "name", "raw_value", share.alias("bar_pct"))


def minmax_scale(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each point between its series' least and greatest value; a flat series counts as range one."""
    whole = Window.partitionBy(*keys, "kpi")
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return trend.chart_points(panel).select(*keys, "kpi", "period", ((F.col("value") - low) / span).alias("scaled"))


def axis_labels(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return trend.chart_points(panel).select(*keys, "kpi", "period", abbreviate(F.col("value")).alias("label"))


def top_summary(parts: DataFrame, top: int = TOP_SUMMARY) -> DataFrame:
    """The largest values, each with its share, the number of values and their total."""
    whole = parts.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).alias("s")).scalar()
    best = parts.orderBy(F.desc("value"), "category").limit(top)
    total = whole.getField("total")
    return best.select(
        "category",
        "value",
        (F.try_divide(F.col("value"), total) * 100).alias("share_pct"),
        whole.getField("n").alias("total_categories"),
        total.alias("total_value"),
    )


def report_tables(
    cards: DataFrame, breakdown: DataFrame, facts: DataFrame, texts: DataFrame, shown: int | None = None
) -> DataFrame:
    """The report as one long table (section, item, position, content).

    ``texts`` has rows (source, section, position, content) with the summary,
    insights and recommendations of each source text; ``shown`` keeps the first
    entries of the last two only.
    """

    def rows(df: DataFrame, section: str | Column, item: Column, position: Column, content: Column) -> DataFrame:
        return df.select(
            (F.lit(section) if isinstance(section, str) else section).alias("section"),
            item.cast("string").alias("item"),
            position.cast("int").alias("position"),
            content.alias("content"),
        )

    colon = F.lit(": ")
    kept = texts if shown is None else texts.where((F.col("section") == "summary") | (F.col("position") <= shown))
    families = kpi_family(cards, "kpi")
    return (
        rows(cards.sparkSession.range(1), "title", F.lit("title"), F.lit(1), F.lit(TITLE))
        .unionByName(rows(cards, "kpis", F.col("kpi"), F.lit(1), F.concat("display", F.lit(" "), "description")))
        .unionByName(rows(family_titles(families), "explanations", F.col("family"), F.lit(1), F.col("name")))
        .unionByName(rows(breakdown, "breakdowns", F.col("kpi"), F.col("rank"), F.concat("name", colon, "display")))
        .unionByName(rows(facts, "trends", F.col("kpi"), F.lit(1), F.concat("trend", F.lit(" "), "change", F.lit(", "), "volatility")))
        .unionByName(rows(kept, F.col("section"), F.col("source"), F.col("position"), F.col("content")))
    )
