"""Matching over catalogues: dataset kind, names, vectors, metric coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.text import normalize_name, token_set_ratio
from tillscope.operators.lookup import attach
from tillscope.operators.metrics import METRICS, Metric
from tillscope.operators.nearest import CANDIDATE_BLOCK, QUERY_BLOCK, pruned_match

# Words that mark sales data, strongly or possibly.
STRONG_TERMS = (
    "Sales", "Invoice", "Transaction", "Order Id", "Purchase", "Customer Id", "Sale Amount", "Order Number",
    "Payment", "Receipt",
)
AMBIGUOUS_TERMS = (
    "Revenue", "Profit", "Roi", "Spend", "Cost", "Price", "Amount", "Quantity", "Units", "Customer", "Product",
)
# Names of a sales column, in order of preference, and the match threshold.
SALES_SYNONYMS = (
    "Sales", "Revenue", "Turnover", "Total Amount", "Amount", "Order Value", "Payment", "Price", "Invoice",
    "Purchase Value",
)
SALES_THRESHOLD = 80
MATCH_THRESHOLD = 75
COSINE_THRESHOLD = 0.8
# Fixed value: below this share of calculable metrics, supplements are added.
LOW_MATCH_RATE = 0.3


def normalize_names(catalogue: DataFrame, table: str = "table", column: str = "column") -> DataFrame:
    """Normalised column names, with how many columns of a table share one."""
    named = catalogue.select(table, column, normalize_name(F.col(column)).alias("normalized"))
    # A table has as many rows here as it has columns.
    alike = Window.partitionBy(table, "normalized")
    return named.withColumn("sharing", F.count(F.lit(1)).over(alike))


def _mentions(name: Column, terms: Sequence[str]) -> Column:
    return F.rlike(name, F.lit("|".join(terms)))


def classify_datasets(catalogue: DataFrame, dataset: str = "table", column: str = "column") -> DataFrame:
    """Whether each dataset is about sales, from its column names.

    Strong terms in at least half of the columns, or any strong term when the
    names are otherwise inconclusive.
    """
    name = normalize_name(F.col(column))
    marked = catalogue.select(
        F.col(dataset).alias("dataset"),
        name.alias("name"),
        "ordinal",
        _mentions(name, STRONG_TERMS).alias("strong"),
        _mentions(name, AMBIGUOUS_TERMS).alias("ambiguous"),
    )
    facts = marked.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("strong").alias("strong"),
        F.count_if("ambiguous").alias("ambiguous"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("strong"), F.struct("ordinal", "name")))),
                lambda r: r.getField("name"),
            ),
            ", ",
        ).alias("matched"),
    )
    half = F.col("strong") >= F.col("columns") / 2
    nothing = (F.col("strong") == 0) & (F.col("ambiguous") == 0)
    return facts.select(
        "dataset",
        "columns",
        "strong",
        "ambiguous",
        F.when(half, True).when(nothing, False).otherwise(F.col("strong") > 0).alias("is_sales"),
        F.when(half, "strong terms in half of the columns")
        .when(nothing, "no sales terms")
        .otherwise(F.concat(F.col("strong"), F.lit(" strong term(s)")))
        .alias("reason"),
        "matched",
    )


def fuzzy_match(
    names: DataFrame, column: str, targets: Sequence[str], threshold: float = MATCH_THRESHOLD
) -> DataFrame:
    """Best target for each distinct name by word-set similarity; the first target on ties.

    ``targets`` is a short fixed list, scored inside the row, so no pairs are
    ever produced. Names are made distinct first.
    """
    distinct = names.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    scored = F.array(
        *[
            F.struct(token_set_ratio(F.col("name"), F.lit(t)).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("target"))
            for i, t in enumerate(targets)
        ]
    )
    best = distinct.withColumn("best", F.array_max(scored))
    score = F.col("best.score")
    return best.select(
        "name",
        "rows",
        F.when(score >= threshold, F.col("best.target")).alias("match"),
        score.alias("score"),
    )


def best_columns(
    catalogue: DataFrame,
    targets: Sequence[str],
    threshold: float = MATCH_THRESHOLD,
    dataset: str = "table",
    column: str = "column",
) -> DataFrame:
    """For each dataset and target the best column; the first column on ties.

    Each distinct name is scored once; one aggregate per target then keeps a
    single best candidate per task.
    """
    named = catalogue.withColumn("_name", normalize_name(F.col(column)))
    scores = F.array(*[token_set_ratio(F.lit(t), F.col("_name")) for t in targets])
    scored = named.where(F.col("_name").isNotNull()).select("_name").distinct().withColumn("_scores", scores)
    named = attach(named, scored, ["_name"])
    aggregates = []
    for i in range(len(targets)):
        candidate = F.struct(
            F.col("_scores")[i].alias("score"), (-F.col("ordinal")).alias("order"), F.col(column).alias("column")
        )
        aggregates.append(F.max(candidate).alias(f"_t{i}"))
    wide = named.groupBy(F.col(dataset).alias("dataset")).agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(t).alias("target"),
                F.when(F.col(f"_t{i}.score") >= threshold, F.col(f"_t{i}.column")).alias("column"),
                F.col(f"_t{i}.score").alias("score"),
            )
            for i, t in enumerate(targets)
        ]
    )
    return wide.select("dataset", F.inline(rows))


def find_sales_column(catalogue: DataFrame, dataset: str = "table", column: str = "column") -> DataFrame:
    """The column of each dataset that best fits a synonym of sales, if any fits well."""
    fits = best_columns(catalogue, SALES_SYNONYMS, SALES_THRESHOLD, dataset, column)
    good = F.col("column").isNotNull()
    best = F.max(F.when(good, F.struct("score", (-F.col("position")).alias("order"), "column", "target")))
    return (
        fits.groupBy("dataset")
        .agg(best.alias("best"))
        .select("dataset", "best.column", F.col("best.target").alias("synonym"), "best.score")
    )


def cosine_match(
    queries: DataFrame,
    candidates: DataFrame,
    id_column: str,
    vector: str,
    threshold: float = COSINE_THRESHOLD,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """The most similar candidate of every query by cosine, exactly; equals go to the smallest id.

    A match below the threshold is not accepted but its score is returned. ``pruned_match``
    says how pairs are skipped, which vectors have no score, and how many pairs were left.
    """
    return pruned_match(queries, candidates, id_column, vector, threshold, query_block, candidate_block).rows


def metric_definitions(df: DataFrame, metrics: Sequence[Metric] = METRICS) -> DataFrame:
    """The metric registry as a table."""
    rows = [(m.name, m.kind, list(m.roles), list(m.needs), m.description) for m in metrics]
    return df.sparkSession.createDataFrame(
        rows, "kpi string, kind string, roles array<string>, needs array<string>, description string"
    )


def metric_applicability(mapping: DataFrame, metrics: Sequence[Metric] = METRICS) -> DataFrame:
    """Dataset by metric: calculable when every role is mapped and every dependency is calculable.

    ``mapping`` has rows (dataset, role, column); a null column is no mapping.
    The roles of each dataset form one small set, tested against every metric
    inside the row.
    """
    roles = sorted({r for m in metrics for r in m.roles})
    flags = [F.max(F.when((F.col("role") == r) & F.col("column").isNotNull(), True)).alias(r) for r in roles]
    wide = mapping.groupBy("dataset").agg(*flags)
    by_name = {m.name: m for m in metrics}

    def calculable(metric: Metric) -> Column:
        tests = [F.coalesce(F.col(r), F.lit(False)) for r in metric.roles]
        tests += [calculable(by_name[n]) for n in metric.needs if n in by_name]
        tests += [F.lit(False) for n in metric.needs if n not in by_name]
        out = F.lit(True)
        for test in tests:
            out = out & test
        return out

    rows = F.array(
        *[
            F.struct(F.lit(m.name).alias("kpi"), F.lit(bool(m.needs)).alias("derived"), calculable(m).alias("calculable"))
            for m in metrics
        ]
    )
    return wide.select("dataset", F.inline(rows))


def match_rate(applicability: DataFrame, low: float = LOW_MATCH_RATE) -> DataFrame:
    """Share of calculable metrics per dataset, and whether it calls for supplements."""
    rate = F.avg(F.col("calculable").cast("double"))
    return applicability.groupBy("dataset").agg(
        F.count_if("calculable").alias("calculable"), rate.alias("match_rate"), (rate < low).alias("needs_supplement")
    )


def override_union(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Both tables by key; on the same key the row of the later one wins."""
    return override.unionByName(base.join(override.select(key), key, "left_anti").select(*base.columns))


def supplement_union(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The base and those extra rows whose key it lacks."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti").select(*extra.columns))


def latest_by_key(df: DataFrame, key: str, priority: str) -> DataFrame:
    """One row per key, the one of highest priority; repeated keys combine before the shuffle.

    Equal priorities are decided by the other columns in order, largest first, and a
    null priority is the lowest, so the choice does not depend on partitions.
    """
    rest = [c for c in df.columns if c != key]
    ordered = [priority, *[c for c in rest if c != priority]]
    best = df.groupBy(key).agg(F.max(F.struct(*ordered)).alias("_row"))
    return best.select(key, *[F.col("_row").getField(c).alias(c) for c in rest])
