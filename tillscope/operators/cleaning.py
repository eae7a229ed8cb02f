"""Reviewable cleaning: a plan, its application, the full clean-up and its issues log."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators import clean
from tillscope.operators.profile import is_numeric, semantic_types
from tillscope.session import written

TEXT_TYPES = ("categorical", "product", "payment_method")
AMOUNT_TYPES = ("revenue", "quantity")
# Steps run in this order, whatever the column order.
STEP_ORDER = ("parse_date", "standardize_text", "remove_duplicates", "fix_negative", "handle_outliers", "fill_missing")

PLAN_COLUMNS = (
    "ordinal", "column", "semantic_type", "step_id", "action", "reason", "recommended", "missing_count", "total_rows",
)


def _typed(df: DataFrame, row_id: str | None) -> dict[str, str]:
    """Semantic type per column; as many rows as the schema has columns."""
    columns = [c for c in df.columns if c != row_id]
    return {r["column"]: r["semantic_type"] for r in semantic_types(df.select(*columns)).orderBy("ordinal").collect()}


def cleaning_plan(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per proposed step; columns that need nothing do not appear."""
    columns = [c for c in df.columns if c != row_id]
    data = df.select(*columns)
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, column in enumerate(columns):
        cell = F.col(f"`{column}`")
        negative = F.count_if(cell < 0) if is_numeric(df.schema[column].dataType) else F.lit(0)
        aggregates += [F.count_if(cell.isNull()).alias(f"m{i}"), negative.alias(f"g{i}")]
    counts = data.agg(*aggregates).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"m{i}").alias("missing_count"),
                        F.col(f"g{i}").alias("negatives"),
                        F.col("total").alias("total_rows"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )
    kind, name = F.col("semantic_type"), F.col("column")
    amounts = kind.isin(*AMOUNT_TYPES)

    def step(condition, action, suffix, reason, recommended=True):
        return F.when(
            condition,
            F.struct(
                F.concat(name, F.lit(f"_{suffix}")).alias("step_id"),
                F.lit(action).alias("action"),
                reason.alias("reason"),
                F.lit(recommended).alias("recommended"),
            ),
        )

    method = F.when(amounts, "median").otherwise("mode")
    steps = F.array_compact(
        F.array(
            step(kind == "date", "parse_date", "parse_date", F.lit("Read dates in mixed formats")),
            step(kind.isin(*TEXT_TYPES), "standardize_text", "standardize_text", F.lit("Trim and title-case text")),
            step(
                amounts & (F.col("negatives") > 0),
                "fix_negative",
                "fix_negative",
                F.concat(F.lit("Make "), F.col("negatives"), F.lit(" negative value(s) positive")),
            ),
            step(amounts, "handle_outliers", "handle_outliers", F.lit("Clip values outside the quartile fences"), False),
            step(
                F.col("missing_count") > 0,
                "fill_missing",
                "fill_missing",
                F.concat(F.lit("Fill "), F.col("missing_count"), F.lit(" missing value(s) with the "), method),
            ),
        )
    )
    typed = semantic_types(data).join(counts, "column")
    per_column = typed.select(
        "ordinal", "column", "semantic_type", "missing_count", "total_rows", F.inline(steps)
    )
    copies = data.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("copies"))
    duplicates = copies.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
    ).where(F.col("surplus") > 0)
    whole_table = duplicates.select(
        F.lit(None).cast("int").alias("ordinal"),
        F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("semantic_type"),
        F.lit("remove_duplicates").alias("step_id"),
        F.lit("remove_duplicates").alias("action"),
        F.concat(F.lit("Remove "), F.col("surplus"), F.lit(" repeated row(s)")).alias("reason"),
        F.lit(True).alias("recommended"),
        F.lit(None).cast("long").alias("missing_count"),
        "total_rows",
    )
    return per_column.select(*PLAN_COLUMNS).unionByName(whole_table.select(*PLAN_COLUMNS))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_distinct("column").alias("columns_needing_cleaning"),
        F.count(F.lit(1)).alias("total_cleaning_steps"),
    )


def apply_cleaning(
    df: DataFrame, row_id: str, choices: Mapping[str, bool] | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run the chosen steps of the plan; returns the cleaned rows and a log.

    ``choices`` maps step ids to yes or no; ``None`` means every step and
    ``"recommended"`` the steps the plan recommends. The plan has a handful of
    rows per column, so reading it on the driver is bounded by the schema.
    """
    plan = cleaning_plan(df, row_id).collect()
    types = _typed(df, row_id)
    if choices is None:
        wanted = {s["step_id"] for s in plan}
    elif choices == "recommended":
        wanted = {s["step_id"] for s in plan if s["recommended"]}
    else:
        wanted = {k for k, yes in choices.items() if yes}
    chosen = [s for s in plan if s["step_id"] in wanted]
    product = next((c for c, t in types.items() if t == "product"), None)

    failed: set[str] = set()

    def columns_for(action: str) -> list[str]:
        return [c for c in df.columns for s in chosen if s["action"] == action and s["column"] == c]

    def attempt(action: str, out: DataFrame, step: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
        """All columns of a step, or, if the step does not fit one of them, each that it fits."""
        columns = columns_for(action)
        if not columns:
            return out
        try:
            return step(out, columns)
        except AnalysisException:
            for column in columns:
                try:
                    out = step(out, [column])
                except AnalysisException:
                    failed.add(f"{column}_{action}")
            return out

    out = attempt("parse_date", df, clean.check_dates)
    out = attempt("standardize_text", out, clean.standardize_text)
    if any(s["action"] == "remove_duplicates" for s in chosen):
        out = clean.drop_duplicates(written(out, "standardized"), row_id)
    out = attempt("fix_negative", out, clean.fix_negative)
    if columns_for("handle_outliers") or columns_for("fill_missing"):
        out = written(out, "formatted")
    amounts = [c for c in columns_for("fill_missing") if types[c] in AMOUNT_TYPES]
    unfit = _not_numbers(out, {*columns_for("handle_outliers"), *amounts})
    failed |= {f"{c}_handle_outliers" for c in columns_for("handle_outliers") if c in unfit} | {f"{c}_fill_missing" for c in amounts if c in unfit}
    outliers = [c for c in columns_for("handle_outliers") if c not in unfit]
    missing = {c: types[c] for c in columns_for("fill_missing") if types[c] not in AMOUNT_TYPES or c not in unfit}
    out = _clip_and_fill(out, outliers, missing, product, row_id)
    status = lambda step: "failed" if step in failed else "applied" if step in wanted else "skipped"
    log = df.sparkSession.createDataFrame(
        [(s["step_id"], s["action"], status(s["step_id"])) for s in plan], "step_id string, action string, status string"
    )
    return out, log


def _not_numbers(df: DataFrame, columns: Iterable[str]) -> set[str]:
    """The columns with a cell that can't be read as a number, from one scan of those that are no numbers by type."""
    out, counted = set(), []
    for column in sorted(columns):
        if is_numeric(df.schema[column].dataType):
            continue
        try:
            df.select(F.col(f"`{column}`").cast("double"))
            counted.append(column)
        except AnalysisException:
            out.add(column)
    if counted:
        bad = lambda c: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull())
        found = df.agg(*[bad(c).alias(f"n{i}") for i, c in enumerate(counted)]).first()
        out |= {c for c, n in zip(counted, found) if n}
    return out


def _clip_and_fill(
    df: DataFrame, outliers: list[str], missing: Mapping[str, str], product: str | None, row_id: str
) -> DataFrame:
    """Clip outliers, then fill each column as its type asks: revenue by product median,
    other amounts by median, dates in row order, the rest by mode."""
    revenue = [c for c, kind in missing.items() if kind == "revenue" and product]
    out = df
    if product:
        # Written once: the statistics below read single columns of it, not the join again.
        out = written(clean.clip_and_fill_by_group(out, outliers, revenue, product), "clipped")
        for column in revenue:
            out = clean.fill_rest_with_median(out, column)
    elif outliers:
        out = clean.clip_outliers_global(out, outliers)
    medians = [c for c, kind in missing.items() if kind in AMOUNT_TYPES and c not in revenue]
    if medians:
        out = clean.impute_median(out, medians)
    modes = [c for c, kind in missing.items() if kind not in (*AMOUNT_TYPES, "date")]
    if modes:
        out = clean.impute_mode(out, modes)
    days = [c for c, kind in missing.items() if kind == "date"]
    if days:
        out = clean.fill_in_order(out, days, row_id)
    return out


def invalid_value_issues(formatted: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One entry per column and kind of invalid value."""
    spark = formatted.sparkSession
    empty = spark.createDataFrame([], "column string, issue string, count long, action string")
    revenue = [c for c, t in types.items() if t == "revenue"]
    ratings = [c for c, t in types.items() if t == "rating"]
    out = empty
    if revenue:
        signs = clean.sign_report(formatted, revenue)
        entries = F.array(
            F.struct(
                F.lit("negative_values").alias("issue"),
                F.col("negatives").alias("count"),
                F.lit("converted_to_absolute").alias("action"),
            ),
            F.struct(F.lit("zero_values").alias("issue"), F.col("zeros").alias("count"), F.col("zero_action").alias("action")),
        )
        out = out.unionByName(signs.select("column", F.inline(entries)))
    if ratings:
        out = out.unionByName(
            clean.rating_report(formatted, ratings).select(
                "column",
                F.lit("out_of_range_ratings").alias("issue"),
                F.col("out_of_range").alias("count"),
                F.lit("clipped_to_1_5").alias("action"),
            )
        )
    return out.where(F.col("count") > 0)


def cleaning_issues(raw: DataFrame, row_id: str, cleaned: DataFrame, deduped: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The issues log: bad dates row by row, the rest one entry per column or table."""
    days = [c for c, t in types.items() if t == "date" and raw.schema[c].dataType.typeName() == "string"]
    log = invalid_value_issues(deduped, types).select(
        "column", "issue", F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("row_id"), "count", "action"
    )
    if days:
        bad = clean.date_issues(raw, days, row_id).select(
            "column", "issue", "value", F.col("row_id").cast("long").alias("row_id"),
            F.lit(1).cast("long").alias("count"), F.lit("set_to_null").alias("action"),
        )
        log = log.unionByName(bad)
    kept = deduped.agg(F.count(F.lit(1))).scalar()
    surplus = raw.agg(F.count(F.lit(1)).alias("rows")).select((F.col("rows") - kept).alias("count"))
    surplus = surplus.where(F.col("count") > 0)
    log = log.unionByName(_table_entry(surplus, "exact_duplicates", "removed"))
    product = [c for c, t in types.items() if t == "product"]
    revenue = [c for c, t in types.items() if t == "revenue"]
    if product and revenue:
        # Two columns, written once, instead of running the whole clean-up per statistic.
        prices = written(cleaned.select(product[-1], revenue[-1]), "prices")
        unusual = clean.unusual_prices(prices, revenue[-1], product[-1]).agg(F.sum("unusual").alias("count"))
        log = log.unionByName(
            _table_entry(unusual.where(F.col("count") > 0), "unusual_price_for_product", "reported")
        )
    return log


def _table_entry(counts: DataFrame, issue: str, action: str) -> DataFrame:
    return counts.select(
        F.lit(None).cast("string").alias("column"),
        F.lit(issue).alias("issue"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("long").alias("row_id"),
        F.col("count").cast("long").alias("count"),
        F.lit(action).alias("action"),
    )


@dataclass(frozen=True)
class Cleaned:
    """The cleaned rows; the log and the scores are computed when asked for."""

    rows: DataFrame
    raw: DataFrame
    deduped: DataFrame
    types: Mapping[str, str]
    row_id: str

    def issues(self) -> DataFrame:
        return cleaning_issues(self.raw, self.row_id, self.rows, self.deduped, self.types)

    def filled_dates(self) -> DataFrame:
        """(row_id, column, value): the raw text of every date that the cleaned rows have from another row."""
        days = [c for c, t in self.types.items() if t == "date"]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("_date")) for c in days])
        gaps = self.deduped.select(self.row_id, F.inline(cells)).where(F.col("_date").isNull()).drop("_date")
        texts = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"`{c}`").cast("string").alias("value")) for c in days])
        raw = self.raw.select(F.col(self.row_id).alias("_r"), F.inline(texts))
        return gaps.join(raw, (F.col(self.row_id) == F.col("_r")) & (F.col("column") == F.col("_c"))).drop("_r", "_c")

    def actions(self) -> DataFrame:
        """What the clean-up changed: (column, action, cells) with the cells made positive, clipped and filled."""
        columns = [c for c in self.deduped.columns if c != self.row_id]
        before = self.deduped.select(F.col(self.row_id).alias("_r"), *[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(columns)])
        entries = []
        for i, column in enumerate(columns):
            old, new, kind = F.col(f"_b{i}"), F.col(f"`{column}`"), self.types[column]
            tests = [("filled", old.isNull() & new.isNotNull())]
            if kind == "revenue":
                tests.append(("made_positive", old < 0))
            if kind in AMOUNT_TYPES or kind == "rating":
                sign = F.abs(old.cast("double")) if kind == "revenue" else old.cast("double")
                tests.append(("clipped", old.isNotNull() & (sign != new.cast("double"))))
            entries += [F.struct(F.lit(column).alias("column"), F.lit(a).alias("action"), F.count_if(t).alias("cells")) for a, t in tests]
        both = self.rows.join(before, F.col(self.row_id) == F.col("_r"))
        return both.agg(F.array(*entries).alias("_entries")).select(F.inline("_entries")).where(F.col("cells") > 0)

    def quality(self) -> DataFrame:
        return clean.quality_scores(self.rows.drop(self.row_id), self.issues())


def clean_sales(df: DataFrame, row_id: str) -> Cleaned:
    """Formats, duplicates, invalid values, outliers, missing values.

    The rows are written when they are formatted and once more after duplicates are
    gone: everything later reads those columnar tables and only the columns it needs.
    """
    types = _typed(df, row_id)

    def of_type(*kinds: str) -> list[str]:
        return [c for c, t in types.items() if t in kinds]

    formatted = clean.standardize_text(clean.check_dates(df, of_type("date")), of_type(*TEXT_TYPES))
    deduped = written(clean.drop_duplicates(written(formatted, "formatted"), row_id), "deduped")
    out = clean.clip_rating(clean.fix_negative(deduped, of_type("revenue")), of_type("rating"))
    # Quantities, products and identifiers keep their gaps here.
    missing = {c: t for c, t in types.items() if t in ("revenue", "rating", "categorical", "payment_method", "date")}
    product = next(iter(of_type("product")), None)
    out = _clip_and_fill(out, of_type(*AMOUNT_TYPES), missing, product, row_id)
    return Cleaned(out, df, deduped, types, row_id)
