"""Row cleaning: dates, text, duplicates, invalid values, outliers, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions import dates, text
from tillscope.functions.numbers import rounded
from tillscope.operators.lookup import attach, join_measured
from tillscope.operators.profile import is_numeric, is_temporal
from tillscope.operators.quantiles import exact_quantiles, measured_quantiles
from tillscope.session import written

# Plausible order years, rating scale, fence width, smallest group with quartiles.
FIRST_YEAR, LAST_YEAR = 2020, 2025
LOWEST_RATING, HIGHEST_RATING = 1.0, 5.0
FENCE = 3.0
MIN_GROUP = 4
# Fixed value: below this percentage zeros are kept without review.
ZERO_REVIEW_PCT = 5
CONSISTENCY_SCORE = 95.0


def _kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


# ---------------------------------------------------------------- formats


def _parsed(df: DataFrame, column: str, order: str | None = None) -> Column:
    cell = F.col(f"`{column}`")
    return cell if is_temporal(_kind(df, column)) else dates.parse_timestamp(cell, dates.ordered_patterns(order))


def date_orders(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, column, first_over, second_over, ambiguous and order: whether days or months come first in dates of numbers.

    One aggregate over all values: a first number above 12 speaks for ``dmy``, a second
    one for ``mdy``. The order is null if nothing, or both, was seen. ``ambiguous`` counts
    the values that either order reads, as different dates. ``by`` decides apart for each
    source file, say.
    """
    texts = [c for c in columns if not is_temporal(_kind(df, c))]
    aggregates = []
    for i, c in enumerate(texts):
        text = F.trim(F.col(f"`{c}`").cast("string"))
        one, two = (F.regexp_extract(text, dates.NUMBERS, g).try_cast("int") for g in (1, 3))
        aggregates += [
            F.count_if((one > 12) & (one <= 31) & (two <= 12)).alias(f"a{i}"),
            F.count_if((two > 12) & (two <= 31) & (one <= 12)).alias(f"b{i}"),
            F.count_if((one <= 12) & (two <= 12) & (one != two)).alias(f"c{i}"),
        ]
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("first_over"), F.col(f"b{i}").alias("second_over"), F.col(f"c{i}").alias("ambiguous"))
        for i, c in enumerate(texts)
    ]
    a, b = F.col("first_over") > 0, F.col("second_over") > 0
    counts = df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*rows)))
    return counts.withColumn("order", F.when(a & ~b, "dmy").when(b & ~a, "mdy"))


def decided_orders(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The order of each column that its values decide; a row per column on the driver."""
    return {r["column"]: r["order"] for r in date_orders(df, columns).collect() if r["order"]}


def parse_dates(df: DataFrame, columns: Sequence[str], orders: Mapping[str, str] | None = None) -> DataFrame:
    """Timestamps from mixed formats, the time of day kept; typed columns pass through.

    Days and months are told apart value by value, unless ``orders`` (``decided_orders``
    finds them) gives a column one order for all its values: what does not fit it is null.
    """
    parsed = {c: _parsed(df, c, (orders or {}).get(c)) for c in columns if not is_temporal(_kind(df, c))}
    return df.withColumns(parsed) if parsed else df


def check_dates(
    df: DataFrame,
    columns: Sequence[str],
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    orders: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parse text dates and null those outside the plausible years."""
    texts = [c for c in columns if not is_temporal(_kind(df, c))]
    plausible = {c: F.when(F.year(F.col(f"`{c}`")).between(first_year, last_year), F.col(f"`{c}`")) for c in texts}
    # Parsed in a projection of its own, so each text is parsed once.
    return parse_dates(df, texts, orders).withColumns(plausible) if texts else df


def _with_date_issues(df: DataFrame, columns: Sequence[str], first: int, last: int, keep: Sequence[str]) -> DataFrame:
    """Per column its text as ``_t`` and what is wrong with it as ``_p``, or null."""
    parsed = df.select(
        *keep,
        *[F.col(f"`{c}`").cast("string").alias(f"_t{i}") for i, c in enumerate(columns)],
        *[_parsed(df, c).alias(f"_d{i}") for i, c in enumerate(columns)],
    )
    problems = {
        f"_p{i}": F.when(F.col(f"_t{i}").isNotNull() & F.col(f"_d{i}").isNull(), "unparseable_date").when(
            ~F.year(f"_d{i}").between(first, last), "invalid_date_range"
        )
        for i in range(len(columns))
    }
    return parsed.withColumns(problems)


def dates_with_issues(
    df: DataFrame, column: str, keep: Sequence[str], first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR
) -> DataFrame:
    """``keep``, the plausible date of each row, and what is wrong with it if there is none."""
    found = _with_date_issues(df, [column], first_year, last_year, keep)
    return found.select(*keep, F.when(F.col("_p0").isNull(), F.col("_d0")).alias(column), F.col("_p0").alias("issue"))


def date_issues(
    df: DataFrame,
    columns: Sequence[str],
    row_id: str,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
) -> DataFrame:
    """One row per date that does not parse or is out of range."""
    found = _with_date_issues(df, columns, first_year, last_year, [row_id])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_p{i}").alias("issue"), F.col(f"_t{i}").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return found.select(F.col(row_id).alias("row_id"), F.inline(cells)).where(F.col("issue").isNotNull())


def date_summary(
    df: DataFrame, columns: Sequence[str], first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR
) -> DataFrame:
    """Per date column: values parsed, unparseable, out of range."""
    found = _with_date_issues(df, columns, first_year, last_year, [])
    aggregates, rows = [], []
    for i, column in enumerate(columns):
        aggregates += [
            F.count_if(F.col(f"_t{i}").isNotNull() & F.col(f"_p{i}").isNull()).alias(f"s{i}"),
            F.count_if(F.col(f"_p{i}") == "unparseable_date").alias(f"u{i}"),
            F.count_if(F.col(f"_p{i}") == "invalid_date_range").alias(f"r{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(column).alias("column"),
                F.col(f"s{i}").alias("parsed"),
                F.col(f"u{i}").alias("unparseable"),
                F.col(f"r{i}").alias("out_of_range"),
            )
        )
    return found.agg(*aggregates).select(F.inline(F.array(*rows)))


def standardize_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim, title-case and single-space text columns; other types pass through."""
    texts = [c for c in columns if isinstance(_kind(df, c), T.StringType)]
    return df.withColumns({c: text.standardize(F.col(f"`{c}`")) for c in texts}) if texts else df


def text_changes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many values of each column standardising would change."""
    texts = [c for c in columns if isinstance(_kind(df, c), T.StringType)]
    changed = [
        F.count_if(text.standardize(F.col(f"`{c}`")) != F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(texts)
    ]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("changed")) for i, c in enumerate(texts)]
    return df.agg(*changed).select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- duplicates


def fingerprint(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """128 bits of the cells of a row as two numbers; equal rows have equal ones."""
    cells: list[Column] = []
    for c in columns:
        cell, kind = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            cell = F.when(cell == 0, F.lit(0.0)).otherwise(cell)  # minus zero is zero
        # A hash passes over a null, so which cells are null counts too.
        cells += [cell.isNull(), cell]
    return [F.xxhash64(*cells).alias("_print1"), F.xxhash64(F.lit("second"), *cells).alias("_print2")]


def _repeated(df: DataFrame, row_id: str) -> DataFrame:
    """Ids of all rows that equal an earlier one.

    Only fingerprints and ids of all rows are shuffled, however wide the rows are. Rows
    that share a fingerprint, and no others, are then grouped by all their cells, so
    different rows of one fingerprint stay. The rows are read three times: what is
    costly to compute should be written before.
    """
    columns = [c for c in df.columns if c != row_id]
    prints = df.select(*fingerprint(df, columns))
    shared = written(prints.groupBy("_print1", "_print2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n"), "fingerprints")
    suspects = df.select("*", *fingerprint(df, columns)).join(shared, ["_print1", "_print2"], "left_semi")
    firsts = suspects.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(row_id).alias(row_id)).select(row_id)
    return suspects.select(row_id).join(firsts, row_id, "left_anti")


def drop_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One copy of each distinct row; with ``row_id``, which is unique, the copy that came first.

    With ids the rows themselves are not shuffled: those that repeat an earlier one are
    found by fingerprint and left out by id.
    """
    if row_id is None:
        return df.dropDuplicates()
    return df.join(written(_repeated(df, row_id), "duplicates"), row_id, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def duplicate_report(df: DataFrame, row_id: str, examples: int = 10) -> DataFrame:
    """Number of surplus rows and the ids of the first few."""
    extra = written(_repeated(df, row_id), "duplicates")
    shown = (
        extra.orderBy(row_id)
        .limit(examples)
        .agg(F.array_join(F.array_sort(F.collect_list(row_id)), ",").alias("ids"))
        .scalar()
    )
    return extra.agg(F.count(F.lit(1)).alias("duplicates")).select("duplicates", shown.alias("first_ids"))


# ---------------------------------------------------------------- invalid values


def fix_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    positive = {c: F.abs(F.col(f"`{c}`")) for c in columns if is_numeric(_kind(df, c))}
    return df.withColumns(positive) if positive else df


def sign_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: negatives, zeros, the share of zeros and what is done about them."""
    numeric = [c for c in columns if is_numeric(_kind(df, c))]
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, column in enumerate(numeric):
        cell = F.col(f"`{column}`")
        aggregates += [F.count_if(cell < 0).alias(f"n{i}"), F.count_if(cell == 0).alias(f"z{i}")]
        share = F.try_divide(F.col(f"z{i}").cast("double"), F.col("rows").cast("double")) * 100
        rows.append(
            F.struct(
                F.lit(column).alias("column"),
                F.col(f"n{i}").alias("negatives"),
                F.col(f"z{i}").alias("zeros"),
                rounded(share, 2).alias("zero_pct"),
                F.when(F.col(f"z{i}") == 0, None)
                .when(share < ZERO_REVIEW_PCT, "kept_as_is")
                .otherwise("flagged_for_review")
                .alias("zero_action"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def clip_rating(
    df: DataFrame, columns: Sequence[str], low: float = LOWEST_RATING, high: float = HIGHEST_RATING
) -> DataFrame:
    def clip(cell: Column) -> Column:
        return F.when(cell < low, F.lit(low)).when(cell > high, F.lit(high)).otherwise(cell)

    return df.withColumns({c: clip(F.col(f"`{c}`").cast("double")) for c in columns}) if columns else df


def rating_report(
    df: DataFrame, columns: Sequence[str], low: float = LOWEST_RATING, high: float = HIGHEST_RATING
) -> DataFrame:
    counts = [
        F.count_if((F.col(f"`{c}`") < low) | (F.col(f"`{c}`") > high)).alias(f"c{i}") for i, c in enumerate(columns)
    ]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("out_of_range")) for i, c in enumerate(columns)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- outliers


def _values_by_column(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").cast("double").alias("_value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(*keep, F.inline(cells))


def quartile_table(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], factor: float = FENCE
) -> tuple[DataFrame, bool]:
    """Per group one row: the median, and the fences where there are four values, of every column;
    and whether the groups are few enough to broadcast.

    Clipping to the fences does not move a median, so one pass serves both
    outliers and missing values.
    """
    quartiles, small = measured_quantiles(
        _values_by_column(df, columns, by), [*by, "_i"], "_value", [0.25, 0.5, 0.75]
    )
    reach = F.lit(float(factor)) * (F.col("q2") - F.col("q0"))
    wide = []
    for i in range(len(columns)):
        mine = F.col("_i") == i
        fenced = mine & (F.col("n") >= MIN_GROUP)
        wide += [
            F.max(F.when(fenced, F.col("q0") - reach)).alias(f"_low{i}"),
            F.max(F.when(mine, F.col("q1"))).alias(f"_median{i}"),
            F.max(F.when(fenced, F.col("q2") + reach)).alias(f"_high{i}"),
        ]
    return quartiles.groupBy(*by).agg(*wide), small


def _clip(cell: Column, low: Column, high: Column) -> Column:
    number = cell.cast("double")
    return F.when(number < low, low).when(number > high, high).otherwise(number)


def clip_outliers_by_group(
    df: DataFrame, columns: Sequence[str], group: str, factor: float = FENCE
) -> DataFrame:
    """Clip each column to its group's quartile fences.

    Groups with fewer than four values, and rows without a group, stay as they are.
    """
    return clip_and_fill_by_group(df, columns, [], group, factor)


def clip_and_fill_by_group(
    df: DataFrame, clip: Sequence[str], fill: Sequence[str], group: str, factor: float = FENCE
) -> DataFrame:
    """Clip some columns to their group's fences and fill some with their group's median, in one pass."""
    columns = [c for c in df.columns if c in clip or c in fill]
    if not columns:
        return df
    quartiles, small = quartile_table(df, columns, [group], factor)
    known = join_measured(df, quartiles, [group], small)
    changed = {}
    for i, column in enumerate(columns):
        value = F.col(f"`{column}`").cast("double")
        if column in clip:
            value = _clip(value, F.col(f"_low{i}"), F.col(f"_high{i}"))
        if column in fill:
            value = F.coalesce(value, F.col(f"_median{i}"))
        changed[column] = value
    return known.withColumns(changed).select(*[F.col(f"`{c}`") for c in df.columns])


def outlier_counts_by_group(
    df: DataFrame, columns: Sequence[str], group: str, factor: float = FENCE
) -> DataFrame:
    """Values outside the fences per group and column."""
    quartiles, small = quartile_table(df, columns, [group], factor)
    fenced = join_measured(df, quartiles, [group], small)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (
                    (F.col(f"`{c}`").cast("double") < F.col(f"_low{i}"))
                    | (F.col(f"`{c}`").cast("double") > F.col(f"_high{i}"))
                ).alias("outside"),
            )
            for i, c in enumerate(columns)
        ]
    )
    outside = fenced.select(F.col(group).alias("group"), F.inline(cells)).where("outside")
    return outside.groupBy("column", "group").agg(F.count(F.lit(1)).alias("outliers"))


def clip_outliers_global(df: DataFrame, columns: Sequence[str], factor: float = FENCE) -> DataFrame:
    fences, _ = quartile_table(df, columns, [], factor)
    fence = fences.select(F.struct(*fences.columns)).scalar()
    return df.withColumns(
        {
            c: _clip(F.col(f"`{c}`"), fence.getField(f"_low{i}"), fence.getField(f"_high{i}"))
            for i, c in enumerate(columns)
        }
    )


# ---------------------------------------------------------------- missing values


def median_of(df: DataFrame, column: str) -> Column:
    """The exact global median as a one-row lookup."""
    return exact_quantiles(df, [], column, [0.5]).select("q0").scalar()


def mode_of(df: DataFrame, column: str) -> Column:
    """The most frequent value, the smallest on ties."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(f"`{column}`").agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), F.col(f"`{column}`")).limit(1).select(f"`{column}`").scalar()


def _group_fill(df: DataFrame, column: str, group: str, method: str) -> DataFrame:
    known = df.where(F.col(group).isNotNull() & F.col(f"`{column}`").isNotNull())
    if method == "mean":
        return known.groupBy(group).agg(F.avg(F.col(f"`{column}`").cast("double")).alias("_fill"))
    if method == "mode":
        counts = known.groupBy(group, F.col(f"`{column}`").alias("_fill")).agg(F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy(group).orderBy(F.desc("_n"), "_fill")
        best = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1)
        return best.select(group, "_fill")
    raise ValueError(f"unknown imputation method: {method}")


def impute_by_group(df: DataFrame, column: str, group: str, method: str = "median") -> DataFrame:
    """Fill nulls with their group's statistic, the rest with the median of the filled column.

    Columns that are no numbers keep their type with method ``mode``, and the rest takes the mode of the filled column.
    """
    if method == "median":
        filled = clip_and_fill_by_group(df, [], [column], group)
        return fill_rest_with_median(filled, column)
    known = attach(df, _group_fill(df, column, group, method), [group])
    if method == "mode" and not isinstance(df.schema[column].dataType, T.NumericType):
        filled = known.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.col("_fill")))
        return impute_mode(filled.select(*[F.col(f"`{c}`") for c in df.columns]), [column])
    filled = known.withColumn(column, F.coalesce(F.col(f"`{column}`").cast("double"), F.col("_fill"))).drop("_fill")
    filled = filled.select(*[F.col(f"`{c}`") for c in df.columns])
    return fill_rest_with_median(filled, column)


def fill_rest_with_median(df: DataFrame, column: str) -> DataFrame:
    """Fill the nulls of a column with its exact median."""
    return df.withColumn(column, F.coalesce(F.col(f"`{column}`").cast("double"), median_of(df, column)))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    medians = exact_quantiles(_values_by_column(df, columns), ["_i"], "_value", [0.5])
    wide = medians.agg(*[F.max(F.when(F.col("_i") == i, F.col("q0"))).alias(f"m{i}") for i in range(len(columns))])
    lookup = wide.select(F.struct(*wide.columns)).scalar()
    return df.withColumns(
        {
            c: F.coalesce(F.col(f"`{c}`").cast("double"), lookup.getField(f"m{i}"))
            for i, c in enumerate(columns)
        }
    )


def modes_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """The most frequent value of every column, the smallest on ties, as one record (m0, m1, ...) from one scan.

    Values are counted under their own types: each column has its own slot in the counted rows.
    """
    slots = [
        F.struct(F.lit(i).alias("_i"), *[(F.col(f"`{c}`") if i == j else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{j}") for j, c in enumerate(columns)])
        for i in range(len(columns))
    ]
    cells = df.select(F.inline(F.array(*slots)))
    values = [f"v{j}" for j in range(len(columns))]
    known = F.coalesce(*[F.when(F.col(v).isNotNull(), True) for v in values], F.lit(False))
    counts = cells.where(known).groupBy("_i", *values).agg(F.count(F.lit(1)).alias("_n"))
    best = [F.min_by(F.col(v), F.when(F.col("_i") == j, F.struct(-F.col("_n"), F.col(v)))).alias(f"m{j}") for j, v in enumerate(values)]
    return counts.agg(F.struct(*best).alias("s")).scalar()


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = modes_of(df, columns)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), modes.getField(f"m{i}")) for i, c in enumerate(columns)})


MAX_RANGES = 100_000


def _in_ranges(df: DataFrame, order_by: str, width: int) -> DataFrame:
    """Rows with ``_range``, the number of the key range each lies in.

    Dense keys are cut every ``width`` keys. Where that would make too many ranges
    (timestamps in micros, hashed ids), rows are dealt out by sampled key bounds, one
    range per task, and written, so that the ranges stay what they are.
    """
    span = df.agg(F.min(order_by).cast("decimal(38,0)").alias("low"), F.max(order_by).cast("decimal(38,0)").alias("high")).first()
    if span["low"] is None or (span["high"] - span["low"]) / width < MAX_RANGES:
        return df.withColumn("_range", F.expr(f"`{order_by}` div {int(width)}"))
    return written(df.repartitionByRange(F.col(order_by)).withColumn("_range", F.spark_partition_id().cast("long")), "ranges")


def fill_in_order(df: DataFrame, columns: Sequence[str], order_by: str, width: int = 1_000_000) -> DataFrame:
    """Carry the last known value forward, then the first known value back.

    ``order_by`` is a unique whole number. Rows are cut into key ranges; the last
    value of each range is carried over the ranges in a table of one row per range
    (``MAX_RANGES`` or the number of tasks at most), and the rest happens inside the ranges.
    """
    ranged = _in_ranges(df, order_by, width)
    known = {c: F.when(F.col(f"`{c}`").isNotNull(), F.col(order_by)) for c in columns}
    ends = ranged.groupBy("_range").agg(
        *[F.max_by(F.col(f"`{c}`"), known[c]).alias(f"_end{i}") for i, c in enumerate(columns)]
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_range", *[F.last(f"_end{i}", ignorenulls=True).over(before).alias(f"_carry{i}") for i in range(len(columns))]
    )
    firsts = df.agg(
        F.struct(*[F.min_by(F.col(f"`{c}`"), known[c]).alias(f"f{i}") for i, c in enumerate(columns)]).alias("s")
    ).scalar()
    inside = Window.partitionBy("_range").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(carried, "_range", "left")
    filled = {
        c: F.coalesce(
            F.last(F.col(f"`{c}`"), ignorenulls=True).over(inside), F.col(f"_carry{i}"), firsts.getField(f"f{i}")
        )
        for i, c in enumerate(columns)
    }
    return joined.withColumns(filled).select(*[F.col(f"`{c}`") for c in df.columns])


# ---------------------------------------------------------------- checks and scores


def unusual_prices(df: DataFrame, price: str, product: str, deviations: float = 3.0) -> DataFrame:
    """Per product with at least two rows: prices further than 3 sample deviations from its median."""
    rows = df.where(F.col(product).isNotNull())
    quantiles, small = measured_quantiles(rows, [product], price, [0.5])
    medians = quantiles.select(product, F.col("q0").alias("_median"))
    spread = rows.groupBy(product).agg(
        F.count(F.lit(1)).alias("_rows"), F.stddev_samp(F.col(f"`{price}`").cast("double")).alias("_sd")
    )
    stats = spread.where(F.col("_rows") >= 2).join(medians, product)
    far = F.abs(F.col(f"`{price}`").cast("double") - F.col("_median")) > F.lit(deviations) * F.col("_sd")
    # Equal prices of a product are one row, so that a hot product spreads over the salts of a large join.
    prices = rows.groupBy(product, price).agg(F.count(F.lit(1)).alias("_n"))
    checked = join_measured(prices, stats, [product], small)
    return checked.groupBy(F.col(product).alias("product")).agg(F.coalesce(F.sum(F.when(far, F.col("_n"))), F.lit(0)).alias("unusual"))


def completeness(df: DataFrame) -> DataFrame:
    """Share of non-null cells in percent; 100 for an empty table."""
    filled = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in df.columns), F.lit(0))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))
    cells = F.col("rows") * len(df.columns)
    nulls = cells - F.col("filled")
    share = (1 - nulls.cast("double") / cells.cast("double")) * 100
    return counts.select(F.when(cells > 0, share).otherwise(100.0).alias("completeness"))


def quality_scores(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Completeness, validity, consistency and their weighted total, each to two places.

    Validity counts entries of the issues log, leaving out duplicates.
    """
    entries = issues.where(F.col("issue") != "exact_duplicates").agg(F.count(F.lit(1))).scalar()
    filled = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in df.columns), F.lit(0))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))
    rows = F.col("rows").cast("double")
    parts = counts.select(
        F.when(rows > 0, F.col("filled") / (rows * len(df.columns)) * 100).otherwise(0.0).alias("completeness"),
        F.when(rows > 0, F.greatest(F.lit(0.0), F.lit(100.0) - entries / rows * 100)).otherwise(0.0).alias("validity"),
        F.lit(CONSISTENCY_SCORE).alias("consistency"),
    )
    total = F.col("completeness") * 0.4 + F.col("validity") * 0.4 + F.col("consistency") * 0.2
    return parts.select(
        rounded(F.col("completeness"), 2).alias("completeness"),
        rounded(F.col("validity"), 2).alias("validity"),
        rounded(F.col("consistency"), 2).alias("consistency"),
        rounded(total, 2).alias("overall"),
    )
