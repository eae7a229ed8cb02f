"""Column profiles, semantic types and date formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions import dates
from tillscope.functions.numbers import rounded
from tillscope.operators.quantiles import exact_quantiles

# Name keywords per semantic type, in priority order.
SEMANTIC_KEYWORDS = (
    ("date", ("date", "time", "day", "month", "year")),
    ("identifier", ("id", "reference", "code")),
    ("rating", ("rating", "review", "score", "stars")),
    ("revenue", ("amount", "price", "revenue", "sales", "value", "cost")),
    ("quantity", ("quantity", "qty", "count", "units", "volume")),
    ("product", ("item", "product", "category", "type")),
    ("payment_method", ("payment", "method", "channel")),
)
# Names that mark a time column, and names left out of metrics.
TIME_WORDS = ("date", "time", "timestamp")
DATE_LIKE_WORDS = ("date", "time", "timestamp", "day", "month", "year")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def column_catalogue(df: DataFrame, table: str | None = None) -> DataFrame:
    """One row per column of ``df``: ordinal, name, type and type family."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), is_numeric(f.dataType), is_temporal(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "table string, ordinal int, column string, dtype string, numeric boolean, temporal boolean"
    )


def unpivot_text(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Long rows (column, value as text); nulls are kept."""
    columns = list(columns or [c for c in df.columns if c not in keep])
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(cells))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column.

    Values are combined by column and 128 bits of each, 20 bytes however long they are,
    so neither a frequent value nor a wide column ends up in one task.
    """
    columns = list(columns or df.columns)

    def prints(c: str) -> list[Column]:
        cell, kind = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            cell = F.when(cell == 0, F.lit(0.0)).otherwise(cell)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            cell = F.col(f"`{c}`").cast("string")  # a hash passes over nulls inside
        return [F.when(cell.isNotNull(), F.xxhash64(cell)).alias("one"), F.xxhash64(F.lit("second"), cell).alias("two")]

    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), *prints(c)) for i, c in enumerate(columns)])))
    counts = cells.where(F.col("one").isNotNull()).groupBy("place", "one", "two").agg(F.lit(1).alias("_")).groupBy("place").agg(F.count(F.lit(1)).alias("unique_count"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "place int, column string")
    return names.join(counts, "place", "left").select("column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: nulls, distinct values and, for numbers, the moments and the median.

    ``approximate`` swaps the exact distinct counts and medians for sketches,
    which leaves a single scan.
    """
    fields = df.schema.fields
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        cell = F.col(f"`{field.name}`")
        aggregates.append(F.count(cell).alias(f"n{i}"))
        if approximate:
            aggregates.append(F.approx_count_distinct(cell).alias(f"u{i}"))
        if field.name in numeric:
            number = cell.cast("double")
            aggregates += [
                F.min(number).alias(f"min{i}"),
                F.max(number).alias(f"max{i}"),
                F.avg(number).alias(f"mean{i}"),
                F.stddev_samp(number).alias(f"std{i}"),
            ]
            if approximate:
                aggregates.append(F.percentile_approx(number, 0.5).alias(f"med{i}"))

    def cell_of(i: int, field: T.StructField) -> Column:
        number = field.name in numeric

        def stat(name: str, have: bool = True) -> Column:
            return (F.col(f"{name}{i}") if have else F.lit(None)).cast("double")

        return F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("dtype"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            (F.col(f"u{i}") if approximate else F.lit(None)).cast("long").alias("unique_count"),
            stat("min", number).alias("min"),
            stat("max", number).alias("max"),
            stat("mean", number).alias("mean"),
            stat("med", number and approximate).alias("median"),
            stat("std", number).alias("std"),
        )

    wide = df.agg(*aggregates)
    table = wide.select(F.inline(F.array(*[cell_of(i, f) for i, f in enumerate(fields)])))
    if not approximate:
        table = table.drop("unique_count", "median").join(distinct_counts(df), "column", "left")
        if numeric:
            numbers_long = df.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
                            for c in numeric
                        ]
                    )
                )
            )
            medians = exact_quantiles(numbers_long, ["column"], "value", [0.5])
            table = table.join(medians.select("column", F.col("q0").alias("median")), "column", "left")
        else:
            table = table.withColumn("median", F.lit(None).cast("double"))

    def percent(part: Column) -> Column:
        return rounded(F.try_divide(part.cast("double"), F.col("rows").cast("double")) * 100, 2)

    return table.select(
        "ordinal",
        "column",
        "dtype",
        "rows",
        "null_count",
        percent(F.col("null_count")).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        percent(F.coalesce("unique_count", F.lit(0))).alias("unique_pct"),
        "min",
        "max",
        "mean",
        "median",
        "std",
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each non-numeric column; ties by value."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    counts = (
        unpivot_text(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_type(name: str, word_boundary: bool = False) -> str | None:
    """Semantic type by name alone, on the driver, for one schema."""
    lowered = name.lower()
    parts = set(lowered.replace("-", "_").replace(" ", "_").split("_"))
    for kind, words in SEMANTIC_KEYWORDS:
        if any((w in parts) if word_boundary else (w in lowered) for w in words):
            return kind
    return None


def semantic_type(
    name: Column, unique_ratio: Column, numeric: Column, word_boundary: bool = False
) -> Column:
    """Semantic type of catalogue rows: name keywords first, then uniqueness."""
    lowered = F.lower(name)
    kind = None
    for label, words in SEMANTIC_KEYWORDS:
        pattern = "|".join(words)
        if word_boundary:
            pattern = f"(^|[_ -])({pattern})($|[_ -])"
        matches = F.rlike(lowered, F.lit(pattern))
        kind = F.when(matches, label) if kind is None else kind.when(matches, label)
    return (
        kind.when(unique_ratio > 0.95, "identifier")
        .when(unique_ratio < 0.05, "categorical")
        .when(numeric, "numeric")
        .otherwise("categorical")
    )


def semantic_types(df: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Profile-backed semantic type per column of ``df``.

    Distinct values are counted only for columns whose name says nothing.
    """
    catalogue = column_catalogue(df).drop("table")
    unnamed = [c for c in df.columns if keyword_type(c, word_boundary) is None]
    if unnamed:
        rows = df.agg(F.count(F.lit(1))).scalar()
        ratios = distinct_counts(df, unnamed).withColumn("rows", rows)
        ratios = ratios.select("column", F.try_divide(F.col("unique_count"), F.col("rows")).alias("unique_ratio"))
        catalogue = catalogue.join(ratios, "column", "left")
    else:
        catalogue = catalogue.withColumn("unique_ratio", F.lit(None).cast("double"))
    kind = semantic_type(F.col("column"), F.coalesce("unique_ratio", F.lit(0.0)), F.col("numeric"), word_boundary)
    return catalogue.select("ordinal", "column", "dtype", kind.alias("semantic_type"))


def coarse_types(df: DataFrame) -> DataFrame:
    """date, numeric, categorical or text per column; numeric types are tested first."""
    texts = [f.name for f in df.schema.fields if not is_numeric(f.dataType) and not is_temporal(f.dataType)]
    catalogue = column_catalogue(df).drop("table")
    if texts:
        values = unpivot_text(df, texts).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        parsed = dates.parse_timestamp(F.col("value"))
        facts = values.groupBy("column").agg(
            F.sum("n").alias("rows"),
            F.count("value").alias("unique_count"),
            F.count_if(F.col("value").isNotNull() & parsed.isNull()).alias("unparsed"),
        )
        catalogue = catalogue.join(facts, "column", "left")
    else:
        catalogue = catalogue.select(
            "*", *[F.lit(None).cast("long").alias(c) for c in ("rows", "unique_count", "unparsed")]
        )
    kind = (
        F.when(F.col("numeric"), "numeric")
        .when(F.col("temporal") | ((F.col("unparsed") == 0) & (F.col("unique_count") > 0)), "date")
        .when(F.try_divide(F.col("unique_count"), F.col("rows")) < 0.2, "categorical")
        .otherwise("text")
    )
    return catalogue.select("ordinal", "column", kind.alias("coarse_type"))


def infer_date_formats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each text column the first of nine formats that parses every non-null value."""
    aggregates = []
    for i, column in enumerate(columns):
        text = F.col(f"`{column}`")
        aggregates.append(F.count(text).alias(f"n{i}"))
        for j, (_, pattern) in enumerate(dates.COLUMN_FORMATS):
            failed = text.isNotNull() & dates.parse_with(text, pattern).isNull()
            aggregates.append(F.count_if(failed).alias(f"f{i}_{j}"))

    def result(i: int, column: str) -> Column:
        fits = [
            F.when((F.col(f"n{i}") > 0) & (F.col(f"f{i}_{j}") == 0), label)
            for j, (label, _) in enumerate(dates.COLUMN_FORMATS)
        ]
        return F.struct(F.lit(column).alias("column"), F.coalesce(*fits).alias("format"))

    wide = df.agg(*aggregates)
    return wide.select(F.inline(F.array(*[result(i, c) for i, c in enumerate(columns)])))


def time_columns(df: DataFrame) -> DataFrame:
    """Which column carries time: a time word in the name and over half of the rows parse;
    failing that, the first column of a date or timestamp type."""
    fields = df.schema.fields
    named = [f for f in fields if any(w in f.name.lower() for w in TIME_WORDS)]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(named):
        cell = F.col(f"`{field.name}`")
        good = cell if is_temporal(field.dataType) else dates.parse_timestamp(cell)
        aggregates.append(F.count(good).alias(f"p{i}"))
    first_named = [F.when(F.col(f"p{i}") > F.col("rows") * 0.5, f.name) for i, f in enumerate(named)]
    first_typed = [F.lit(f.name) for f in fields if is_temporal(f.dataType)][:1]
    choice = F.coalesce(*(first_named + first_typed)) if first_named or first_typed else F.lit(None).cast("string")
    return df.agg(*aggregates).select(choice.alias("time_column"))


def metric_columns(catalogue: DataFrame) -> DataFrame:
    """Columns offered for formulas: numeric ones, and countable ones (all but dates)."""
    date_like = F.rlike(F.lower("column"), F.lit("|".join(DATE_LIKE_WORDS))) | F.col("temporal")
    return catalogue.withColumn("countable", ~date_like)


def time_coverage(df: DataFrame, when: str, unit: str = "month", minimum: int = 2) -> DataFrame:
    """Number of distinct months or weeks, and whether it reaches ``minimum``."""
    # Grouping first leaves one row per period and task before the shuffle.
    periods = df.where(F.col(when).isNotNull()).groupBy(dates.period_start(F.col(when), unit).alias("p")).agg(
        F.lit(1).alias("one")
    )
    count = F.count("p")
    return periods.agg(F.lit(unit).alias("unit"), count.alias("periods"), (count >= minimum).alias("enough"))


def validate_numeric(df: DataFrame) -> DataFrame:
    """One row per numeric column with its first problem, if any."""
    columns = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    aggregates = []
    for i, column in enumerate(columns):
        cell = F.col(f"`{column}`")
        missing = cell.isNull() | F.isnan(cell.cast("double"))
        aggregates += [F.count_if(missing).alias(f"m{i}"), F.count_if(cell < 0).alias(f"g{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("missing"),
            F.col(f"g{i}").alias("negative"),
            F.when(F.col(f"m{i}") > 0, "contains missing values")
            .when(F.col(f"g{i}") > 0, "contains negative values")
            .alias("problem"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def validate_dates(df: DataFrame, column: str, order_by: str, examples: int = 5) -> DataFrame:
    """Number of rows whose date does not parse, with the first few as examples."""
    parsed = df.select(order_by, F.col(column).cast("string").alias("value"), dates.parse_timestamp(F.col(column)).alias("_d"))
    bad = parsed.where(F.col("_d").isNull())
    first = bad.orderBy(order_by).limit(examples).select(order_by, "value")
    shown = first.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(order_by, "value"))),
                lambda r: F.coalesce(r.getField("value"), F.lit("null")),
            ),
            ", ",
        )
    ).scalar()
    total = parsed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_d").isNull()).alias("invalid"))
    return total.select("rows", "invalid", (F.col("invalid") == 0).alias("valid"), shown.alias("examples"))


def preview(df: DataFrame, order_by: str, rows: int = 5) -> DataFrame:
    """The first rows as text, with nulls shown as empty."""
    head = df.orderBy(order_by).limit(rows)
    return head.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def sample_values(df: DataFrame, order_by: str, values: int = 3, columns: int | None = None) -> DataFrame:
    """The first non-null values of every column (or the first ``columns``), in row order."""
    chosen = df.columns[:columns]
    keyed = df.select(F.col(order_by).alias("_o"), *chosen)
    cells = unpivot_text(keyed, chosen, keep=["_o"]).where(F.col("value").isNotNull())
    order = Window.partitionBy("column").orderBy("_o", "value")
    ranked = cells.withColumn("position", F.row_number().over(order)).where(F.col("position") <= values)
    return ranked.select("column", "position", "value")

