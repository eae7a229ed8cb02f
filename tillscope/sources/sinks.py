"""Results as JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.numbers import null_nonfinite


def kpi_summary(panel: DataFrame) -> DataFrame:
    """One JSON object of KPI values per period; failed metrics stay as null."""
    entries = F.array_sort(F.collect_list(F.struct("kpi", F.col("value").cast("decimal(38,4)").alias("value"))))
    return panel.groupBy("period").agg(
        F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("summary")
    )


def pack_summary(pack: DataFrame, category: str = "category") -> DataFrame:
    """One JSON object per period of a whole pack: numbers, labels as text, and an object per categorical metric.

    Failed metrics stay as null. Entries are ordered by name.
    """
    number = F.coalesce(F.col("value").cast("decimal(38,4)").cast("string"), F.lit("null"))
    # An array of one text is the text in JSON between brackets.
    text = lambda column: F.regexp_extract(F.to_json(F.array(column)), r"(?s)^\[(.*)\]$", 1)
    parts = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col(category).isNotNull(), F.struct(F.col(category), number.alias("n"))))),
                    lambda p: F.concat(text(p.getField(category)), F.lit(":"), p.getField("n"))), ","
    )
    whole = F.coalesce(F.when(F.max("label").isNotNull(), text(F.max("label"))), F.max(F.when(F.col(category).isNull(), number)))
    kpis = pack.groupBy("period", "kpi").agg(
        F.when(F.count(category) > 0, F.concat(F.lit("{"), parts, F.lit("}"))).otherwise(whole).alias("content")
    )
    entries = F.array_sort(F.collect_list(F.struct("kpi", "content")))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(text(e.getField("kpi")), F.lit(":"), e.getField("content"))), ",")
    return kpis.groupBy("period").agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("summary"))


def as_json(df: DataFrame, column: str = "record") -> DataFrame:
    """Every row as one JSON object with nulls kept and non-finite numbers null."""
    safe = null_nonfinite(df)
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias(column))


def write_report(df: DataFrame, path: str, compression: str = "none") -> None:
    """Write report rows as JSON lines, compressed by a codec Spark's readers know."""
    null_nonfinite(df).write.option("ignoreNullFields", False).json(path, compression=compression)
