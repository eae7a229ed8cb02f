"""Number columns: safe values and display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def fixed(value: Column, digits: int, grouped: bool = True, signed: bool = False) -> Column:
    """Fixed-point text, half-even, with optional thousands commas and plus sign."""
    text = F.format_number(value.cast("double"), digits)
    if not grouped:
        text = F.replace(text, F.lit(","), F.lit(""))
    if signed:
        text = F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text)
    return text


def rounded(value: Column, digits: int) -> Column:
    """Round half-even on the exact binary value.

    Spark's round() works on the shortest decimal text instead, which differs
    on near-ties. Meant for aggregated results, not for raw rows.
    """
    return fixed(value, digits, grouped=False).try_cast("double")


def abbreviate(value: Column) -> Column:
    """Axis label: 1.2M, 3.4K or a whole number."""
    magnitude = value.cast("double")
    return (
        F.when(magnitude >= 1e6, F.concat(fixed(magnitude / 1e6, 1, grouped=False), F.lit("M")))
        .when(magnitude >= 1e3, F.concat(fixed(magnitude / 1e3, 1, grouped=False), F.lit("K")))
        .otherwise(fixed(magnitude, 0, grouped=False))
    )


def null_nonfinite(df: DataFrame) -> DataFrame:
    """Make a table safe to serialise: floats finite or NULL at any depth, times as ISO text."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _clean(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
        return F.when(bad, None).otherwise(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_clean(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column
