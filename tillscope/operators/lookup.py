"""Attach per-key statistics to rows without trusting the key distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.session import durable

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(table: DataFrame) -> bool:
    """Measure a materialised table: rows, and bytes of its values as text."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns),
        F.lit(8 * len(table.columns)),
    )
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= MAX_BROADCAST_ROWS and size["bytes"] <= MAX_BROADCAST_BYTES


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], salts: int = 64) -> DataFrame:
    """Left-join one-row-per-key ``stats`` to ``rows``; unmatched and null keys keep nulls.

    The statistics are computed once into shared storage and measured. Small
    ones are broadcast, so the wide rows never shuffle. Larger ones are
    replicated ``salts`` times and joined on (key, salt): a key that holds a
    third of the rows is then spread over ``salts`` partitions.
    """
    stats = durable(stats)
    return join_measured(rows, stats, keys, fits_broadcast(stats), salts)


def join_measured(rows: DataFrame, stats: DataFrame, keys: Sequence[str], small: bool, salts: int = 64) -> DataFrame:
    """The same join where a table with these keys has been measured before."""
    if small:
        return rows.join(F.broadcast(stats), list(keys), "left")
    return salted_join(rows, stats, keys, salts)


def salted_join(rows: DataFrame, stats: DataFrame, keys: Sequence[str], salts: int) -> DataFrame:
    # Rows that are equal in every column differ in their partition, which a repeated task has again.
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], "left").drop("_salt")
