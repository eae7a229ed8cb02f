"""Canonical views over the star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources.tables import table

# Role -> (table it comes from, expression).
ROLES = {
    "selling_price": ("part", "cast(p_retailprice as decimal(12,2))"),
    "quantity": ("lineitem", "cast(l_quantity as smallint)"),
    "order_id": ("lineitem", "l_orderkey"),
    "discount_percent": ("lineitem", "cast(l_discount * 100 as decimal(5,2))"),
    "customer_id": ("orders", "o_custkey"),
    "category": ("part", "p_type"),
    "product": ("part", "p_name"),
    "channel": ("orders", "o_orderpriority"),
    "order_date": ("orders", "cast(o_orderdate as date)"),
}


# Table -> (its key, the line column that refers to it). Orders come last: where both joins are
# shuffled, lines then lie by order, and sums per order need no shuffle of their own.
KEYS = {"part": ("p_partkey", "l_partkey"), "orders": ("o_orderkey", "l_orderkey")}


def sales(spark: SparkSession, folder: str, roles: Sequence[str] = tuple(ROLES)) -> DataFrame:
    """Order lines with the asked roles; tables no role needs are not joined.

    Roles are computed on their own table, so that prices and dates are
    converted once per part and order and not once per line. A role that is a join
    key is named after the joins, so that Spark knows rows to lie by it.
    """

    def part_of(name: str, keys: Sequence[str]) -> DataFrame:
        mine = [F.expr(ROLES[r][1]).alias(r) for r in roles if ROLES[r][0] == name and ROLES[r][1] not in keys]
        return table(spark, folder, name).select(*[F.col(k) for k in keys], *mine)

    needed = [t for t in KEYS if any(ROLES[r][0] == t for r in roles)]
    references = [KEYS[t][1] for t in needed]
    lines = part_of("lineitem", references)
    for name in needed:
        key, reference = KEYS[name]
        lines = lines.join(part_of(name, [key]), F.col(reference) == F.col(key))
    return lines.select(*[F.col(ROLES[r][1]).alias(r) if ROLES[r][1] in references else F.col(r) for r in roles])


# Defects by key, written so that every SQL engine reads them alike.
MESSY = {
    "order_id": "o_orderkey",
    "customer_id": "o_custkey",
    "product_category": (
        "case when o_orderkey % 13 = 4 then null "
        "when o_orderkey % 3 = 0 then concat('  ', lower(o_orderpriority)) "
        "when o_orderkey % 3 = 1 then concat(upper(o_orderpriority), ' ') else o_orderpriority end"
    ),
    "purchase_amount": (
        "case when o_orderkey % 17 = 0 then null when o_orderkey % 23 = 1 then -o_totalprice "
        "when o_orderkey % 101 = 2 then cast(0 as double) when o_orderkey % 97 = 3 then o_totalprice * 100 "
        "else o_totalprice end"
    ),
    "quantity": (
        "case when o_orderkey % 31 = 5 then null when o_orderkey % 211 = 7 then cast(5000 as bigint) "
        "else 1 + o_orderkey % 50 end"
    ),
    "review_rating": (
        "case when o_orderkey % 19 = 3 then null when o_orderkey % 29 = 0 then cast(0 as double) "
        "when o_orderkey % 29 = 1 then cast(7 as double) else cast(1 + o_custkey % 5 as double) end"
    ),
    "payment_method": (
        "case when o_orderkey % 11 = 6 then null when o_orderkey % 3 = 0 then concat(' ', lower(o_orderstatus)) "
        "else o_orderstatus end"
    ),
}
# The order's day, 25 years later, in one of four formats or not a date at all.
MESSY_DATE = (
    "case o_orderkey % 5 when 0 then {iso} when 1 then {us} when 2 then {slash} when 3 then {dmy} "
    "else 'not a date' end"
)
_LATER = "add_months(cast(o_orderdate as date), 300)"


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing, negative, zero and huge amounts, untidy text, mixed dates
    and repeated rows. ``row_id`` is unique and orders the rows."""
    day = MESSY_DATE.format(
        **{
            name: f"date_format({_LATER}, '{pattern}')"
            for name, pattern in (
                ("iso", "yyyy-MM-dd"), ("us", "MM/dd/yyyy"), ("slash", "yyyy/MM/dd"), ("dmy", "dd-MM-yyyy"),
            )
        }
    )
    orders = table(spark, folder, "orders")
    # A repeated order is written out twice in the same pass.
    copies = F.explode(F.expr("if(o_orderkey % 50 = 0, array(0, 1), array(0))"))
    return orders.withColumn("_copy", copies).select(
        (F.col("o_orderkey") * 2 + F.col("_copy")).alias("row_id"),
        *[F.expr(sql).alias(name) for name, sql in MESSY.items()],
        F.expr(day).alias("order_date"),
    )


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose day is missing for two ids in seven."""
    return table(spark, folder, "events").select(
        "event_id", F.expr("case when event_id % 7 in (0, 1) then null else cast(ts as date) end").alias("event_date")
    )


# Column names of made-up datasets, picked by key.
NAME_WORDS = (
    "SalesAmount", "order-id", "unit_price", "CustomerId", "ROI", "notes", "DATE", "Invoice No", "qty",
    "purchase_value", "Region", "payment method", "total sales (usd)", "updated_at", "discount%", "Product-Category",
)
NAME_SQL = (
    "case (event_id * 7 + user_id) % 16 "
    + " ".join(f"when {i} then '{word}'" for i, word in enumerate(NAME_WORDS))
    + " end"
)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue of as many datasets as there are events by eight, eight columns each."""
    return table(spark, folder, "events").select(
        F.expr("event_id div 8").alias("table"),
        F.expr("cast(event_id % 8 as int)").alias("ordinal"),
        F.expr(f"case when event_id % 3 = 0 then concat(event_type, '_', {NAME_SQL}) else {NAME_SQL} end").alias("column"),
        F.expr("event_id % 2 = 0").alias("numeric"),
        F.expr("event_id % 9 = 4").alias("temporal"),
        F.expr("(event_id % 101) / 100").alias("unique_ratio"),
    )


# Role a column of the catalogue is mapped to.
ROLE_SQL = (
    "case event_id % 8 when 0 then 'selling_price' when 1 then 'quantity' when 2 then 'order_id' "
    "when 3 then 'category' when 4 then 'channel' when 5 then 'product' when 6 then 'discount_percent' "
    "else 'other' end"
)


def role_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Which column fills which role of each dataset; some roles stay empty."""
    return table(spark, folder, "events").select(
        F.expr("event_id div 8").alias("dataset"),
        F.expr(ROLE_SQL).alias("role"),
        F.expr("case when (event_id * 13 + user_id) % 5 <> 0 then event_type end").alias("column"),
    )
