"""Exact quantiles per key that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.operators.lookup import fits_broadcast, join_measured
from tillscope.session import durable


# Up to so many values in all, Spark's own exact percentile holds them without trouble.
SMALL_ROWS = 1_000_000
# Sub-ranges an enclosure is cut into before anything is sorted.
PIECES = 256


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per key: ``n`` non-null values and linearly interpolated ``q0, q1, ...``."""
    return measured_quantiles(df, keys, value, probs, accuracy)[0]


def measured_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
) -> tuple[DataFrame, bool]:
    """Exact quantiles, and whether a table of their keys was found small enough to broadcast.

    ``probs`` ascend. Null keys, nulls and NaN are left out.

    1. A mergeable sketch gives, per key, values that enclose each wanted rank.
    2. A second pass counts the rows between the enclosures and keeps, as
       (value, count), only those inside: about ``4 / accuracy`` of the rows.
    3. The enclosures are cut into equal pieces; counts per piece say which
       pieces hold a wanted rank, and only those are sorted.

    Rows are only ever combined map-side, so a key with a third of all rows
    costs what its rows cost to scan, and no task sorts more than one piece.
    Where step 1 counts no more than ``SMALL_ROWS`` values, Spark's ``percentile``
    gives the same numbers with fewer jobs, and its memory is bounded by that count.
    """
    found, small = _quantiles(df, keys, value, probs, accuracy)
    # The sketch guarantees its enclosures; should a rank lie outside all the same, wider ones give it.
    while accuracy > 1 and found.where("_missed").limit(1).count():
        accuracy //= 16
        found, small = _quantiles(df, keys, value, probs, max(accuracy, 1))
    return found.drop("_missed"), small


def _quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int) -> tuple[DataFrame, bool]:
    """The quantiles in shared storage, with ``_missed`` where a rank lay outside its enclosure."""
    by = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())

    margin = 2.0 / accuracy
    edges = [edge for p in probs for edge in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", edges, accuracy).alias("_e"),
    )
    sketch = durable(sketch)
    small = fits_broadcast(sketch) if keys else True
    if (sketch.agg(F.sum("_n")).first()[0] or 0) <= SMALL_ROWS:
        exact = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        return durable(exact.select(*keys, "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))], F.lit(False).alias("_missed"))), small
    if keys:
        if not small:  # equal rows are one, so that a hot key spreads over the salts of the join
            rows = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w"))
        placed = join_measured(rows, sketch, by, small)
    else:
        only = sketch.select(F.struct("_n", "_e")).scalar()
        placed = rows.withColumns({"_n": only.getField("_n"), "_e": only.getField("_e")})

    # An enclosure is known by how many enclosures lie wholly below it.
    below = sum((F.col("_v") > F.col("_e")[2 * i + 1]).cast("int") for i in range(len(probs)))
    weight = F.col("_w") if "_w" in placed.columns else F.lit(1).alias("_w")
    placed = placed.select(*by, "_n", "_v", weight, below.alias("_slot"), "_e").select(
        *by, "_n", "_v", "_w", "_slot", F.get("_e", F.col("_slot") * 2).alias("_low"), F.get("_e", F.col("_slot") * 2 + 1).alias("_high")
    )
    inside = F.coalesce(F.col("_v") >= F.col("_low"), F.lit(False))
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    piece = F.coalesce(F.floor((F.col("_v") - F.col("_low")) / width * PIECES), F.lit(0)).cast("int")
    # Kept in shared storage: a few rows per key, needed twice below, and
    # otherwise each use would scan the raw rows again.
    cells = durable(
        placed.groupBy(
            *by,
            "_n",
            "_slot",
            F.when(inside, piece).otherwise(-1).alias("_piece"),
            F.when(inside, F.col("_v")).alias("_exact"),
        )
        .agg(F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .drop("_exact")
    )

    positions = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ranks = [rank for position in positions for rank in (F.floor(position), F.ceil(position))]
    place = [*by, "_n", "_slot", "_piece"]
    in_order = Window.partitionBy(*by).orderBy("_slot", "_piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cells.groupBy(*place).agg(F.sum("_c").alias("_rows")).withColumn("_end", F.sum("_rows").over(in_order))
    pieces = pieces.withColumn("_before", F.col("_end") - F.col("_rows"))
    wanted = reduce(lambda a, b: a | b, [(F.col("_before") <= r) & (r < F.col("_end")) for r in ranks])
    pieces = pieces.where(wanted).select(*place, "_before")

    sorted_cells = Window.partitionBy(*place).orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.join(pieces, place).withColumn("_until", F.sum("_c").over(sorted_cells) + F.col("_before"))
    ranked = ranked.withColumn("_from", F.col("_until") - F.col("_c"))

    def at_rank(rank):
        # A rank next to an enclosure is the first or last value between two of
        # them; deeper inside, the sketch would have broken its guarantee.
        hit = (F.col("_from") <= rank) & (rank < F.col("_until"))
        value = F.when(rank == F.col("_from"), F.col("_lo")).when(
            (rank == F.col("_until") - 1) | (F.col("_lo") == F.col("_hi")), F.col("_hi")
        )
        return F.max(F.when(hit, value))

    found = ranked.groupBy(*by, F.col("_n").alias("n")).agg(*[at_rank(r).alias(f"_r{i}") for i, r in enumerate(ranks)])
    quantiles = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        lower, upper = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        quantiles.append((lower + (upper - lower) * (position - F.floor(position))).alias(f"q{i}"))
    missed = F.lit(False)
    for i in range(len(ranks)):
        missed = missed | F.col(f"_r{i}").isNull()
    return durable(found.select(*keys, "n", *quantiles, missed.alias("_missed"))), small
