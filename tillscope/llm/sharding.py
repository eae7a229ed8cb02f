"""Balanced shards by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. The classic rule takes
groups by falling size and gives each to the least-loaded shard, kept in a heap.
A corpus has far too many groups for one heap, so only groups above
``total / items`` bytes are scheduled one by one: fewer than ``items`` groups can
be that large. All smaller groups fall into ``items`` bundles by hash, and a
bundle is scheduled like a group. The heap therefore never sees more than
``2 * items`` entries, whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.llm.registry import query
from tillscope.session import written

ROWS_PER_CELL = 50_000, 256  # at most and at least; between them one cell in `items` parts of all rows


def schedule(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest first, each item to the least-loaded shard; ties by item name and shard number."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        placed[item] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def lpt_shards(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", items: int = 8192
) -> DataFrame:
    """Every row with its shard and its slot in that shard, shards of near equal bytes.

    Returns id, size, text_crc32, law, shard, slot, grown_shard. Size is the UTF-8
    bytes of the text plus 8. A null text counts as empty and groups with empty
    texts; null and repeated ids are rows like any other. Slots run from 0 without
    gaps, ordered by group, then id. An empty table gives no rows. Other columns
    are not read, whatever their names.

    Hot groups: rows are cut into small cells (by a hash of the id inside a group),
    cells are counted and summed up, and only a cell is sorted.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    digest = F.md5(text)
    rows = written(
        docs.select(
            F.col(id_column).alias("_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            digest.alias("_digest"),
            F.concat(F.lit("b"), F.pmod(F.xxhash64(digest), F.lit(items)).cast("string")).alias("_bundle"),
            F.xxhash64(F.col(id_column).cast("string")).alias("_spread"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("_digest", "_bundle").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_n")), "shard-groups")
    totals = groups.agg(F.sum("_bytes").alias("bytes"), F.sum("_n").alias("rows")).first()
    total = totals["bytes"] or 0
    per_cell = min(ROWS_PER_CELL[0], max(ROWS_PER_CELL[1], (totals["rows"] or 0) // items))
    large = F.col("_bytes") * F.lit(items) > F.lit(total)
    # At most ``items`` groups exceed total / items, and there are ``items`` bundles: both lists are bounded.
    loads = (
        groups.groupBy(F.when(large, F.col("_digest")).otherwise(F.col("_bundle")).alias("_item"))
        .agg(F.sum("_bytes").alias("_bytes"), F.sum("_n").alias("_n"))
        .collect()
    )
    placed = schedule([(r["_item"], r["_bytes"]) for r in loads], shards)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(
        [(r["_item"], placed[r["_item"]], -(-r["_n"] // per_cell)) for r in loads],
        "_item string, shard int, _cells long",
    )
    alone = F.broadcast(chosen.select(F.col("_item").alias("_digest"), F.col("shard").alias("_own"), F.col("_cells").alias("_own_cells")))
    shared = F.broadcast(chosen.select(F.col("_item").alias("_bundle"), F.col("shard").alias("_bundle_shard"), F.col("_cells").alias("_bundle_cells")))
    placed_rows = (
        rows.join(alone, "_digest", "left")
        .join(shared, "_bundle", "left")
        .select(
            "_id",
            "_size",
            "_crc",
            "_digest",
            F.coalesce("_own", "_bundle_shard").alias("shard"),
            F.when(F.col("_own").isNotNull(), F.col("_digest")).otherwise(F.col("_bundle")).alias("_item"),
            F.pmod(F.col("_spread"), F.coalesce("_own_cells", "_bundle_cells")).alias("_cell"),
        )
    )
    cells = placed_rows.groupBy("shard", "_item", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_item", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "_item", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_item", "_cell").orderBy("_digest", "_id")
    return (
        placed_rows.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_item", "_cell"])
        .select(
            F.col("_id").alias(id_column),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_start") + F.col("_place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


@query("op8_lpt_shards")
def op8_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of near equal bytes, equal texts together."""
    return lpt_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24)
