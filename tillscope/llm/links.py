"""Connected components of links, and all pairs inside components by bounded blocks.

Both work on narrow rows in Spark: nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.lookup import fits_broadcast
from tillscope.session import written


EDGES_PER_FILE = 250_000  # small tables are not spread over as many files as there are shuffle partitions


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); the root is the smallest node of its component.

    Alternating stars: every node ties its larger neighbours, then its smaller ones,
    to the smallest it knows. The number of rounds grows with the logarithm of the
    longest chain. Each round is written to shared storage, so lineage stays short and
    a lost executor costs one round; what the rows are joined with is written too, for
    Spark splits the rows of a hot node only where a plain shuffle meets a plain
    shuffle. Edges with a null end and loops are no edges.
    """
    edges = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    edges = written(edges.where("a > b").distinct(), "links")  # a is the larger end from here on
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        files = 1 + now[0] // EDGES_PER_FILE
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        smallest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files), "smallest")
        larger = written(both.where("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(files), "links")
        nearest = written(larger.groupBy("a").agg(F.min("b").alias("m")).coalesce(files), "smallest")
        smaller = larger.join(nearest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(smaller.unionByName(nearest.select("a", F.col("m").alias("b"))).where("a > b").distinct().coalesce(files), "links")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def in_blocks(members: DataFrame, block_rows: int) -> DataFrame:
    """Members (root, node, ...) with _group, _block, _one and _two, each group bounded, so that groups hold all pairs of a component.

    Small components share groups, whole. A component of more than ``block_rows`` is cut
    into blocks by hash, and each pair of blocks is a group: there rows of block _one
    meet rows of block _two, and all rows each other if the two are the same. In other
    groups _one is -1 and rows of one root meet each other.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    sizes = written(sizes, "component-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    large = written(sizes.where(F.col("_n") > block_rows).select("root", F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks")), "large-components")
    tied = members.join(F.broadcast(large) if fits_broadcast(large) else large, "root", "left")
    alone = F.col("_blocks").isNull()
    block = F.when(alone, -1).otherwise(F.pmod(F.xxhash64("node"), F.col("_blocks"))).cast("int")
    bins = max(1, 2 * total // block_rows)
    meets = F.when(alone, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    spread = tied.withColumn("_block", block).withColumn("_other", F.explode(meets))
    one, two = F.least("_block", "_other"), F.greatest("_block", "_other")
    home = F.when(alone, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", one, two))
    return spread.withColumn("_one", one).withColumn("_two", two).withColumn("_group", home).drop("_blocks", "_other")


def pair_masks(roots: np.ndarray, blocks: np.ndarray, one: np.ndarray, two: np.ndarray):
    """For each unit of a group the rows on its left and right side, and whether the sides are the same rows.

    Units are whole small components, or one pair of blocks of a large component.
    """
    labels = np.empty(len(roots), object)
    labels[:] = [(bytes(r) if isinstance(r, (bytes, bytearray)) else r, a, b) for r, a, b in zip(roots, one, two)]
    order = sorted(range(len(roots)), key=lambda i: (labels[i], i))
    start = 0
    for stop in range(1, len(order) + 1):
        if stop == len(order) or labels[order[stop]] != labels[order[start]]:
            rows = np.array(order[start:stop])
            _, a, b = labels[order[start]]
            if a == b:
                yield rows, rows, True
            else:
                yield rows[blocks[rows] == a], rows[blocks[rows] == b], False
            start = stop


def label_stars(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row reachable by the given links, for each of ``count`` rows."""
    labels = np.arange(count)
    while len(left):
        low = np.minimum(labels[left], labels[right])
        fresh = labels.copy()
        np.minimum.at(fresh, left, low)
        np.minimum.at(fresh, right, low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, labels):
            break
        labels = fresh
    return labels
