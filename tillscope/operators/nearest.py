"""Exact best match by cosine, skipping cells of candidates that cannot hold it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.session import written

MAX_PIVOTS = 1024
SAMPLE = 4  # candidates drawn for each pivot
QUERY_BLOCK, CANDIDATE_BLOCK = 8_000, 4_000
GROUP_BYTES = 16 * 1024 * 1024  # of the vectors on either side of a task
GROUPS, BLOCKS_PER_CORE = 8, 4  # groups of candidates, and blocks of queries, where they are smaller than that
_SLACK = 1e-6  # of an angle: the arc cosine of a cosine near one is that imprecise
_CLOSE = 1e-12  # of a cosine: products of blocks of other shapes differ by less
_SINGLE = 2.0**-24  # of a number: what rounding to single precision changes at most


class Matches(NamedTuple):
    """``rows``: id, match and score of every query. ``work``: pairs (with different candidates), scored and share of the pairs multiplied."""

    rows: DataFrame
    work: DataFrame


def _units(vectors: pd.Series) -> np.ndarray:
    matrix = np.vstack(vectors.to_numpy()).astype(np.float64)
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _angles(units: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ others.T, -1.0, 1.0))


def _vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v, size) of the vectors that have a direction: finite, not all zero."""
    rows = df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(finite, F.lit(False))).withColumn("size", F.size("v"))


def _spread(units: np.ndarray, count: int) -> np.ndarray:
    """So many of the vectors, each the one farthest from those before it; fewer if the rest repeats them."""
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < count and nearest.min() < 1 - _CLOSE:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _lower_bounds(angles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest angle a query can have to a vector of each cell, by its angle to the cell's pivot."""
    return np.maximum(0.0, np.maximum(angles - high, low - angles))


def _best_of_block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """The best candidate of each query of a block; pairs close to the best are computed one by one, so that equal ones are equal in every block."""
    if q.empty or c.empty:
        return pd.DataFrame({"id": q["id"].iloc[:0], "score": pd.Series([], dtype=float), "candidate": c["id"].iloc[:0]})
    c = c.sort_values("id")
    ids, others = c["id"].to_numpy(), np.vstack(c["u"].to_numpy())
    parts = []
    for start in range(0, len(q), 1024):
        part = q.iloc[start : start + 1024]
        units = np.vstack(part["u"].to_numpy())
        scores = units @ others.T
        rows, columns = np.nonzero(scores >= scores.max(axis=1, keepdims=True) - _CLOSE)
        exact = np.concatenate([(units[rows[i : i + 4096]] * others[columns[i : i + 4096]]).sum(axis=1) for i in range(0, len(rows), 4096)])
        order = np.lexsort((columns, -exact, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        parts.append(pd.DataFrame({"id": part["id"].to_numpy()[rows[first]], "score": exact[first], "candidate": ids[columns[first]]}))
    return pd.concat(parts)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.list_flatten(vectors)).reshape(len(vectors), -1)


def _grouped(ranges: pd.DataFrame, pivots: np.ndarray | None, fitting: int) -> pd.DataFrame:
    """The cells of one length with the first of their groups and their number of groups; cells near each other share one."""
    home = ranges["cell"].to_numpy()
    if pivots is not None:
        home = (pivots[home] @ pivots[:32].T).argmax(axis=1)
    ranges = ranges.iloc[np.lexsort((ranges["cell"], home))].reset_index(drop=True)
    first, parts, group, filled = [], [], 0, 0
    for n in ranges["n"]:
        if filled and filled + n > fitting:
            group, filled = group + 1, 0
        first.append(group)
        parts.append(max(1, -(-int(n) // fitting)))
        filled += n
        if parts[-1] > 1:
            group, filled = group + parts[-1], 0
    return ranges.assign(first=first, parts=parts)


def _needed(low: np.ndarray, scores: np.ndarray, own: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which cells may hold a candidate as good as the score a query has; its first cell has been searched."""
    reach = np.arccos(np.clip(scores, -1.0, 1.0)) + _SLACK
    return (low <= reach[:, None]) & (names[None, :] != own[:, None])


def _improve(units: np.ndarray, others: np.ndarray, rank: np.ndarray, rows: np.ndarray, start: int, stop: int, best: np.ndarray, found: np.ndarray) -> None:
    """Put the best of the candidates from start to stop into ``best`` and ``found`` of these queries; equal scores go to the lowest rank.

    Products in single precision, and the bound of their error, leave out queries that gain nothing from a block. Products
    in double choose the pairs of the others; their scores are computed one by one, so that equal ones are equal in every block.
    """
    error = (units.shape[1] + 4) * _SINGLE + _CLOSE  # a rounding for each factor, product and sum of unit vectors
    for at in range(start, stop, 2048):
        until = min(stop, at + 2048)
        asked = rows
        if len(rows) and best[rows].min() > -np.inf:
            rough = others[at:until].astype(np.float32).T
            chunks = [rows[i : i + 1024] for i in range(0, len(rows), 1024)]
            asked = np.concatenate([r[(units[r].astype(np.float32) @ rough).max(axis=1) >= best[r] - error] for r in chunks])
        for i in range(0, len(asked), 512):
            asking = asked[i : i + 512]
            scores = units[asking] @ others[at:until].T
            top = scores.max(axis=1)
            hit = np.flatnonzero(top >= best[asking] - _CLOSE)
            if not len(hit):
                continue
            r, c = np.nonzero(scores[hit] >= top[hit, None] - _CLOSE)
            q, c = asking[hit[r]], at + c
            exact = np.concatenate([(units[q[j : j + 4096]] * others[c[j : j + 4096]]).sum(axis=1) for j in range(0, len(q), 4096)])
            order = np.lexsort((rank[c], -exact, q))
            order = order[np.unique(q[order], return_index=True)[1]]
            q, c, exact = q[order], c[order], exact[order]
            earlier = (found[q] < 0) | (rank[c] < rank[found[q]])
            better = (exact > best[q]) | ((exact == best[q]) & earlier)
            best[q[better]], found[q[better]] = exact[better], c[better]


def _direct(left: DataFrame, right: DataFrame, query_block: int, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Best candidates where all of them fit one block, and the pairs by length."""
    blocks = max(1, -(-left.count() // query_block))

    def best(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        for side in (q, c):
            side["u"] = list(_units(side["v"])) if len(side) else None
        return _best_of_block(key, q, c)

    q = left.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    c = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = q.groupBy("size", "qb").cogroup(c.groupBy("size", "qb"))
    counts = left.groupBy("size").agg(F.count(F.lit(1)).alias("a")).join(right.groupBy("size").agg(F.count(F.lit(1)).alias("b")), "size")
    return pairs.applyInPandas(best, f"id {kinds[0]}, score double, candidate {kinds[1]}"), counts.select((F.col("a") * F.col("b")).alias("pairs"))


def pruned_match(
    queries: DataFrame,
    candidates: DataFrame,
    id_column: str,
    vector: str,
    threshold: float,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    max_pivots: int = MAX_PIVOTS,
) -> Matches:
    """The most similar candidate of every query by cosine, exactly; equals go to the smallest id.

    Candidates lie in cells around pivots (twice the square root of their number,
    ``max_pivots`` at most), which are spread as far as can be over a sample of ``SAMPLE``
    times as many. A query first meets the cell that may hold the nearest
    vector; the angle found there, and the triangle inequality between query, pivot and
    the cell's range of angles, rule out most other cells, and only the rest is
    multiplied. Cells lie in groups of ``GROUP_BYTES`` at most: a query goes once to each
    group that has a cell it needs, and a task multiplies a block of queries with the cells
    of a group, cell by cell. So a vector is sent as often as the other side has groups,
    however many cells are needed. Equal candidates are one, under the smallest id.
    Candidates that fit one block are all multiplied. Vectors of unlike length have no score with each other, and vectors that
    are null, zero or not finite have none at all: such queries, and those without any
    candidate of their length, have neither match nor score. A match below the threshold
    is not accepted but its score is returned. Ids may be of any type that has an order;
    queries that repeat an id share one result.
    """
    spark = queries.sparkSession
    kinds = [df.schema[id_column].dataType.simpleString() for df in (queries, candidates)]
    left, right = _vectors(queries, id_column, vector), _vectors(candidates, id_column, vector)
    right = written(right.groupBy("v", "size").agg(F.min("id").alias("id")).select("id", "v", "size"), "candidates")
    number = right.count()
    top_of = lambda scored: scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("order"), "candidate")).alias("top"))

    def answered(top: DataFrame) -> DataFrame:
        score = -F.col("top.order")
        matched = top.select("id", F.when(score >= threshold, F.col("top.candidate")).alias("match"), score.alias("score"))
        return queries.select(F.col(id_column).alias("id")).join(matched, "id", "left").withColumnRenamed("id", id_column)

    def reported(work: DataFrame) -> DataFrame:
        sums = work.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "scored")])
        return sums.withColumn("share", F.try_divide("scored", "pairs"))

    if number <= candidate_block:
        scored, pairs = _direct(left, right, query_block, kinds)
        return Matches(answered(top_of(scored)), reported(pairs.withColumn("scored", F.col("pairs"))))
    wanted = min(max_pivots, max(1, round(2 * number**0.5)))
    sample = right.orderBy(F.xxhash64("id", "v")).limit(SAMPLE * wanted).collect()
    pivots = {}
    for size in {r["size"] for r in sample}:
        units = _units(pd.Series([np.array(r["v"]) for r in sample if r["size"] == size]))
        pivots[size] = _spread(units, max(1, round(wanted * len(units) / len(sample))))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                units = _units(part["v"])
                cell, angle = np.zeros(len(part), np.int32), np.zeros(len(part))
                if size in pivots:
                    angles = _angles(units, pivots[size])
                    cell = angles.argmin(axis=1).astype(np.int32)
                    angle = angles[np.arange(len(part)), cell]
                yield pd.DataFrame({"id": part["id"], "size": part["size"], "cell": cell, "angle": angle, "u": list(units)})

    held = written(right.mapInPandas(placed, f"id {kinds[1]}, size int, cell int, angle double, u array<double>"), "cells")
    # As many rows as pivots, and one more for each length none of them has.
    ranges = held.groupBy("size", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).toPandas()
    # A group is whole cells, or part of a cell that is too large for one.
    largest = max(1, GROUP_BYTES // (8 * int(ranges["size"].max(skipna=True)))) if len(ranges) else 1
    fitting = min(largest, max(candidate_block, -(-number // GROUPS)))
    cells = {size: _grouped(part, pivots.get(size), fitting) for size, part in ranges.groupby("size")}
    known, first = [], 0
    for size, part in cells.items():
        part["first"] += first
        first = int((part["first"] + part["parts"]).max())
        known += [(int(size), int(r.cell), int(r.first), int(r.parts)) for r in part.itertuples()]
    placement = F.broadcast(spark.createDataFrame(known, "size int, cell int, first int, parts int"))
    every = lambda start, n: F.explode(F.sequence(start, start + n - 1))
    grouped = held.join(placement, ["size", "cell"]).select("id", "size", "cell", "u", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"))

    def bounds(units: np.ndarray, size: int, among: pd.DataFrame) -> np.ndarray:
        if size not in pivots:
            return np.zeros((len(units), len(among)))
        return _lower_bounds(_angles(units, pivots[size][among["cell"].to_numpy()]), among["low"].to_numpy(), among["high"].to_numpy())

    def first_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                if size in cells:
                    units = _units(part["v"])
                    nearest = bounds(units, size, cells[size]).argmin(axis=1)
                    yield pd.DataFrame({"id": part["id"], "size": part["size"], "cell": cells[size]["cell"].to_numpy()[nearest].astype(np.int32), "u": list(units)})

    def other_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every group that has a cell it may need."""
        for batch in batches:
            lengths = batch["size"].to_numpy()
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                among = cells[size]
                low = bounds(_matrix(part["u"]), size, among)
                needed = _needed(low, part["score"].to_numpy(), part["cell"].to_numpy(), among["cell"].to_numpy())
                starts = np.flatnonzero(np.diff(among["first"].to_numpy(), prepend=-1))
                for start, asking in zip(starts, np.logical_or.reduceat(needed, starts, axis=1).T, strict=True):
                    rows = part.take(pa.array(np.flatnonzero(asking)))
                    for group in range(among["first"].iloc[start], among["first"].iloc[start] + among["parts"].iloc[start]):
                        if rows.num_rows:
                            yield rows.append_column("part", pa.array(np.full(rows.num_rows, group, np.int32)))

    def best_of_group(q: pa.Table, c: pa.Table) -> pa.Table:
        """The best candidates that queries find in the cells of a group they need, and the pairs multiplied on the first row."""
        shape = pa.schema([("id", q.schema.field("id").type), ("score", pa.float64()), ("candidate", c.schema.field("id").type), ("scored", pa.int64())])
        if not q.num_rows or not c.num_rows:
            return shape.empty_table()
        c = c.sort_by("cell")
        size, units, others, names = c["size"][0].as_py(), _matrix(q["u"]), _matrix(c["u"]), c["cell"].to_numpy()
        rank = np.empty(len(others), np.int64)
        rank[pc.array_sort_indices(c["id"].combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(others))
        own = q["cell"].to_numpy()
        score = q["score"].to_numpy() if q["score"].null_count == 0 else None  # none: the first cells are searched
        starts = np.flatnonzero(np.diff(names, prepend=-1))
        among = cells[size].set_index("cell", drop=False).loc[names[starts]]
        low = None if score is None else bounds(units, size, among)
        best = np.full(len(units), -np.inf) if score is None else score.copy()
        found = np.full(len(units), -1)
        scored = 0
        for i, (start, stop) in enumerate(zip(starts, [*starts[1:], len(others)], strict=True)):
            if score is None:
                rows = np.flatnonzero(own == names[start])
            else:
                rows = np.flatnonzero(_needed(low[:, i : i + 1], best, own, names[start : start + 1])[:, 0])
            scored += len(rows) * int(stop - start)
            _improve(units, others, rank, rows, start, stop, best, found)
        rows = np.flatnonzero(found >= 0)
        counted = np.zeros(max(1, len(rows)), np.int64)
        counted[0] = scored
        if not len(rows):
            return pa.table([pa.nulls(1, f.type) for f in shape][:3] + [pa.array(counted)], schema=shape)
        return pa.table([q["id"].take(pa.array(rows)), pa.array(best[rows]), c["id"].take(pa.array(found[rows])), pa.array(counted)], schema=shape)

    def best(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The best candidate of every query in the groups it asks, and the pairs multiplied for it."""
        asked = written(asked, "asked")
        uses = asked.groupBy("part").agg(F.count(F.lit(1)).alias("asking"))
        groups = uses.count()
        # Blocks of queries that keep every core busy; a block of either side fits a task.
        rows = min(largest, max(query_block, -(-asked.count() // max(1, BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism))))
        table = F.broadcast(written(uses.withColumn("query_blocks", F.ceil(F.col("asking") / rows).cast("int")).drop("asking"), "blocks")) if groups else None
        if table is None:
            return spark.createDataFrame([], f"id {kinds[0]}, score double, candidate {kinds[1]}"), spark.createDataFrame([], "scored long")
        q = asked.join(table, "part").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int"))
        c = grouped.join(table, "part").withColumn("qb", every(F.lit(0), F.col("query_blocks")))
        pairs = q.select("part", "qb", "id", "cell", "score", "u").groupBy("part", "qb").cogroup(c.select("part", "qb", "id", "size", "cell", "u").groupBy("part", "qb"))
        scored = written(pairs.applyInArrow(best_of_group, f"id {kinds[0]}, score double, candidate {kinds[1]}, scored long"), "scored")
        top = top_of(scored.where(F.col("score").isNotNull())).select("id", (-F.col("top.order")).alias("score"), "top.candidate")
        return written(top, "best"), scored.select("scored")

    distinct = written(left.mapInPandas(first_cells, f"id {kinds[0]}, size int, cell int, u array<double>"), "queries")
    asked = distinct.join(placement, ["size", "cell"]).select("id", "size", "cell", F.lit(None).cast("double").alias("score"), "u", every(F.col("first"), F.col("parts")).alias("part"))
    near, first_scored = best(asked)
    asked = distinct.join(near.select("id", "score"), "id").select("id", "size", "cell", "score", "u")
    far, other_scored = best(asked.mapInArrow(other_groups, f"id {kinds[0]}, size int, cell int, score double, u array<double>, part int"))
    done = first_scored.unionByName(other_scored).select(F.lit(0).cast("long").alias("pairs"), "scored")
    sizes = held.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    pairs = distinct.groupBy("size").agg(F.count(F.lit(1)).alias("asking")).join(sizes, "size")
    pairs = pairs.select((F.col("asking") * F.col("n")).alias("pairs"), F.lit(0).cast("long").alias("scored"))
    return Matches(answered(top_of(near.unionByName(far))), reported(done.unionByName(pairs)))
