"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes (signs of random
projections), vectors are sorted by that key, and each is compared with the
``window`` vectors after it. Similar vectors agree on long prefixes of most keys, so
they meet in some pass. Verified pairs of all passes are united into components, and
links are then counted inside each component, exactly, by blocks.

Equal vectors are one class throughout and only multiply the counts.

The first number of passes follows from the number of vectors: two vectors at the
threshold agree on one hash with probability ``1 - angle / pi``, and meet in a pass
if they agree on about ``log2(vectors / window)`` of them. How many it really takes is
measured: rows share a common prefix with the rows a window away, and a pair that
agrees on one hash more meets for sure. Vectors whose recall by that measure is below
the target, as in a hot cluster whose members don't link, are thin. A pair with one
other vector is safe, so only thin ones go on: by passes whose projections are centred
on the means of their clusters, measured again, and at last by exact comparison.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import links
from tillscope.llm.registry import query
from tillscope.session import written

THRESHOLD = 0.95
WINDOW = 64
RECALL = 0.99  # of a pair at the threshold alone; components have many pairs above it
HASHES = 60
BLOCK_ROWS = 256
MEASURED = 12  # passes in which the recall of each vector is measured
EXACT_ROWS = 1 << 15  # so many thin vectors are compared exactly
EXACT_BLOCK = 2048
ROUNDS = 6  # of centred passes at most; what is thin after them is compared exactly
PASSES = 256  # of one round at most
_SAMPLE = 1000  # thin vectors that clusters are found in
_DENSITY = 4  # bits lost to clusters: vectors crowd around topics, so windows fill sooner than uniform ones would


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for null, zero, or with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for item in column:
        held = item.values
        if held is None or held.null_count or not len(held):
            out.append(None)
            continue
        vector = held.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out.append(vector + 0.0 if np.isfinite(vector).all() and vector.any() else None)
    return out


def classes_of(rows: DataFrame) -> DataFrame:
    """_id, _key (a digest of the vector; null if it links with nothing) and the components as they were given."""
    narrow = _width(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            keys = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]
            units = [None if v is None else v.astype(narrow).tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["_id", "_key", "_unit"])

    return rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, _key binary, _unit binary")


def _width(rows: DataFrame) -> str:
    """Single precision where the vectors are given so: sorting then moves half the bytes."""
    kind = rows.schema["_vector"].dataType
    return "<f4" if kind.simpleString() == "array<float>" else "<f8"


def _unit_rows(raw: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    rows = np.stack(raw).astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def passes_for(vectors: int, window: int = WINDOW, recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** max(1.0, math.log2(max(2, vectors) / window) + _DENSITY)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


_COST_STEPS, _COST_RANGE = 64, 6
_COSTS = np.array([min(255, round(-_COST_STEPS * math.log(0.5 * math.erfc(-x / 512 / math.sqrt(2))))) for x in range(-512 * _COST_RANGE, 512 * _COST_RANGE + 1)], np.uint8)


def _agreement(norm: float, threshold: float = THRESHOLD) -> float:
    """Chance that a vector so far from the centre of the projections agrees on a hash with one at the threshold from it."""
    return 1 - 2 * math.asin(min(1.0, math.sqrt((1 - threshold) / 2) / norm)) / math.pi


def _costs(projected: np.ndarray, norms: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Negative logarithms, in steps of 1/64, of the chances that rows agree on each hash with a vector at the threshold, given their projections.

    The projection of a vector as far from the centre is normal around a share of the row's own.
    Rows at the edge of a cluster stand near the planes that cut them off, so the mean chance would be too good for them.
    """
    share = np.maximum(1 - (1 - threshold) / np.maximum(norms, 1e-6) ** 2, -0.99)
    spread = np.sqrt(1 - share**2) * np.maximum(norms, 1e-6)
    at = np.abs(projected) * (share / spread)[:, None].astype(np.float32)
    return _COSTS[(np.clip(at, -_COST_RANGE, _COST_RANGE) * 512).astype(np.int32) + 512 * _COST_RANGE]


def _projected(passes: int, width: str, centres: dict[int, np.ndarray] | None = None, seed: int = 0):
    """Adds _pass, _place (the concatenated hashes as one number) and _cost (``_costs``) to the rows of a task, one row per pass.

    With centres (by length of the vectors) a row is hashed relative to its nearest
    centre, and also to each other one that is the nearest of some vector at the
    threshold from it, so that such a pair shares a centre; _pass then numbers passes
    and centres. _cost is null where recall is not to be measured.
    """
    reach = 2 * math.sqrt(2 - 2 * THRESHOLD)
    most = max((len(c) for c in (centres or {}).values()), default=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        weights = (np.int64(1) << np.arange(HASHES - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            units = [np.frombuffer(u, width) for u in batch.column(1).to_pylist()]
            places = np.zeros((len(units), passes), np.int64)
            for size in {len(u) for u in units}:
                if size not in drawn:
                    drawn[size] = np.random.default_rng([size, seed]).standard_normal((size, passes * HASHES)).astype(np.float32)
                own = np.array([i for i, u in enumerate(units) if len(u) == size])
                rows = _unit_rows([units[i] for i in own])
                middles = (centres or {}).get(size, np.zeros((1, size)))
                apart = np.stack([np.linalg.norm(rows - middle, axis=1) for middle in middles], 1)
                nearest = apart.argmin(1)
                for number, middle in enumerate(middles):
                    here = np.flatnonzero(apart[:, number] <= apart.min(1) + reach)
                    chosen = own[here]
                    counted = min(passes, MEASURED)
                    costs = np.zeros((len(here), counted, HASHES), np.uint8)
                    for at in range(0, len(here), 1024):
                        part = slice(at, at + 1024)
                        projected = (rows[here[part]] - middle).astype(np.float32) @ drawn[size]
                        places[chosen[part]] = (projected > 0).reshape(-1, passes, HASHES).astype(np.int64) @ weights
                        costs[part] = _costs(projected[:, : counted * HASHES], apart[here[part], number]).reshape(-1, counted, HASHES)
                    aside = nearest[here] != number
                    if len(middles) > 1 or len(here) < len(units):
                        keys, held = batch.column(0).take(pa.array(chosen)), batch.column(1).take(pa.array(chosen))
                    else:
                        keys, held = batch.column(0), batch.column(1)
                    for turn in range(passes if len(here) else 0):
                        known = pa.array([None if a else c.tobytes() for a, c in zip(aside, costs[:, turn])], pa.binary()) if turn < MEASURED else pa.nulls(len(here), pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [keys, held, pa.array(np.full(len(here), turn * most + number, np.int32)), pa.array(places[chosen, turn]), known], names=["_key", "_unit", "_pass", "_place", "_cost"]
                        )

    return work


def _close(units: list[np.ndarray], passes: np.ndarray, window: int, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``window`` apart, of one pass and one length, with cosine at the threshold or more; the later one at ``fresh`` or after."""
    lengths = np.array([len(u) for u in units])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        held = _unit_rows([units[i] for i in own])
        step = max(window, 128)
        for at in range(0, len(own), step):
            stop = min(len(own), at + step)
            end = min(len(own), stop + window)
            cosines = held[at:stop] @ held[at:end].T
            left, right = np.nonzero(cosines >= THRESHOLD)
            left, right = own[left + at], own[right + at]
            keep = (right > left) & (right - left <= window) & (right >= fresh) & (passes[left] == passes[right])
            found.append((left[keep], right[keep]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


_EDGES = "kind string, part int, place int, _key binary, _unit binary, _pass int, other binary, miss double"


def _prefix(places: np.ndarray, passes: np.ndarray, window: int) -> np.ndarray:
    """Hashes that each row shares with the row a window later; -1 if that is of another pass."""
    bits = np.frexp((places[:-window] ^ places[window:]).astype(np.float64))[1]
    return np.where(passes[:-window] == passes[window:], HASHES - bits, -1)


def _windows(window: int, width: str):
    """Links inside a task's sorted rows (kind link: _key, other), its first and last rows (head, tail) for the seams between tasks,
    and the logarithm of the chance to miss a pair at the threshold (miss: _key, miss) where it is measured.

    A row meets every row that shares more hashes with it than the rows a window before and after do. At the ends of a
    task one side is known, and stands for both.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys: list[bytes] = []
        units: list[np.ndarray] = []
        passes = np.zeros(0, np.int32)
        places, before = np.zeros(0, np.int64), np.zeros(0, np.int64)
        costs: list[bytes | None] = []
        seen = 0

        def misses(last: int, ahead: np.ndarray) -> pa.RecordBatch:
            need = np.maximum(ahead, before[:last]) + 1
            own = [i for i in np.flatnonzero(need >= 0) if costs[i] is not None]
            spent = np.frombuffer(b"".join(costs[i] for i in own), np.uint8).reshape(-1, HASHES)
            total = np.where(np.arange(HASHES) < need[own][:, None], spent, 0).sum(1) / _COST_STEPS
            return _miss_rows([keys[i] for i in own], np.log1p(-np.minimum(np.exp(-total), 1 - 1e-12)))

        def rows(kind: str, chosen: range) -> pa.RecordBatch:
            return _edge_rows(kind, part, [keys[i] for i in chosen], [units[i].tobytes() for i in chosen], passes[list(chosen)] if len(chosen) else passes[:0])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                old = len(keys)
                keys = keys + piece.column(0).to_pylist()
                units = units + [np.frombuffer(u, width) for u in piece.column(1).to_pylist()]
                passes = np.concatenate((passes, piece.column(2).to_numpy()))
                places = np.concatenate((places, piece.column(3).to_numpy()))
                costs = costs + piece.column(4).to_pylist()
                before = np.concatenate((before, np.full(piece.num_rows, -2)))  # -2: not known
                if len(keys) > window:
                    shared = _prefix(places, passes, window)
                    before[max(old, window) :] = shared[max(old, window) - window :]
                    yield misses(len(shared), shared)
                if seen < window:
                    yield rows("head", range(old, min(len(keys), old + window - seen)))
                seen += piece.num_rows
                left, right = _close(units, passes, window, old)
                labels = links.label_stars(len(keys), left, right)
                tied = np.flatnonzero(labels != np.arange(len(keys)))
                yield _link_rows([keys[i] for i in tied], [keys[i] for i in labels[tied]])
                if len(keys) > window:
                    keys, units, passes, places, costs, before = (x[-window:] for x in (keys, units, passes, places, costs, before))
        if keys:
            yield misses(len(keys), np.full(len(keys), -2))
            yield rows("tail", range(len(keys)))

    return work


def _edge_rows(kind: str, part: int, keys: list, units: list, passes: np.ndarray) -> pa.RecordBatch:
    count = len(keys)
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array([kind] * count, pa.string()),
            "part": pa.array([part] * count, pa.int32()),
            "place": pa.array(range(count), pa.int32()),
            "_key": pa.array(keys, pa.binary()),
            "_unit": pa.array(units, pa.binary()),
            "_pass": pa.array(passes, pa.int32()),
            "other": pa.nulls(count, pa.binary()),
            "miss": pa.nulls(count, pa.float64()),
        }
    )


def _miss_rows(keys: list, miss: np.ndarray) -> pa.RecordBatch:
    count = len(keys)
    empty = [pa.nulls(count, kind) for kind in (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())]
    columns = [pa.array(["miss"] * count, pa.string()), *empty[:2], pa.array(keys, pa.binary()), *empty[2:], pa.array(miss, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "place", "_key", "_unit", "_pass", "other", "miss"])


def _link_rows(ones: list, others: list) -> pa.RecordBatch:
    count = len(ones)
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array(["link"] * count, pa.string()),
            "part": pa.nulls(count, pa.int32()),
            "place": pa.nulls(count, pa.int32()),
            "_key": pa.array(ones, pa.binary()),
            "_unit": pa.nulls(count, pa.binary()),
            "_pass": pa.nulls(count, pa.int32()),
            "other": pa.array(others, pa.binary()),
            "miss": pa.nulls(count, pa.float64()),
        }
    )


def _seam(window: int, width: str):
    """Links across one seam: the last rows of a task against the first of the next."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "descending"), ("place", "ascending")])  # the tail, then the head
        keys = table["_key"].to_pylist()
        units = [np.frombuffer(u, width) for u in table["_unit"].to_pylist()]
        tails = pc.sum(pc.equal(table["kind"], "tail")).as_py() or 0
        left, right = _close(units, table["_pass"].to_numpy(), window, tails)
        across = left < tails
        return pa.table({"a": pa.array([keys[i] for i in left[across]], pa.binary()), "b": pa.array([keys[i] for i in right[across]], pa.binary())})

    return work


def projection_links(classes: DataFrame, passes: int, width: str, window: int = WINDOW, centres: dict[int, np.ndarray] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that tie vectors (_key, _unit: its components) found within a window of some pass, and _key and _miss
    (logarithm of the chance that a pair at the threshold was missed) as measured; all rows are sorted by pass and key at once."""
    spread = classes.mapInArrow(_projected(passes, width, centres, seed), "_key binary, _unit binary, _pass int, _place long, _cost binary")
    order = ["_pass", "_place", "_key"]
    sorted_rows = spread.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_unit", "_pass", "_place", "_cost")
    found = written(sorted_rows.mapInArrow(_windows(window, width), _EDGES), "projection-windows")
    missed = found.where("kind = 'miss'").groupBy("_key").agg((F.avg("miss") * passes).alias("_miss"))
    return _met(found, window, width), missed


def _met(found: DataFrame, window: int, width: str) -> DataFrame:
    """Edges (a, b) inside tasks and across their seams."""
    inside = found.where("kind = 'link'").select(F.col("_key").alias("a"), F.col("other").alias("b"))
    # Tasks without rows leave holes in the numbering; the list of the others is bounded by the number of tasks.
    parts = sorted(r[0] for r in found.where("kind = 'tail'").select("part").distinct().collect())
    follows = dict(zip(parts, parts[1:]))
    if not follows:
        return inside
    next_of = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])
    ends = found.where("kind = 'tail'").withColumn("_seam", next_of[F.col("part")])
    starts = found.where("kind = 'head'").withColumn("_seam", F.col("part"))
    seams = ends.unionByName(starts).where("_seam is not null").select("_seam", "kind", "place", "_key", "_unit", "_pass")
    return inside.unionByName(seams.groupBy("_seam").applyInArrow(_seam(window, width), "a binary, b binary"))


def _clusters(thin: DataFrame, width: str) -> dict[int, np.ndarray]:
    """Means of the clusters in a bounded sample of vectors, by length; the origin too if some vectors are in none."""
    by_length: dict[int, list[np.ndarray]] = {}
    for row in thin.select("_unit").orderBy(F.xxhash64("_key"), "_key").limit(_SAMPLE).collect():
        unit = np.frombuffer(row[0], width)
        by_length.setdefault(len(unit), []).append(unit)
    found = {}
    for size, units in by_length.items():
        rows = _unit_rows(units)
        near = rows @ rows.T >= 0.5
        free, means = np.ones(len(rows), bool), []
        while free.any():
            numbers = (near & free).sum(1) * free
            leader = int(numbers.argmax())
            own = near[leader] & free
            if own.sum() < max(2, len(rows) // 50):
                means.append(np.zeros(size))
                break
            means.append(rows[own].mean(0))
            free &= ~own
        found[size] = np.stack(means)
    return found


def _block_links(width: str):
    """A star of links in each unit of a group of blocks."""

    def work(table: pa.Table) -> pa.Table:
        keys = table["node"].to_pylist()
        units = [np.frombuffer(u, width) for u in table["_unit"].to_pylist()]
        blocks, one, two = (table[c].to_numpy() for c in ("_block", "_one", "_two"))
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for left, right, _ in links.pair_masks(np.array(table["root"].to_pylist(), object), blocks, one, two):
            if len(left) and len(right):
                near = _unit_rows([units[i] for i in left]) @ _unit_rows([units[i] for i in right]).T >= THRESHOLD
                x, y = np.nonzero(near)
                a.append(left[x])
                b.append(right[y])
        labels = links.label_stars(len(keys), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(keys))
        tied = np.flatnonzero(labels != np.arange(len(keys)))
        return pa.table({"a": pa.array([keys[i] for i in tied], pa.binary()), "b": pa.array([keys[i] for i in labels[tied]], pa.binary())})

    return work


def exact_links(thin: DataFrame, width: str) -> DataFrame:
    """Edges (a, b) that tie all pairs of vectors (_key, _unit) at the threshold, by pairs of blocks."""
    members = thin.select(F.octet_length("_unit").alias("root"), F.col("_key").alias("node"), "_unit")
    return links.in_blocks(members, EXACT_BLOCK).groupBy("_group").applyInArrow(_block_links(width), "a binary, b binary")


def all_links(classes: DataFrame, width: str) -> DataFrame:
    """Edges (a, b) that tie the vectors (_key, _unit), each pair at the threshold with the target recall."""
    thin, count = classes, classes.count()
    edges, missed = projection_links(thin, passes_for(count), width)
    for turn in range(1, ROUNDS + 2):
        low = F.coalesce(F.col("_miss"), F.lit(0.0)) > math.log(1 - RECALL)
        thin = written(thin.join(missed, "_key", "left").where(low).select("_key", "_unit", F.coalesce("_miss", F.lit(0.0)).alias("_before")), "thin-vectors")
        before, count = count, thin.count()
        if not count:
            return edges
        if count <= EXACT_ROWS or turn > ROUNDS or turn > 2 and count > before * 0.9:
            return edges.unionByName(exact_links(thin, width))
        centres = _clusters(thin, width)
        # A guess, for what is still thin goes on: a norm of 0.4 relative to the mean of the cluster.
        meet = _agreement(0.4) ** max(1.0, math.log2(count / WINDOW) + 1)
        passes = min(PASSES, max(MEASURED, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))))
        more, again = projection_links(thin.select("_key", "_unit"), passes, width, centres=centres, seed=turn)
        edges = edges.unionByName(more)
        # Chances of independent passes multiply, so their logarithms add up.
        missed = again.join(thin, "_key", "right").select("_key", (F.coalesce("_miss", F.lit(0.0)) + F.col("_before")).alias("_miss"))
        thin = thin.select("_key", "_unit")
    return edges


def _count_links(table: pa.Table, width: str) -> pa.Table:
    """Links of each row of a group with the other rows of its component there, weighted by copies."""
    units = [np.frombuffer(u, width) for u in table["_unit"].to_pylist()]
    copies = table["_copies"].to_numpy().astype(np.int64)
    found = np.zeros(len(units), np.int64)
    blocks, one, two = (table[c].to_numpy() for c in ("_block", "_one", "_two"))
    for left, right, same in links.pair_masks(np.array(table["root"].to_pylist(), object), blocks, one, two):
        if not len(left) or not len(right):
            continue
        # All vectors of a component have one length: only such are ever linked.
        near = _unit_rows([units[i] for i in left]) @ _unit_rows([units[i] for i in right]).T >= THRESHOLD
        if same:
            np.fill_diagonal(near, False)
            found[left] += near @ copies[right]
        else:
            found[left] += near @ copies[right]
            found[right] += copies[left] @ near
    return pa.table({"node": table["node"], "links": pa.array(found, pa.int64())})


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of every vector.

    Vectors that are null, zero or hold null or non-finite components, and vectors of
    different lengths, never link. Repeated ids are kept row by row; a row with a null
    id takes part, but names a component only if the component has no other id, and is
    not kept. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(vector_column).alias("_vector"))
    held = classes_of(rows)
    classes = written(
        held.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"), F.first("_unit").alias("_unit")), "vector-classes"
    )
    width = _width(rows)
    members = written(links.components(all_links(classes.select("_key", "_unit"), width)), "vector-components")
    blocks = links.in_blocks(members.join(classes, members["node"] == classes["_key"]).select("root", "node", "_unit", "_copies"), BLOCK_ROWS)
    counted = blocks.groupBy("_group").applyInArrow(lambda table: _count_links(table, width), "node binary, links long").groupBy("node").agg(F.sum("links").alias("_links"))
    leasts = members.join(classes, members["node"] == classes["_key"]).groupBy("root").agg(F.min("_least").alias("_component"))
    tied = members.join(leasts, "root").join(counted, "node").select(F.col("node").alias("_key"), "_component", "_links")
    facts = classes.select("_key", "_least", "_copies").join(tied, "_key", "left").select(
        "_key",
        (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"),
        F.coalesce("_component", "_least").alias("_component"),
    )
    facts = written(facts, "vector-facts")  # so that the join below can split a hot key
    component = F.coalesce("_component", "_id")
    return (
        held.select("_id", "_key")
        .join(facts, "_key", "left")
        .select(
            F.col("_id").alias(id_column),
            F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
        )
    )


@query(
    "op9_projection_dedup",
    """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      and list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
    least as (select a, min(b) as component_id from reach group by a), counted as (select a, count(*) as n from links group by a)
    select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
    from embeddings e join least l on l.a = e.vec_id left join counted c on c.a = e.vec_id""",
)
def op9_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
