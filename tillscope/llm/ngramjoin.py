"""Near-duplicate documents: n-gram Jaccard join with Bayesian candidate pruning.

A document is its set of five-word shingles (lower case, words only). Equal texts
are one class throughout. Classes whose MinHash values agree on a whole band are
candidates; candidates are gathered into components, and inside each component all
pairs are compared, by bounded blocks: MinHash values are compared a few at a time,
and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below ``TOLERANCE``. Every pair that is left is verified
on the shingle sets themselves. Links are thus exact; only a pair never proposed or
wrongly pruned can be missing, with a probability below 0.0002 at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import arrays, links
from tillscope.llm.registry import query
from tillscope.operators.lookup import fits_broadcast
from tillscope.session import written

THRESHOLD = 0.8
WORDS = 5
HASHES, ROWS = 128, 5  # 25 bands of 5: a pair at the threshold shares none with probability 0.00005
STEP = 16
TOLERANCE = 1e-4
BLOCK_ROWS = 512
_BANDS = HASHES // ROWS


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(81).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (rows x HASHES) of rows of shingle hashes; rows without shingles get all ones."""
    rows = len(bounds) - 1
    out = np.full((HASHES, rows), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for k, (factor, flip) in enumerate(zip(*_permutations())):
            out[k, some] = np.minimum.reduceat((low ^ flip) * factor, bounds[some])
    return out.T


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    keys = np.empty((len(values), _BANDS), np.uint64)
    for band in range(_BANDS):
        key = np.full(len(values), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = arrays.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
        keys[:, band] = key
    return keys.view(np.int64)


@cache
def least_matches(compared: int) -> int:
    """The fewest agreeing values among ``compared`` that leave a pair alive.

    With a uniform prior the similarity given m of n agreements is Beta(m + 1, n - m + 1),
    and its tail beyond t is the chance of at most m successes in n + 1 trials of chance t.
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(compared + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (compared + 1 - m)
        if tail >= TOLERANCE:
            return m
    return compared


def surviving_pairs(left: np.ndarray, right: np.ndarray, sizes_left: np.ndarray, sizes_right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures that incremental comparison does not rule out."""
    small, big = np.minimum.outer(sizes_left, sizes_right), np.maximum.outer(sizes_left, sizes_right)
    alive = small >= THRESHOLD * big  # sets too different in size cannot reach the threshold
    if same:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    one, two = np.nonzero(alive)
    matches = np.zeros(len(one), np.int16)
    for at in range(0, HASHES, STEP):
        if not len(one):
            break
        matches += (left[one, at : at + STEP] == right[two, at : at + STEP]).sum(1, dtype=np.int16)
        keep = matches >= least_matches(at + STEP)
        one, two, matches = one[keep], two[keep], matches[keep]
    return one, two


def overlaps(sets_left: list[np.ndarray], sets_right: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the given pairs of sets (sorted, unique)."""
    rows_left, rows_right = np.unique(one), np.unique(two)
    if len(one) < 64 or len(one) * 8 < len(rows_left) * len(rows_right):
        return np.array([len(np.intersect1d(sets_left[a], sets_right[b], assume_unique=True)) for a, b in zip(one, two)], np.int64)
    # Dense: count by matrix products over slices of the shared vocabulary.
    def flat(sets: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])

    (words_left, at_left), (words_right, at_right) = flat(sets_left, rows_left), flat(sets_right, rows_right)
    shared = np.intersect1d(words_left, words_right)
    total = np.zeros((len(rows_left), len(rows_right)), np.float32)
    for start in range(0, len(shared), 4096):
        part = shared[start : start + 4096]
        sides = []
        for words, at, rows in ((words_left, at_left, rows_left), (words_right, at_right, rows_right)):
            place = np.minimum(np.searchsorted(part, words), len(part) - 1)
            hit = part[place] == words
            side = np.zeros((len(rows), len(part)), np.float32)
            side[at[hit], place[hit]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total[np.searchsorted(rows_left, one), np.searchsorted(rows_right, two)].astype(np.int64)


def _text_shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = arrays.text_array(column, lower=True)
    for first, last in arrays.slices(texts):
        hashes, bounds = arrays.shingles(arrays.tokens(*arrays.slice_bytes(texts, first, last)), WORDS)
        yield first, last, hashes, bounds


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, _digest and the band keys of each text (none for a text without words)."""
    for batch in batches:
        for first, last, hashes, bounds in _text_shingles(batch.column(2)):
            keys = band_keys(signatures(hashes, bounds))
            some = np.diff(bounds) > 0
            ends = np.concatenate(([0], np.cumsum(some * _BANDS))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), held], names=["_id", "_digest", "_bands"])


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set and signature of each text, beside root, node and copies."""
    for batch in batches:
        for first, last, hashes, bounds in _text_shingles(batch.column(3)):
            sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            values = signatures(hashes, bounds)
            cut = [batch.column(i).slice(first, last - first) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*cut, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())],
                names=["root", "node", "_copies", "_set", "_signature"],
            )


def _verified(table: pa.Table) -> pa.Table:
    """For each class of a group: links to documents and to other texts there, and the smallest class it is tied to."""
    nodes = table["node"].to_numpy()
    _, rows = np.unique(nodes, return_index=True)  # a class whose first document is there twice counts once
    if len(rows) < len(nodes) and (table["_one"].to_numpy() < 0).all():
        table, nodes = table.take(rows), nodes[rows]
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["_set"]]
    values = np.stack([np.frombuffer(s.as_buffer(), np.uint32) for s in table["_signature"]])
    sizes, copies = np.array([len(s) for s in sets]), table["_copies"].to_numpy()
    documents, texts, ties = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), nodes.copy()
    blocks, one, two = (table[c].to_numpy() for c in ("_block", "_one", "_two"))
    for left, right, same in links.pair_masks(table["root"].to_numpy(), blocks, one, two):
        left, right = (rows[np.unique(nodes[rows], return_index=True)[1]] for rows in (left, right))
        if not len(left) or not len(right):
            continue
        a, b = surviving_pairs(values[left], values[right], sizes[left], sizes[right], same)
        if not len(a):
            continue
        a, b = left[a], right[b]
        common = overlaps(sets, sets, a, b)
        similar = common >= THRESHOLD * (sizes[a] + sizes[b] - common) - 1e-9
        a, b = a[similar], b[similar]
        np.add.at(documents, a, copies[b])
        np.add.at(documents, b, copies[a])
        np.add.at(texts, a, 1)
        np.add.at(texts, b, 1)
        order = np.argsort(nodes, kind="stable")  # labels are smallest rows: number rows by node
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ties = np.minimum(ties, nodes[order][links.label_stars(len(nodes), rank[a], rank[b])][rank])
    return pa.table({"node": pa.array(nodes), "documents": pa.array(documents), "texts": pa.array(texts), "tie": pa.array(ties)})


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per class of equal texts: _digest, _first (its smallest id), _class (the
    smallest id of its near-duplicate group), _kept (whether it is the group's first
    class), _links (documents linked to each of its documents) and _texts (other texts linked).

    Texts without words (null and empty ones too) are alone: _words is false for them.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(text))
    rows = docs.select(F.col(id_column).alias("_id"), digest.alias("_digest"), text.alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    signed = rows.mapInArrow(arrays.lean(_signed), f"_id {kind}, _digest binary, _bands array<long>")
    grouped = signed.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies"), F.first("_bands").alias("_bands"))
    classes = written(grouped.withColumn("_node", F.monotonically_increasing_id()), "text-classes")
    keyed = classes.select("_node", F.explode("_bands").alias("_key"))
    shared = written(keyed.groupBy("_key").agg(F.min("_node").alias("_least"), F.max("_node").alias("_most")).where("_least <> _most").select("_key", "_least"), "shared-bands")
    candidates = keyed.join(F.broadcast(shared) if fits_broadcast(shared) else shared, "_key").where("_node <> _least")
    members = written(
        links.components(candidates.select(F.col("_node").alias("a"), F.col("_least").alias("b")))
        .join(classes.select(F.col("_node").alias("node"), "_digest", "_first", "_copies"), "node"),
        "candidate-members",
    )
    # Texts of candidates only: their classes are a small table unless duplicates abound, and then the join shuffles.
    wanted = members.select(F.col("_digest").alias("_wanted"), "_first", "root", "node", "_copies")
    met = rows.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, (F.col("_digest") == F.col("_wanted")) & F.col("_id").eqNullSafe(F.col("_first")))
    loaded = written(met.select("root", "node", "_copies", "_text").mapInArrow(arrays.lean(_loaded), "root long, node long, _copies long, _set binary, _signature binary"), "candidate-sets")
    found = written(
        links.in_blocks(loaded, BLOCK_ROWS).groupBy("_group").applyInArrow(_verified, "node long, documents long, texts long, tie long"), "verified-links"
    )
    counts = found.groupBy("node").agg(F.sum("documents").alias("_documents"), F.sum("texts").alias("_linked"))
    groups = links.components(found.select(F.col("node").alias("a"), F.col("tie").alias("b")))
    joined = groups.join(classes.select(F.col("_node").alias("node"), F.col("_first").alias("_id")), "node")
    heads = joined.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("node"))).alias("_head"))
    placed = joined.select("node", "root").join(heads, "root").join(counts, "node").select(F.col("node").alias("_node"), "_head", "_documents", "_linked")
    return classes.join(placed, "_node", "left").select(
        "_digest",
        "_first",
        F.when(F.col("_head").isNull(), F.col("_first")).otherwise(F.col("_head")["_id"]).alias("_class"),
        F.coalesce(F.col("_head")["node"] == F.col("_node"), F.lit(True)).alias("_kept"),
        (F.coalesce("_documents", F.lit(0)) + F.col("_copies") - 1).alias("_links"),
        F.coalesce("_linked", F.lit(0)).alias("_texts"),
        (F.size("_bands") > 0).alias("_words"),
    )


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, class_id (smallest id of the near-duplicate group), n_links (other documents
    directly linked, copies included), n_text_links (other texts linked) and kept (this
    document stands for its group), one row per row of ``docs``.

    A text with fewer than five words is one shingle of all its words. Texts without
    words are alone. Repeated ids are rows like any other; rows with a null id link,
    but name a group only if it has no other id, and are then all kept. An empty table
    gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    facts = near_classes(docs, id_column, text_column)
    rows = docs.select(F.col(id_column).alias("_id"), F.unhex(F.md5(text)).alias("_digest"))
    worded = F.col("_words")
    return rows.join(facts, "_digest").select(
        F.col("_id").alias(id_column),
        F.when(worded, F.col("_class")).otherwise(F.col("_id")).alias("class_id"),
        F.when(worded, F.col("_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(worded, F.col("_texts")).otherwise(0).cast("long").alias("n_text_links"),
        (~worded | F.col("_kept") & F.col("_id").eqNullSafe(F.col("_first"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: one row of each near-duplicate group, the one with the smallest id.

    Rows that repeat an id and its text leave one row; rows without words all stay.
    Only digests and ids are joined; the texts stay where they are, unless the rows to
    drop are too many to broadcast.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    columns = docs.columns
    digest, key = _unused("digest", columns), _unused("key", columns)
    marked = docs.withColumns({digest: F.unhex(F.md5(text)), key: F.col(id_column)})
    facts = written(near_classes(docs, id_column, text_column).where("_words"), "near-classes")
    copies = marked.select(F.col(digest).alias("d"), F.col(key).alias("i")).groupBy("d", "i").agg(F.count(F.lit(1)).alias("n"))
    stays = F.col("_kept") & F.col("i").eqNullSafe(F.col("_first"))
    surplus = copies.join(facts, F.col("d") == F.col("_digest")).where(~stays | (F.col("n") > 1))
    other, other_key = _unused("other", columns), _unused("other_key", columns)
    judged = written(surplus.select(F.col("d").alias(other), F.col("i").alias(other_key), stays.alias("stays")), "surplus")
    listed = judged.drop("stays")
    same = (F.col(digest) == F.col(other)) & F.col(key).eqNullSafe(F.col(other_key))
    rest = marked.join(F.broadcast(listed) if fits_broadcast(listed) else listed, same, "left_anti")
    repeated = judged.where("stays").drop("stays")
    if repeated.limit(1).count():
        rest = rest.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates([digest, key]))
    return rest.select(*[F.col(f"`{c}`") for c in columns])


def _unused(name: str, columns: list[str]) -> str:
    """A column name that no column has, in any case."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups and links of all documents."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
