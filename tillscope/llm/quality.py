"""Quality classifier: hashed word n-grams and logistic regression trained by follow-the-regularised-leader.

Tokens are words and runs of other printable signs, case kept. Features are the
hashes of single tokens and of neighbouring pairs, and for each gap up to
``REPEATS`` one feature for "the token that many places before is the same", which
generalises over n-grams that repeat a word never seen in training. All fold to
``2**BITS`` places; a text's value for a feature is its number over the text's
n-grams, times ``SCALE``. A
score is the logistic of a sparse dot product, computed as one gather and one
segmented sum per slice of texts.

Training sees a bounded sample of labelled rows (``sample``, by hash of the id), so
it fits one task at any corpus size; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import arrays
from tillscope.llm.language import held_out
from tillscope.llm.registry import query

BITS = 18
SCALE = 8.0
SAMPLE = 12_000
REPEATS = 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.01, 0.02
EPOCHS = 3
THRESHOLD = 0.7


def ngram_places(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all features of rows first to last, the row of each and the number of n-grams per row."""
    data, offsets = arrays.slice_bytes(column, first, last)
    found = arrays.tokens(data, offsets, marks=True)
    same = found.rows[1:] == found.rows[:-1]
    pairs = arrays.mix(found.hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + found.hashes[1:])[same]
    hashes, rows = [found.hashes, pairs], [found.rows, found.rows[1:][same]]
    for gap in range(1, REPEATS + 1):
        again = (found.hashes[gap:] == found.hashes[:-gap]) & (found.rows[gap:] == found.rows[:-gap])
        rows.append(found.rows[gap:][again])
        hashes.append(np.full(len(rows[-1]), arrays.mix(np.array([gap], np.uint64))[0]))
    totals = np.bincount(np.concatenate(rows[:2]), minlength=last - first)
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows), totals


class Ftrl:
    """Follow-the-regularised-leader (proximal, per coordinate) for logistic loss."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def update(self, places: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        held = self.weights(places)
        error = (1 / (1 + np.exp(-np.clip(held @ values, -35, 35))) - label) * weight
        gradient = error * values
        squared = gradient * gradient
        n = self.n[places]
        self.z[places] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / ALPHA * held
        self.n[places] = n + squared


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights from (label, places, values) in the given order; the last place is the intercept.

    Both labels weigh the same in total, so a rare label is not drowned; the
    intercept is then moved back to the sample's odds.
    """
    labels = np.array([x[0] for x in examples])
    positive = int(labels.sum())
    if not 0 < positive < len(labels):  # one label only, or nothing: the base rate is all there is to learn
        out = np.zeros((1 << BITS) + 1, np.float32)
        out[-1] = 0.0 if not len(labels) else (4.0 if positive else -4.0)
        return out
    model = Ftrl()
    weights = {1: len(labels) / (2 * positive), 0: len(labels) / (2 * (len(labels) - positive))}
    for _ in range(EPOCHS):
        for label, places, values in examples:
            model.update(places, values, label, weights[label])
    out = model.weights(slice(None)).astype(np.float32)
    out[-1] += np.log(positive / (len(labels) - positive)) / 2
    return out


def _example(places: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    unique, counts = np.unique(places, return_counts=True)
    return np.append(unique, 1 << BITS), np.append(counts * (SCALE / max(total, 1)), 1.0)


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "quality", order_column: str = "_order") -> np.ndarray:
    """Weights learnt from a bounded table of labelled texts, taken in the order of ``order_column``."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.text_array(batch.column(0))
            out: list[list] = [[], []]
            for first, last in arrays.slices(texts):
                places, rows, totals = ngram_places(texts, first, last)
                order = np.argsort(rows, kind="stable")
                cuts = np.cumsum(np.bincount(rows, minlength=last - first))[:-1]
                for own, total in zip(np.split(places[order], cuts), totals):
                    unique, values = _example(own, int(total))
                    out[0].append(unique.astype(np.int32))
                    out[1].append(values.astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.float32()))],
                names=["label", "place", "features", "amounts"],
            )

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        # Views of the Arrow columns, not copies: the sample is held once.
        examples = [
            (int(label.as_py()), places.values.to_numpy(), values.values.to_numpy())
            for label, places, values in zip(table["label"], table["features"], table["amounts"])
        ]
        return pa.table({"weights": pa.array([fit(examples).tobytes()], pa.binary())})

    rows = labelled.select(F.col(text_column).cast("string").alias("_text"), F.col(label_column).cast("int").alias("_label"), F.col(order_column).alias("_place"))
    found = rows.mapInArrow(arrays.lean(features), "label int, place long, features array<int>, amounts array<float>")
    # One task learns, on at most ``sample`` rows whatever the corpus: each update needs the weights of the one before.
    model = found.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(arrays.lean_group(learn), "weights binary").collect()
    return np.frombuffer(model[0][0], np.float32) if model else fit([])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", label_column: str = "quality") -> DataFrame:
    """At most ``sample`` labelled rows that are not held out, chosen by a hash of the id.

    An id labelled more than once counts with its largest label; null ids and null
    labels are left out. If an id has several rows of text, the smallest text is used.
    """
    chosen = (
        labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("_key"))
        .agg(F.max(F.when(F.col(label_column) > 0, 1).otherwise(0)).alias("quality"))
        .withColumn("_order", F.xxhash64(F.col("_key").cast("string"), F.lit("quality")))
        .orderBy("_order", "_key")
        .limit(sample)
    )
    found = docs.select(F.col(id_column).alias("_key"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_key")
    return found.groupBy("_key", "_order", "quality").agg(F.min("text").alias("text"))


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) of every whole text.

    Null and empty texts get the score of a text without features. Null and repeated
    ids are kept row by row; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(batch.column(1), weights), pa.float64())], names=["_id", "score"])

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, score double"
    return rows.mapInArrow(arrays.lean(work), schema).withColumnRenamed("_id", id_column)


def scores_of(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    texts = arrays.text_array(column)
    parts = [np.zeros(0)]
    for first, last in arrays.slices(texts):
        places, rows, totals = ngram_places(texts, first, last)
        sums = np.bincount(rows, weights[places], last - first) * (SCALE / np.maximum(totals, 1))
        parts.append(1 / (1 + np.exp(-np.clip(sums + weights[-1], -35, 35))))
    return np.concatenate(parts)


def accepted(docs: DataFrame, weights: np.ndarray, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    at = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch.column(at), weights) >= threshold))

    return docs.mapInArrow(arrays.lean(work), docs.schema)


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled documents not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = train(labelled_sample(docs, labels))
    kept_out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return score(docs, weights).select("doc_id", kept_out, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
