"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. A trigram binds the vectors of
its letters, each permuted by its place (rotated by two, one and no steps), by
multiplication. A text is the bundle (sum) of its trigrams, a language the
bundle of its training texts, and a text gets the language with the largest
cosine. Trigrams centre on every letter; white space, digits and signs all count
as one word break, so beginnings and ends of words are trigrams too.

Sums of +1 and -1 are whole numbers, so the profiles do not depend on the order
in which partitions are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import arrays
from tillscope.llm.registry import query

DIMENSIONS = 1024
LETTERS = 64  # 0 is the word break, 1 to 26 are a to z, other letters share the rest by hash
_SLICE = 1 << 20


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point of the basic plane, the same for both cases; other planes are handled apart."""
    table = np.zeros(1 << 16, np.uint8)
    for point in range(1 << 16):
        if chr(point).isalpha():
            low = ord(chr(point).lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % (LETTERS - 27)
    return table


@cache
def _letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of letters in first, second and third place."""
    drawn = np.random.default_rng(20240607).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
    drawn = drawn.astype(np.float32)
    return np.roll(drawn, 2, axis=1), np.roll(drawn, 1, axis=1), drawn


def _bound(codes: np.ndarray) -> np.ndarray:
    first, second, third = _letter_vectors()
    out = first[codes // (LETTERS * LETTERS)]
    out *= second[codes // LETTERS % LETTERS]
    out *= third[codes % LETTERS]
    return out


def _trigrams(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each trigram in each row (rows x distinct trigrams) and the trigrams' codes."""
    data, offsets = arrays.slice_bytes(column, first, last)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    rows = np.repeat(np.arange(last - first), np.diff(begun[offsets]))
    symbols = np.zeros(len(points) + 2 * (last - first) + 2, np.uint8)
    places = np.arange(len(points)) + 2 * rows + 2
    found = _symbols()[np.minimum(points, 0xFFFF)]
    beyond = points > 0xFFFF
    if beyond.any():
        found[beyond] = [27 + int(p) % (LETTERS - 27) if chr(p).isalpha() else 0 for p in points[beyond]]
    symbols[places] = found
    middle = places[found > 0]
    rows = rows[found > 0]
    codes = (symbols[middle - 1].astype(np.int64) * LETTERS + symbols[middle]) * LETTERS + symbols[middle + 1]
    present = np.flatnonzero(np.bincount(codes, minlength=LETTERS**3))
    column_of = np.zeros(LETTERS**3, np.int64)
    column_of[present] = np.arange(len(present))
    width = len(present)
    counts = np.bincount(rows * width + column_of[codes], minlength=(last - first) * width) if width else np.zeros(0)
    return counts.reshape(last - first, width).astype(np.float32), present


def learn(training: DataFrame, text_column: str = "text", language_column: str = "lang") -> dict[str, np.ndarray]:
    """The profile of each language over all training rows with a language.

    Each task adds up its own rows; Spark adds up the tasks' sums. What reaches the
    driver is one vector per language, whatever the number of rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column(1).to_pylist()
            texts = arrays.text_array(batch.column(0))
            for first, last in arrays.slices(texts, _SLICE):
                counts, codes = _trigrams(texts, first, last)
                if not len(codes):
                    continue
                named = sorted(set(languages[first:last]))
                per_language = np.stack([counts[[i for i, x in enumerate(languages[first:last]) if x == name]].sum(0, dtype=np.float64) for name in named])
                for name, vector in zip(named, per_language @ _bound(codes).astype(np.float64)):
                    sums[name] = sums.get(name, 0) + vector
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}
        )

    rows = training.where(F.col(language_column).isNotNull() & F.col(text_column).isNotNull())
    parts = rows.select(F.col(text_column).cast("string").alias("_text"), F.col(language_column).cast("string").alias("_lang"))
    sums = (
        parts.mapInArrow(work, "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    profiles: dict[str, np.ndarray] = {}
    for row in sums:
        profiles.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["place"]] = row["value"]
    return dict(sorted(profiles.items()))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred and score (cosine with the best profile, 0 if negative) of every whole text.

    A text that is null or has no letter, and every text if there are no profiles,
    gets ``und`` and 0. Ties go to the first language by name. Null and repeated ids
    are kept row by row; an empty table gives no rows.
    """
    names = list(profiles)
    normed = np.stack([v / (np.linalg.norm(v) or 1.0) for v in profiles.values()]).T.astype(np.float32) if names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.text_array(batch.column(1))
            found, scores = [], []
            for first, last in arrays.slices(texts, _SLICE):
                counts, codes = _trigrams(texts, first, last)
                if normed is None or not len(codes):
                    found += ["und"] * (last - first)
                    scores += [0.0] * (last - first)
                    continue
                bundles = counts @ _bound(codes)
                lengths = np.linalg.norm(bundles, axis=1)
                cosines = bundles @ normed / np.maximum(lengths, 1e-9)[:, None]
                best = cosines.argmax(1)
                some = counts.any(1)
                found += [names[b] if s else "und" for b, s in zip(best, some)]
                scores += np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_column)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id's text leaves 2 when divided by 4 (null for a null id)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents not held out. A null id is neither learnt from nor held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out()))
    kept_out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return predict(docs, profiles).select("doc_id", kept_out, "lang_pred", "score")
