"""Token packing along a space-filling curve.

Every document is a bag of token ids. Each id owns a hashed direction in a few
dimensions, and a document's place is the mean of its ids' directions, scaled to
the spread such a mean has. Places are put on a grid and numbered along a Hilbert
curve, so neighbours on the curve share vocabulary. Spark range-sorts by that
number; each task then fills sequences with the documents of its range, one after
another, cutting where a sequence is full.

A task's last tokens, fewer than a sequence, are cut into sequences whose lengths
are powers of two, which need no padding. So no token of padding arises anywhere,
whatever the number of tasks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import arrays
from tillscope.llm.registry import query
from tillscope.session import written

SEQUENCE = 2048
DIMENSIONS, BITS = 4, 12
_SLICE = 1 << 21
_END_OF_TEXT = 1


class Encoder:
    """Token ids by a byte-level BPE vocabulary file.

    The file's merges are ranked by the ids of their results, so its vocabulary is a
    rank table, and a rank encoder gives the very ids the file's own library gives
    (a test holds both against each other), several times faster. With ``added`` the
    file's added tokens (<|endoftext|>) get their own ids wherever they stand in a text,
    as in that library by default; else their strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        with open(path, encoding="utf-8") as source:
            held = json.load(source)
        vocabulary = held["model"]["vocab"]
        tokens = held.get("added_tokens") or [] if added else []
        if any(t.get(option) for t in tokens for option in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take spaces or whole words only are not supported")
        self._added = {t["content"]: t["id"] for t in tokens}
        # Byte-level vocabularies write each byte as a visible sign; bytes without one follow from 256.
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if not piece.startswith("<|")}
        self.size = max([*vocabulary.values(), *self._added.values()]) + 1
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self._added)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the first id of each text (one more at the end)."""
        held = set(self._added)
        found = [self._encoding.encode_to_numpy(text, allowed_special=held if any(t in text for t in held) else set(), disallowed_special=()) for text in texts]
        bounds = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
        return np.concatenate([np.zeros(0, np.uint32), *found]), bounds


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path, added=True)


@cache
def _directions(size: int) -> np.ndarray:
    """One hashed direction of +1 and -1 per token id."""
    mixed = arrays.mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (((mixed[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1).T.copy()


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each grid cell (points x dimensions, integers below 2**bits) along the Hilbert curve.

    The transform works on all points at once: from the top bit down, each
    dimension either flips the lower bits of the first one or swaps them with it;
    the Gray code of the transposed bits then gives the position.
    """
    x = cells.astype(np.uint64).T.copy()
    count = len(x)
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        low = level - np.uint64(1)
        for i in range(count):
            up = (x[i] & level) > 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
        level >>= np.uint64(1)
    for i in range(1, count):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        turn ^= np.where((x[-1] & level) > 0, level - np.uint64(1), np.uint64(0))
        level >>= np.uint64(1)
    x ^= turn
    keys = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(count):
            keys = (keys << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return keys.astype(np.int64)


def curve_keys(ids: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Hilbert position of each row's hashed bag of ids; rows without ids sit in the middle cell."""
    lengths = np.diff(bounds)
    places = np.empty((len(lengths), DIMENSIONS))
    for i, direction in enumerate(_directions(size)):
        sums = np.concatenate(([0.0], np.cumsum(direction[ids], dtype=np.float64)))
        places[:, i] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(lengths, 1))
    # Ids repeat, so sums spread wider than the root of the length; the logistic keeps all of them on the grid.
    cells = (1 << BITS) / (1 + np.exp(-places / 2))
    return hilbert_keys(np.minimum(cells, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """_id, _key (place on the curve) and _ids (the text's token ids with the closing id 1, as little-endian bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width = "<u2" if encoder.size <= 1 << 16 else "<u4"
        for batch in batches:
            texts = arrays.text_array(batch.column(1))
            for first, last in arrays.slices(texts, _SLICE):
                ids, bounds = encoder.encode(texts.slice(first, last - first).to_pylist())
                keys = curve_keys(ids, bounds, encoder.size)
                closed = np.insert(ids, bounds[1:], _END_OF_TEXT).astype(width)
                ends = (bounds + np.arange(len(bounds))) * closed.itemsize
                held = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(closed)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(keys, pa.int64()), held, pa.array(np.full(last - first, closed.itemsize, np.int32))],
                    names=["_id", "_key", "_ids", "_width"],
                )

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    return rows.mapInArrow(arrays.lean(work), f"_id {rows.schema['_id'].dataType.simpleString()}, _key long, _ids binary, _width int")


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a task's documents, in order, into full sequences and a tail of powers of two."""
    sequence = TaskContext.get().partitionId() << 32
    held: list[tuple[int, int, int, int, int]] = []  # pieces of the open sequence: document, start, length, crc, tokens
    columns: list[list] = [[] for _ in range(7)]
    owners: list = []
    id_type = None
    used = 0

    def add(owner, start, length, crc, tokens, number, offset):
        owners.append(owner)
        for column, value in zip(columns, (start, length, crc, tokens, number, offset)):
            column.append(value)

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(owners, id_type), *(pa.array(c, pa.int64()) for c in columns[:6])],
            names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        owners.clear()
        for column in columns:
            column.clear()
        return batch

    for batch in batches:
        id_type = batch.schema.field(0).type
        for owner, raw, width in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
            start = 0
            while start < len(ids):
                length = min(SEQUENCE - used, len(ids) - start)
                held.append((owner, start, ids[start : start + length], len(ids), used))
                used += length
                start += length
                if used == SEQUENCE:
                    for own, at, part, tokens, offset in held:
                        add(own, at, len(part), zlib.crc32(part.tobytes()), tokens, sequence, offset)
                    held, used, sequence = [], 0, sequence + 1
        if owners:
            yield out()
    # The tail: fewer ids than a sequence, cut into sequences of falling powers of two.
    room = 0
    for own, at, part, tokens, _ in held:
        while len(part):
            if not room:
                room = size = 1 << (used.bit_length() - 1)
            length = min(room, len(part))
            add(own, at, length, zlib.crc32(part[:length].tobytes()), tokens, sequence, size - room)
            part, at, room, used = part[length:], at + length, room - length, used - length
            if not room:
                sequence += 1
    if owners:
        yield out()


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every id of every document in exactly one piece of one sequence.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or
    empty text is the closing id alone. Null and repeated ids are packed row by row
    (equal documents follow each other); an empty table gives no rows. Sequence
    numbers are the task's number and a count in it: unique, not gapless. Other
    columns are not read.

    Equal places are ordered by the id and the tokens, so a hot place is split between
    tasks, and a task that runs again gives the same pieces.
    """
    # Written first: finding the ranges reads the rows once, dealing them out reads them again.
    rows = written(tokenized(docs, tokenizer, id_column, text_column), "token-ids")
    order = ["_key", "_id", F.xxhash64("_ids")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(arrays.lean(_fill), schema).withColumnRenamed("_id", id_column)


@query("op4_curve_packing")
def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
