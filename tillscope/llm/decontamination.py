"""Benchmark decontamination by edit distance.

Texts are sequences of lower-case words. An item is found in a document if some
passage of the document is within ``MAX_EDITS`` of the item's words: insertions,
deletions and changes of whole words, counted exactly.

An item is cut into segments of about ``SEGMENT`` words; if the passage is within the
share of edits of the whole item, one segment is within that share of its own. Segments,
and windows of a segment's size, are embedded by the CGK random walk: at each step the
embedding copies the current word, and a random bit of that word decides whether the walk
moves on, so after an edit two walks soon fall into step again, and an edit distance
becomes a Hamming distance. Locality-sensitive hashing samples pairs of places of the
embedding; ``WALKS`` independent walks with ``PAIRS`` samples each find copies at the
limit of edits with a recall of 0.999 (measured for words deleted, inserted and changed,
items of 10 to 400 words). A passage around a window that shares a sample with a segment
is verified for the whole item by the exact distance.

Items that can't be embedded well are found without samples: those of fewer than
``EMBEDDED_WORDS`` words, and those without enough rare words of their own. They are cut
into one segment more than they may take edits, so one of the segments stands word for
word in the passage.

Only passages within reach of their item are looked at: a passage within k edits of an
item holds all but k of the item's words, so it holds at least (the item's rare
words - k) of these, whatever the edits. This count rules out nothing that the
verification would accept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import arrays
from tillscope.llm.registry import query

MAX_EDITS = 0.2  # of an item's words
MIN_WORDS = 8  # by default shorter items are not searched; the query and the pipeline search all that have words
BLOCK_BYTES = 8 << 20
RARE = 4  # a rare word is in so many items at most
EMBEDDED_WORDS, SEGMENT = 10, 20
WALKS, PAIRS = 16, 12
_STEPS = 1.5  # places sampled, of a segment's words; a walk takes two steps a word
_FILTER_BITS = 20
_PIECE = 1 << 20  # candidates at a time
_WINDOWS = 1 << 12  # windows embedded at a time


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    column = arrays.text_array(pa.array(texts, pa.string()), lower=True)
    found = arrays.tokens(*arrays.slice_bytes(column, 0, len(column)))
    return found.hashes, found.bounds


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """One hash of each ``size`` following words."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for step in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[step : step + len(out)]
    return arrays.mix(out)


def embedded(padded: np.ndarray, starts: np.ndarray, stops: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """CGK embeddings of the windows padded[starts:stops]: walks x steps x windows.

    The last of the padded words is zero, which a walk past its end reads.
    """
    at = np.tile(starts, (len(turns), 1))
    out = np.zeros((len(turns), turns.shape[1], len(starts)), np.uint64)
    for step in range(turns.shape[1]):
        out[:, step] = padded[np.where(at < stops, at, len(padded) - 1)]
        at += ((out[:, step] * turns[:, step, None]) >> np.uint64(63)).astype(np.int64)
    return out


class Sampler:
    """The walks and samples for segments of one length: a key of two places of one walk, ``PAIRS`` of them for each of ``WALKS``."""

    def __init__(self, length: int) -> None:
        random = np.random.default_rng([length, 5])
        odd = lambda *shape: random.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        steps = max(2, int(length * _STEPS))
        self.turns = odd(WALKS, steps)
        self.pairs = np.stack([np.sort(random.choice(steps, 2, replace=False)) for _ in range(WALKS * PAIRS)]).reshape(WALKS, PAIRS, 2)
        self.factors = odd(WALKS, PAIRS, 2)

    def keys(self, padded: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Keys of windows: (walks x pairs) x windows."""
        places = embedded(padded, starts, stops, self.turns)
        walk = np.arange(WALKS)[:, None]
        one, two = places[walk, self.pairs[:, :, 0]], places[walk, self.pairs[:, :, 1]]
        return arrays.mix(one * self.factors[:, :, 0, None] + two * self.factors[:, :, 1, None]).reshape(WALKS * PAIRS, -1)


def distance_within(pattern: list[int], text: list[int]) -> int:
    """The smallest edit distance between the pattern and any passage of the text (bit-parallel)."""
    size = len(pattern)
    full = (1 << size) - 1
    where: dict[int, int] = {}
    for i, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << i
    up, down, score = full, 0, size
    best = score
    for word in text:
        equal = where.get(word, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        plus = (down | ~(across | up)) & full
        minus = up & across
        if plus >> (size - 1) & 1:
            score += 1
        elif minus >> (size - 1) & 1:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        equal_or_down = equal | down
        up = (minus | ~(equal_or_down | plus)) & full
        down = plus & equal_or_down
        best = min(best, score)
    return best


class ItemIndex:
    """Segments of a bounded block of items by hash, and their rare words."""

    def __init__(self, items: list[tuple[object, str]], min_words: int = MIN_WORDS) -> None:
        hashes, bounds = _words([text for _, text in items])
        # Items of the same words are one class, searched and verified once.
        classes: dict[bytes, tuple[list[object], np.ndarray]] = {}
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b - a >= max(1, min_words):
                classes.setdefault(hashes[a:b].tobytes(), ([], hashes[a:b]))[0].append(items[i][0])
        self.items = list(classes.values())
        pairs = np.array([(w, i) for i, (_, words) in enumerate(self.items) for w in np.unique(words)], np.uint64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        rare, first, numbers = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.rare, self.rare_first, self.rare_count = rare[numbers <= RARE], first[numbers <= RARE], numbers[numbers <= RARE]
        self.rare_item = pairs[:, 1].astype(np.int64)
        self.lengths = np.array([len(words) for _, words in self.items], np.int64)
        self.edits = (self.lengths * MAX_EDITS).astype(np.int64)
        self.needed = np.array([np.isin(words, self.rare).sum() for _, words in self.items], np.int64) - self.edits
        self.sought = np.zeros(1 << _FILTER_BITS, bool)
        self.sought[self.rare >> np.uint64(64 - _FILTER_BITS)] = True
        self.sampled = (self.lengths >= EMBEDDED_WORDS) & (self.needed > 0)
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero(~self.sampled).tolist():
            words = self.items[i][1]
            parts = int(self.edits[i]) + 1
            size = len(words) // parts
            grams = _grams(words, size)
            by_size.setdefault(size, []).extend((int(grams[at]), i, at) for at in (len(words) * part // parts for part in range(parts)))
        self.segments: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # words, filter, hashes in order, their items and offsets
        for size, held in sorted(by_size.items()):
            held.sort()
            hashes = np.array([h for h, _, _ in held], np.uint64)
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.segments.append((size, known, hashes, np.array([i for _, i, _ in held], np.int64), np.array([o for _, _, o in held], np.int64)))

        self._sample()

    def _sample(self) -> None:
        """Keys of the segments of all items that are embedded, by length of segment."""
        self.vocabulary = np.zeros(1 << _FILTER_BITS, bool)  # of embedded items
        cut: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(self.sampled).tolist():
            words = self.items[i][1]
            self.vocabulary[words >> np.uint64(64 - _FILTER_BITS)] = True
            parts = max(1, round(len(words) / SEGMENT))
            edges = [len(words) * part // parts for part in range(parts + 1)]
            for begin, end in zip(edges[:-1], edges[1:]):
                cut.setdefault(end - begin, []).append((i, begin))
        self.tables: list[tuple[Sampler, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.cut_so = np.zeros((len(cut), len(self.items)), bool)  # whether an item has segments of a table's length
        for length, held in sorted(cut.items()):
            sampler = Sampler(length)
            items, offsets = (np.array(column, np.int64) for column in zip(*held))
            flat = np.concatenate([self.items[i][1][o : o + length] for i, o in held])
            self.cut_so[len(self.tables), items] = True
            starts = np.arange(len(held)) * length
            keys = sampler.keys(np.append(flat, np.uint64(0)), starts, starts + length)
            order = np.argsort(keys, axis=None, kind="stable")
            segment = order % len(held)
            known = np.zeros(1 << _FILTER_BITS, bool)
            keys = keys.ravel()[order]
            known[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((sampler, length, known, keys, items[segment], offsets[segment]))

    def _windows(self, words: np.ndarray, bounds: np.ndarray, rare: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the starts of windows inside passages with enough rare words of some item that has segments in it."""
        width = len(words) + 1
        item, place = rare // width, rare % width
        own = self.sampled[item]
        item, place = item[own], place[own]
        row = np.searchsorted(bounds, place, "right") - 1
        # As many rare words of one item as it needs, close enough together for one passage.
        ahead = np.arange(len(item)) + self.needed[item] - 1
        inside = np.flatnonzero(ahead < len(item))
        last = ahead[inside]
        reach = self.lengths[item[inside]] + self.edits[item[inside]]
        run = (item[last] == item[inside]) & (row[last] == row[inside]) & (place[last] - place[inside] < reach)
        inside, last, reach = inside[run], last[run], reach[run]
        low = np.maximum(place[last] - reach + 1, bounds[row[inside]])
        high = np.minimum(place[inside] + reach, bounds[row[inside] + 1])
        # An alignment can start at its first equal word: what the segment loses before it is deleted, not matched.
        known = self.vocabulary[words >> np.uint64(64 - _FILTER_BITS)]
        for has in self.cut_so:
            mine = has[item[inside]]
            # The ranges overlap: +1 where one begins, -1 where it ends.
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, low[mine], 1)
            np.add.at(covered, high[mine], -1)
            yield np.flatnonzero((np.cumsum(covered)[:-1] > 0) & known) if mine.any() else low[mine]

    def _rare_places(self, words: np.ndarray) -> np.ndarray:
        """Where rare words of each item stand, as item x (words + 1) + place, in order."""
        places = np.flatnonzero(self.sought[words >> np.uint64(64 - _FILTER_BITS)])
        slots = np.minimum(np.searchsorted(self.rare, words[places]), max(len(self.rare) - 1, 0))
        if len(places):
            exact = self.rare[slots] == words[places]
            places, slots = places[exact], slots[exact]
        numbers = self.rare_count[slots]
        ends = np.cumsum(numbers)
        item = self.rare_item[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.rare_first[slots] - (ends - numbers), numbers)]
        return np.sort(item * (len(words) + 1) + np.repeat(places, numbers))

    def _matches(self, keys: np.ndarray, known: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``own``, place in ``keys``, which are in order) of equal keys, so many at a time."""
        places = np.flatnonzero(known[own >> np.uint64(64 - _FILTER_BITS)])
        first = np.searchsorted(keys, own[places], "left")
        numbers = np.searchsorted(keys, own[places], "right") - first
        held = numbers > 0
        places, first, numbers = places[held], first[held], numbers[held]
        ends = np.cumsum(numbers)
        start = 0
        while start < len(places):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - numbers[start] + _PIECE, "right")))
            count = numbers[start:stop]
            total = np.cumsum(count)
            yield np.repeat(places[start:stop], count), np.arange(total[-1]) + np.repeat(first[start:stop] - (total - count), count)
            start = stop

    def _candidates(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, where the item would start) of windows that share a key with a segment, if their passage has enough rare words of the item."""
        rare = self._rare_places(words)
        width = len(words) + 1

        def near(place: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, begin = np.searchsorted(bounds, place, "right") - 1, place - offset
            low = np.maximum(begin - self.edits[item], bounds[row])
            high = np.minimum(begin + self.lengths[item] + self.edits[item], bounds[row + 1])
            rare_words = np.searchsorted(rare, item * width + high) - np.searchsorted(rare, item * width + low)
            keep = rare_words >= self.needed[item]
            return row[keep], item[keep], begin[keep]

        for size, known, hashes, items, offsets in self.segments:
            for place, of in self._matches(hashes, known, _grams(words, size)):
                whole = place + size <= bounds[np.searchsorted(bounds, place, "right")]
                yield near(place[whole], items[of[whole]], offsets[of[whole]])
        padded = np.append(words, np.uint64(0))
        for starts, (sampler, length, known, keys, items, offsets) in zip(self._windows(words, bounds, rare), self.tables):
            for first in range(0, len(starts), _WINDOWS):
                begin = starts[first : first + _WINDOWS]
                ends = bounds[np.searchsorted(bounds, begin, "right")]
                own = sampler.keys(padded, begin, np.minimum(begin + length, ends))
                for place, of in self._matches(keys, known, own.ravel()):
                    yield near(begin[place % len(begin)], items[of], offsets[of])

    def search(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, class of items, edits) of every item found in the rows of words; candidates are held a piece at a time."""
        best: dict[tuple[int, int], int] = {}
        for row, item, begin in self._candidates(words, bounds):
            pieces = np.unique(np.stack((row, item, begin)), axis=1)
            edges = np.flatnonzero(np.any(np.diff(pieces[:2], axis=1) != 0, axis=0)) + 1
            for part in np.split(pieces, edges, axis=1) if pieces.shape[1] else ():
                key = (int(part[0, 0]), int(part[1, 0]))
                for edits in self._verified(words, bounds, *key, part[2].tolist()):
                    best[key] = min(edits, best.get(key, edits))
        for (row, item), edits in sorted(best.items()):
            yield row, item, edits

    def _verified(self, words: np.ndarray, bounds: np.ndarray, row: int, item: int, found: list[int]) -> Iterator[int]:
        """The edits of an item in a row, near the places it may start at, if they are few enough."""
        if found:
            pattern = self.items[item][1]
            size, edits = len(pattern), int(len(pattern) * MAX_EDITS)
            vocabulary, best = set(pattern.tolist()), edits + 1
            low = high = None
            for start in [*found, None]:
                if start is not None and low is not None and start - edits <= high:
                    high = max(high, start + size + edits)
                    continue
                if low is not None:  # passages that overlap are verified together
                    passage = words[max(low, bounds[row]) : max(0, min(high, bounds[row + 1]))].tolist()
                    if len(vocabulary.intersection(passage)) >= len(vocabulary) - edits:
                        best = min(best, distance_within(pattern.tolist(), passage))
                if start is not None:
                    low, high = start - edits, start + size + edits
            if best <= edits:
                yield best


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", min_words: int = MIN_WORDS) -> Iterator[ItemIndex]:
    """The benchmark in blocks of about ``BLOCK_BYTES`` of text, each collected and indexed in turn."""
    rows = benchmark.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text")).where("_text is not null")
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for number in range(count):
        held = rows.where(F.pmod(F.xxhash64("_text"), F.lit(count)) == number).distinct().orderBy("_id", "_text").collect()
        index = ItemIndex([(r["_id"], r["_text"]) for r in held], min_words)
        if index.items:
            yield index


def _blocks(benchmark: DataFrame, **options) -> list[Broadcast]:
    """Every block's index as a broadcast of bounded size; the driver holds one index at a time."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(index) for index in item_blocks(benchmark, **options)]


def _cut(column: pa.Array) -> list[tuple[int, arrays.Tokens]]:
    """Texts as words, a slice of rows at a time, with the first row of each."""
    texts = arrays.text_array(column, lower=True)
    return [(first, arrays.tokens(*arrays.slice_bytes(texts, first, last))) for first, last in arrays.slices(texts)]


def _found(index: ItemIndex, column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, class of items, edits) of every class of one block found in the texts."""
    for first, words in _cut(column):
        for row, item, edits in index.search(words.hashes, words.bounds):
            yield first + row, item, edits


def _found_in_blocks(blocks: list[Broadcast], column: pa.Array) -> Iterator[tuple[int, list[object], int, int]]:
    """(row, ids, edits, words) of every class of all blocks; texts are cut into words once.

    A worker holds one index; of several blocks each is read from the executor's disk for
    a batch and dropped after it.
    """
    cut = _cut(column)
    for block in blocks:
        index = block.value
        for first, words in cut:
            for row, item, edits in index.search(words.hashes, words.bounds):
                ids, pattern = index.items[item]
                yield first + row, ids, edits, len(pattern)
        if len(blocks) > 1:
            del index
            del block._value


def contaminations(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", min_words: int = MIN_WORDS) -> DataFrame:
    """id, item id, edits (smallest edit distance in words) and item_words of every pair of a document and an item in it.

    Null and empty texts hold no item; items with a null text or fewer than
    ``min_words`` words are not searched; those of five to nine words may take one edit,
    shorter ones none. A row with a null or repeated id is searched
    like any other; equal rows of the result are not merged. An empty table on either
    side gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    kind, item_kind = rows.schema["_id"].dataType.simpleString(), benchmark.schema[item_column].dataType
    blocks = _blocks(benchmark, id_column=item_column, min_words=min_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, item, edits, words) for row, ids, edits, words in _found_in_blocks(blocks, batch.column(1)) for item in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([None if f[1] is None else str(f[1]) for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([f[3] for f in found], pa.int64()),
                ],
                names=["_id", "_item", "edits", "item_words"],
            )

    out = rows.mapInArrow(arrays.lean(work), f"_id {kind}, _item string, edits long, item_words long")
    return out.select(F.col("_id").alias(id_column), F.col("_item").cast(item_kind).alias(item_column), "edits", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; one pass, whatever the number of blocks."""
    at = docs.columns.index(text_column)
    blocks = _blocks(benchmark, min_words=min_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in _found_in_blocks(blocks, batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(arrays.lean(work), docs.schema)


@query("op5_cgk_decontamination")
def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=1)
