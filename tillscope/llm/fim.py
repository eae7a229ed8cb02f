"""Fill-in-the-middle with a learned rank index.

A text is a row of units (runs of ASCII letters, every other sign by itself). To cut it
after a unit of given number, the byte offset of that boundary is needed. An index
learned from all boundaries of a slice of texts gives it: straight segments, each fitted
so that no boundary lies more than ``ERROR`` bytes off its line, and for every boundary
the stored residual of its prediction, one byte each. A cut is predicted from the
segment that holds its rank and corrected by the residual, so it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import arrays
from tillscope.llm.registry import query

ERROR = 48  # bytes; residuals fit one signed byte
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SEED = 1
_STEP = 1 << 10  # boundaries tried at a time


class RankIndex:
    """Offsets by rank: error-bounded straight segments and the residual of every offset."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR) -> None:
        firsts, slopes = [], []
        first = 0
        while first < len(offsets):
            low, high, slope, held = -np.inf, np.inf, 0.0, 1
            while first + held < len(offsets):
                rise = (offsets[first + held : first + held + _STEP] - offsets[first]).astype(np.float64)
                run = np.arange(held, held + len(rise))
                # The cone of slopes that pass within the error of all boundaries so far; it only narrows.
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                fits = int(np.argmax(np.append(lows > highs, True)))
                if fits:
                    low, high, held = lows[fits - 1], highs[fits - 1], held + fits
                    slope = (low + high) / 2
                if fits < len(rise):
                    break
            firsts.append(first)
            slopes.append(slope)
            first += held
        self.firsts, self.slopes = np.array(firsts, np.int64), np.array(slopes, np.float64)
        self.bases = offsets[self.firsts]
        self.residuals = np.zeros(len(offsets), np.int8)
        self.residuals = (offsets - self.predicted(np.arange(len(offsets)))).astype(np.int8)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.bases[segment] + np.rint(self.slopes[segment] * (ranks - self.firsts[segment])).astype(np.int64)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residuals[ranks]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units of UTF-8 texts start, and the first unit of each text (one more at the end)."""
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    fresh = (data & 0xC0) != 0x80
    fresh[1:] &= ~(letter[1:] & letter[:-1])
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh)
    return starts, np.searchsorted(starts, offsets)


def _numbers(seed: int, id_column: str) -> list[Column]:
    """Four 32-bit numbers of a row, from the digest of seed and id (null: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def _transformed(texts: pa.Array, h: np.ndarray, plain_percent: int, spm_percent: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a slice of texts."""
    data, offsets = arrays.slice_bytes(texts, 0, len(texts))
    starts, bounds = units(data, offsets)
    counts = np.diff(bounds)
    index = RankIndex(np.append(starts, len(data)).astype(np.int64))
    marked = np.zeros(len(texts), bool)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
    plain = marked | (counts == 0) | (h[2] % 100 >= 100 - plain_percent)
    spm = ~plain & (h[3] % 100 < spm_percent)
    one, two = h[0] % (counts + 1), h[1] % (counts + 1)
    low, high = index[bounds[:-1] + np.minimum(one, two)], index[bounds[:-1] + np.maximum(one, two)]
    signs = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    raw = data.tobytes()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for a, b, c, d, straight, suffix_first in zip(offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist()):
        if straight:
            out.append(raw[a:d])
        elif suffix_first:
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [
        pa.array(counts, pa.int64()),
        pa.array(form.tolist(), pa.string()),
        pa.array(signs[low] - signs[offsets[:-1]], pa.int64(), mask=plain),
        pa.array(signs[high] - signs[low], pa.int64(), mask=plain),
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars and output of every text.

    Where to cut, and the form, follow from the digest of seed and id, so a row's result
    depends on nothing else. Null texts count as empty; empty texts and texts that hold a
    marker stay as they are (form plain, no counts of signs). Rows with a null id take
    the digest of the seed alone; rows that repeat an id are cut by the same numbers. An
    empty table gives no rows. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.text_array(batch.column(1))
            numbers = np.stack([batch.column(i).to_numpy() for i in range(2, 6)])
            for first, last in arrays.slices(texts):
                found = _transformed(texts.slice(first, last - first), numbers[:, first:last], plain_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *found], names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"), *_numbers(seed, id_column))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(arrays.lean(work), schema).withColumnRenamed("_id", id_column)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from, from the output and its form alone.

    A transformed text holds no marker, so the first marker of a kind is the one put in.
    """

    def after(text: Column, head: Column, marker: str) -> Column:
        return F.substring(text, F.char_length(head) + F.lit(len(marker) + 1), F.char_length(text))

    body = F.substring(output, F.lit(len(PREFIX) + 1), F.char_length(output))
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = after(body, first, SUFFIX)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, second, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


_SQL = """
with numbered as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as unit,
         [cast('0x' || substr(sha256('1:' || coalesce(cast(doc_id as varchar), '')), 1 + 8 * i, 8) as bigint) for i in [0, 1, 2, 3]] as h
  from documents),
cut as (
  select *, len(unit) as n, least(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) as p, greatest(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) as q,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain'
              when h[4] % 100 < 20 then 'spm' else 'psm' end as form
  from numbered),
parts as (
  select *, array_to_string(unit[1:p], '') as prefix, array_to_string(unit[p + 1:q], '') as middle, array_to_string(unit[q + 1:n], '') as suffix from cut)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""


@query("op11_fill_in_middle", _SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for infilling, with digests of the outputs and of what they give back."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
