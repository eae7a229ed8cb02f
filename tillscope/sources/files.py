"""Folders of CSV files that differ: column order, encoding, records that span lines.

One scan of the raw bytes makes a catalogue with a row per file: its encoding, its
header, and whether quotes stay open over line ends. Files alike in all three are read
together, every column by the name in their own header, and united by name.
"""

from __future__ import annotations

import csv
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.operators.lookup import attach
from tillscope.session import written

HEADER_BYTES = 1 << 16
UTF16_ZEROS = 5  # one byte in so many is zero, at least, in a UTF-16 file
# The characters of bytes 0x80 to 0x9F in cp1252; five bytes have none.
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_SIGNS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CHARSETS = {"ascii": "UTF-8", "utf-8": "UTF-8", "latin1": "ISO-8859-1", "cp1252": "ISO-8859-1", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}


def _bytes_as_signs(line: Column) -> Column:
    return F.decode(line.cast("binary"), "ISO-8859-1")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, id, line) of the lines as the bytes they are, cut at line feeds; ids rise with the lines of a block."""
    lines = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )


def _quotes(line: Column, quote: str, escape: str) -> Column:
    """Quotes of a line but for escaped ones."""
    plain = line if escape == quote else F.replace(line, F.lit(escape + quote), F.lit(""))
    return F.char_length(plain) - F.char_length(F.replace(plain, F.lit(quote), F.lit("")))


def file_catalogue(spark: SparkSession, path: str, quote: str = '"', escape: str = "\\") -> DataFrame:
    """file, lines, encoding, header, open_lines and closed of every file, from one scan that splits large files over tasks.

    The encoding follows from byte order marks, the share of zero bytes and whether they
    come first or second in the header's pairs, whether all bytes decode, and whether bytes 0x80 to 0x9F
    occur, which are letters and marks in cp1252 and nothing in Latin-1. The header is
    the first line as text. ``open_lines`` counts lines with an odd number of quotes;
    ``closed`` says that the quotes of the whole file pair up. Empty files have no row.
    """
    raw = _bytes_as_signs(F.col("line"))
    zeros = F.char_length(raw) - F.char_length(F.replace(raw, F.lit("\x00"), F.lit("")))
    odd = _quotes(raw, quote, escape) % 2
    facts = _lines(spark, path).groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.char_length(raw) + 1).alias("_bytes"),
        F.sum(zeros).alias("_zeros"),
        F.bool_and(F.is_valid_utf8("line")).alias("_valid"),
        F.max(F.rlike(raw, F.lit(r"[\x80-\xff]"))).alias("_high"),
        F.max(F.rlike(raw, F.lit(r"[\x80-\x9f]"))).alias("_low_high"),
        F.max(F.rlike(raw, F.lit(r"[\x81\x8d\x8f\x90\x9d]"))).alias("_undefined"),
        F.sum(odd).alias("open_lines"),
        F.min_by(F.substring(raw, 1, HEADER_BYTES), F.struct("block", "id")).alias("_first"),
    )
    first = F.col("_first")
    places = lambda start: F.sequence(F.lit(start), F.greatest(F.char_length(first), F.lit(start)), F.lit(2))
    zeros_at = lambda start: F.size(F.filter(places(start), lambda i: F.substring(first, i, F.lit(1)) == "\x00"))
    wide = F.col("_zeros") * UTF16_ZEROS > F.col("_bytes")
    encoding = (
        F.when(F.startswith(first, F.lit("\xff\xfe")), "utf-16le")
        .when(F.startswith(first, F.lit("\xfe\xff")), "utf-16be")
        .when(wide & (zeros_at(2) >= zeros_at(1)), "utf-16le")
        .when(wide, "utf-16be")
        .when(~F.col("_high"), "ascii")
        .when(F.col("_valid"), "utf-8")
        .when(F.col("_low_high") & ~F.col("_undefined"), "cp1252")
        .otherwise("latin1")
    )
    found = facts.withColumn("encoding", encoding)
    held = F.encode(first, "ISO-8859-1")
    header = (
        F.when(F.col("encoding") == "utf-16le", F.decode(held, "UTF-16LE"))
        # Up to the line feed, whose first byte ends the line.
        .when(F.col("encoding") == "utf-16be", F.decode(F.substring(held, F.lit(1), F.octet_length(held) - 1), "UTF-16BE"))
        .when(F.col("encoding").isin("ascii", "utf-8"), F.decode(held, "UTF-8"))
        .when(F.col("encoding") == "cp1252", F.translate(first, CP1252_BYTES, CP1252_SIGNS))
        .otherwise(first)
    )
    clean = F.regexp_replace(header, r"^﻿|\r$", "")
    return found.select("file", "lines", "encoding", clean.alias("header"), "open_lines", (F.col("open_lines") % 2 == 0).alias("closed"))


def whole_records(spark: SparkSession, files: list[str], charset: str = "UTF-8", quote: str = '"', escape: str = "\\") -> DataFrame:
    """(file, number, record) of CSV records, line breaks inside quotes included, with large files split over tasks.

    Whether a line begins inside quotes follows from the number of quotes before it: those
    of its block, and by a running sum over one row per block those of earlier blocks.
    Records of one line stay where they are; only lines of longer ones are brought
    together. Numbers count the records of a file from 1. Line breaks inside records
    become line feeds; empty lines between records are left out. Quotes of a file must
    pair up (``closed`` in the catalogue), and a value that holds a quote must stand in quotes.
    """
    lines = _lines(spark, files)
    text = F.col("line") if charset == "UTF-8" else F.decode(F.col("line").cast("binary"), charset)
    lines = lines.withColumn("line", F.regexp_replace(text, r"\r$", "")).withColumn("quotes", _quotes(F.col("line"), quote, escape))
    inside = Window.partitionBy("file", "block").orderBy("id")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("before", before)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Records begun so far in the block, if it begins outside quotes and if it begins inside.
    lines = written(lines.withColumn("run_0", F.count_if(F.col("before") == 0).over(run)).withColumn("run_1", F.count_if(F.col("before") == 1).over(run)), "lines")
    blocks = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"), F.max("run_0").alias("n_0"), F.max("run_1").alias("n_1"))
    # One row per block, and as many in a group as a file has blocks.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    begun = F.when(F.col("inside") == 0, F.col("n_0")).otherwise(F.col("n_1"))
    blocks = blocks.withColumn("begun", begun).withColumn("start", F.coalesce(F.sum("begun").over(earlier), F.lit(0))).select("file", "block", "inside", "start")
    placed = attach(lines, blocks, ["file", "block"])
    placed = placed.withColumn("number", F.col("start") + F.when(F.col("inside") == 0, F.col("run_0")).otherwise(F.col("run_1")))
    begins = (F.col("before") + F.col("inside")) % 2 == 0
    alone = begins & (F.col("quotes") % 2 == 0)
    single = placed.where(alone & (F.col("line") != "")).select("file", "number", F.col("line").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "line")))
    joined = placed.where(~alone).groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p.getField("line")), "\n").alias("record"))
    return single.unionByName(joined)


class _Group(NamedTuple):
    encoding: str
    header: tuple[str, ...]
    split: bool


def _names(header: str, separator: str, quote: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in next(csv.reader([header], delimiter=separator, quotechar=quote), []))


def _named(header: tuple[str, ...], wanted: T.StructType) -> tuple[T.StructType, dict[str, str]]:
    """The schema of files with this header, and the file's name of every wanted column they have (any case, the first of repeated names)."""
    by_name: dict[str, int] = {}
    for i, name in enumerate(header):
        by_name.setdefault(name.lower(), i)
    places = {f.name: by_name[f.name.lower()] for f in wanted.fields if f.name.lower() in by_name}
    kinds = {i: wanted[n].dataType for n, i in places.items()}
    fields = [T.StructField(f"_c{i}", kinds.get(i, T.StringType())) for i in range(len(header))]
    return T.StructType(fields), {n: f"_c{i}" for n, i in places.items()}


def header_groups(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str = ",", quote: str = '"') -> dict[tuple[str, ...], list[str]]:
    """The files of a folder by their header, from their first lines alone."""
    first = _lines(spark, path).where(F.col("block") == 0).groupBy("file").agg(F.min_by("line", "id").alias("line"))
    text = F.make_valid_utf8("line") if encoding.upper() == "UTF-8" else F.decode(F.col("line").cast("binary"), encoding)
    header = F.regexp_replace(text, r"^﻿|\r$", "")
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in first.select("file", header.alias("header")).orderBy("file").collect():
        groups.setdefault(_names(row["header"], separator, quote), []).append(unquote(row["file"]))
    return groups


def _rows(spark: SparkSession, group: _Group, files: list[str], wanted: T.StructType, corrupt: str | None, file_column: str | None, options: dict) -> DataFrame:
    """Files of one group, with the wanted columns."""
    charset = CHARSETS.get(group.encoding, group.encoding)
    physical, names = _named(group.header, wanted)
    if corrupt:
        physical = T.StructType([*physical.fields, T.StructField("_corrupt", T.StringType())])
    parse = {"mode": "PERMISSIVE", **options} | ({"columnNameOfCorruptRecord": "_corrupt"} if corrupt else {})
    if group.split and not charset.startswith("UTF-16"):
        records = whole_records(spark, files, charset, options.get("quote", '"'), options.get("escape", "\\")).where(F.col("number") > 1)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in physical.fields)
        parse = {k: str(v) for k, v in parse.items() if k not in ("multiLine", "lineSep")}
        rows = records.select(F.col("file").alias("_file"), F.from_csv("record", kind, parse).alias("_row")).select("_file", "_row.*")
    else:
        parse |= {"header": True, "encoding": charset} | ({"multiLine": True} if charset.startswith("UTF-16") else {})
        rows = spark.read.options(**parse).schema(physical).csv(files).select(F.col("_metadata.file_path").alias("_file"), "*")

    def cell(f: T.StructField) -> Column:
        value = F.col(names[f.name]) if f.name in names else F.lit(None).cast(f.dataType)
        return (F.translate(value, CP1252_BYTES, CP1252_SIGNS) if group.encoding == "cp1252" and f.dataType == T.StringType() else value).alias(f.name)

    head = [F.col("_file").alias(file_column)] if file_column else []
    return rows.select(*head, *[cell(f) for f in wanted.fields], *([F.col("_corrupt").alias(corrupt)] if corrupt else []))


def scan_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    corrupt: str | None = None,
    file_column: str | None = None,
    **options,
) -> DataFrame:
    """Rows of CSV files with headers, each file's columns found by its own header, in its own encoding, records over lines whole.

    A wanted column that a file lacks is null there, a column that is not wanted is left
    out. ``corrupt`` names a column for the text of rows that do not fit. The list of
    files and their headers passes through the driver, as the list does in every scan.
    A file whose quotes do not pair up is read line by line. UTF-16 files and no others
    are read in one task each.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    quote, escape, separator = options.get("quote", '"'), options.get("escape", "\\"), options.get("sep", ",")
    groups: dict[_Group, list[str]] = {}
    for row in file_catalogue(spark, path, quote, escape).orderBy("file").collect():
        group = _Group(row["encoding"], _names(row["header"], separator, quote), row["open_lines"] > 0 and row["closed"])
        groups.setdefault(group, []).append(unquote(row["file"]))
    return united(spark, groups, wanted, corrupt, file_column, options)


def united(spark: SparkSession, groups: dict[_Group, list[str]], wanted: T.StructType, corrupt: str | None = None, file_column: str | None = None, options: dict | None = None) -> DataFrame:
    """The rows of all groups."""
    parts = [_rows(spark, group, files, wanted, corrupt, file_column, options or {}) for group, files in groups.items()]
    text = lambda name: [T.StructField(name, T.StringType())] if name else []
    out = parts[0] if parts else spark.createDataFrame([], T.StructType([*text(file_column), *wanted.fields, *text(corrupt)]))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_header(spark: SparkSession, groups: dict[tuple[str, ...], list[str]], schema: T.StructType | None, encoding: str, corrupt: str | None, options: dict) -> DataFrame:
    """The rows of files grouped by header; without a schema the types of every group are inferred and a column takes what all of them fit."""
    known = {_Group(encoding, header, False): files for header, files in groups.items()}
    return united(spark, known, schema or _common([_inferred(spark, g.header, f, encoding, options) for g, f in known.items()]), corrupt, None, options)


def _inferred(spark: SparkSession, header: tuple[str, ...], files: list[str], encoding: str, options: dict) -> T.StructType:
    found = spark.read.options(**{**options, "header": True, "inferSchema": True, "encoding": encoding}).csv(files).schema
    return T.StructType([T.StructField(name, undated(f.dataType)) for name, f in zip(header, found.fields)])


def _common(schemas: list[T.StructType]) -> T.StructType:
    kinds: dict[str, T.DataType] = {}
    names: dict[str, str] = {}
    for f in (f for s in schemas for f in s.fields):
        key = f.name.lower()
        one, two = kinds.get(key, f.dataType), f.dataType
        numbers = {T.LongType(), T.DoubleType()}
        kinds[key] = one if one == two else T.DoubleType() if {one, two} <= numbers else T.StringType()
        names.setdefault(key, f.name)
    return T.StructType([T.StructField(names[k], kind) for k, kind in kinds.items()])


def undated(kind: T.DataType) -> T.DataType:
    """Inferred types as a scan gives them: dates stay text, whole numbers are long."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return T.StringType()
    if isinstance(kind, (T.IntegerType, T.NullType)):
        return T.LongType() if isinstance(kind, T.IntegerType) else T.StringType()
    return kind
