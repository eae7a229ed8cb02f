"""CSV files: typed scan, encodings, load checks and metadata."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.sources import files

# Row bounds of a load.
MIN_ROWS, MAX_ROWS = 1, 1_000_000


class LoadError(ValueError):
    """A file that cannot be loaded as asked."""


def csv_scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
    corrupt: str | None = None,
    by_name: bool = True,
    **options,
) -> DataFrame:
    """Rows of CSV files with a header; dates stay text until they are parsed on purpose.

    Give a schema at scale: without one the files are read an extra time to infer it.
    Columns are found by name: the first lines are read ahead, and files of other headers
    than the schema's, or than each other's, are read by their own and united.
    ``by_name=False`` takes all files to have the columns of the schema in its order.
    ``corrupt`` names a column for the raw text of rows that do not fit the schema,
    which ``load_checks`` counts. Records with quoted line breaks need ``multiLine=True``,
    which reads each file in one task; ``files.scan_files`` reads those in many, and
    detects encodings.
    """
    options = {"mode": "PERMISSIVE", **options}
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if by_name:
        groups = files.header_groups(spark, path, encoding, options.get("sep", ","), options.get("quote", '"'))
        alike = len(groups) <= 1 and (schema is None or all([n.lower() for n in header] == [n.lower() for n in schema.names] for header in groups))
        if not alike:
            return files.by_header(spark, groups, schema, encoding, corrupt, options)
    reader = spark.read.options(header=True, encoding=encoding, **options)
    if schema is None:
        inferred = reader.option("inferSchema", True).csv(path).schema
        schema = T.StructType([T.StructField(f.name, files.undated(f.dataType)) for f in inferred.fields])
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).csv(path)


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """Per file its lines and those with an odd number of quotes: more than none calls for ``multiLine``."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return _raw_lines(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(quotes % 2 == 1).alias("open_lines"))


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as the bytes they are, with their file; large files are split over tasks."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def encoding_audit(spark: SparkSession, path: str) -> DataFrame:
    """The encoding of each file: utf-8 where every byte decodes, else latin1.

    A line break byte never lies inside a UTF-8 character, so lines can be
    checked one by one and a file need not fit into one task.
    """
    lines = _raw_lines(spark, path).select("file", F.is_valid_utf8("line").alias("valid"))
    kinds = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.bool_and("valid").alias("valid"))
    return kinds.select("file", "lines", F.when(F.col("valid"), "utf-8").otherwise("latin1").alias("encoding"))


def csv_scan_any(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, **options) -> DataFrame:
    """Rows of CSV files in mixed encodings, each file read in its own; the file comes first in every row.

    Columns are found by the header of each file (``files.scan_files``). Without headers
    they are those of the schema in order, in UTF-8 or Latin-1, and records over lines
    need ``multiLine=True``.
    """
    if header:
        return files.scan_files(spark, path, schema, file_column="file", **options)
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    groups: dict[str, list[str]] = {"utf-8": [], "latin1": []}
    for row in encoding_audit(spark, path).orderBy("file").collect():
        groups[row["encoding"]].append(unquote(row["file"]))
    out = spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), *schema.fields]))
    for encoding, name in (("utf-8", "UTF-8"), ("latin1", "ISO-8859-1")):
        if groups[encoding]:
            reader = spark.read.options(**{"header": header, "encoding": name, "mode": "PERMISSIVE", **options}).schema(schema)
            rows = reader.csv(groups[encoding])
            out = out.unionByName(rows.select(F.col("_metadata.file_path").alias("file"), *[F.col(f"`{c}`") for c in schema.fieldNames()]))
    return out


def load_checks(
    df: DataFrame, name: str, min_rows: int = MIN_ROWS, max_rows: int = MAX_ROWS, corrupt: str | None = None
) -> DataFrame:
    """Row count against the bounds; too many rows is a warning, not a limit.

    With the name of the scan's column of corrupt records, their number too; any makes the load fail.
    """
    if corrupt:
        broken = F.count_if(F.col(corrupt).isNotNull())
        # A cell is only parsed, and found broken, if its column is asked for: so all of them are counted.
        known = sum((F.count(F.col(f"`{c}`")) for c in df.columns if c != corrupt), F.lit(0))
        checked = df.agg(F.count(F.lit(1)).alias("rows"), broken.alias("corrupt_rows"), known.alias("_known")).where("_known >= 0")
        return checked.select(
            F.lit(name).alias("table"),
            "rows",
            "corrupt_rows",
            F.when(F.col("corrupt_rows") > 0, "corrupt rows").otherwise("ok").alias("status"),
            ((F.col("rows") >= min_rows) & (F.col("corrupt_rows") == 0)).alias("loadable"),
        )
    rows = F.col("rows")
    status = (
        F.when(rows == 0, "empty").when(rows < min_rows, "too few rows").when(rows > max_rows, "more rows than usual")
    )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.coalesce(status, F.lit("ok")).alias("status"), (rows >= min_rows).alias("loadable")
    )


def require_rows(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Fail a load that has too few rows, reading no more than that many."""
    if df.limit(min_rows).count() < min_rows:
        raise LoadError(f"fewer than {min_rows} rows")
    return df


def load_metadata(df: DataFrame, date_column: str | None = None, timed: bool = False) -> DataFrame:
    """File name (or the number of files), size in rows and columns, column types and date range of a load; with ``timed`` also when."""
    types = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    dated = F.col(date_column).cast("date") if date_column else F.lit(None).cast("date")
    named = df.select(F.col("_metadata.file_name").alias("_file"), dated.alias("_date"))
    one = F.min("_file") == F.max("_file")
    at = [F.max(F.current_timestamp()).alias("loaded_at")] if timed else []
    return named.agg(
        *at,
        F.when(one, F.max("_file")).otherwise(F.concat(F.count_distinct("_file"), F.lit(" files"))).alias("filename"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(types).alias("column_types"),
        F.lit(date_column).alias("date_column"),
        F.date_format(F.min("_date"), "yyyy-MM-dd").alias("date_start"),
        F.date_format(F.max("_date"), "yyyy-MM-dd").alias("date_end"),
    )
