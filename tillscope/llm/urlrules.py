"""URL filter: listed rules first, then association rules mined from labelled URLs.

A URL is a set of tokens: its scheme and the words of host, path and query, each marked
with its part, numbers as one token. FP-growth finds the sets of tokens that are
frequent among labelled URLs; a set whose URLs are mostly bad is a rule. Rules need
``MIN_SUPPORT`` of the labelled URLs (and ``MIN_COUNT`` of them) and ``MIN_CONFIDENCE``;
a rule that a shorter one of no less confidence implies is dropped. Tokens that always
occur together count as one and those of every URL as none, so sets don't multiply.

Rules are matched by an inverted index: each rule is filed under its rarest token, a URL
looks up its tokens, and the rules found are compared with all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.registry import query
from tillscope.operators.lookup import attach, fits_broadcast
from tillscope.session import written

# Verdict, host and path of the listed rules.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.005, 30, 0.8
_BAD = "="  # no token: those begin with their part
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "tokens array<string>, confidence double, support double, filed string"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.char_length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = LISTED) -> tuple[Column, Column]:
    """Name and verdict of the longest rule whose host is the given one or one above it, and whose path the given one starts with."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; null has none."""

    def words(text: Column, part: str) -> Column:
        found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
        numbered = F.transform(found, lambda w: F.when(F.rlike(w, F.lit(r"^\p{N}+$")), "0").otherwise(w))
        return F.transform(F.filter(numbered, lambda w: w != ""), lambda w: F.concat(F.lit(part), w))

    rest = _rest(url)
    asked = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    scheme = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise("")
    return F.array_distinct(F.concat(*[words(F.coalesce(t, F.lit("")), p) for t, p in ((scheme, "s:"), (host_of(url), "h:"), (path_of(url), "p:"), (asked, "q:"))]))


def _items(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(items) of every labelled URL, and (token, n) of the tokens kept: frequent, not in every URL, one of those that occur together."""
    rows = written(labelled.select(F.monotonically_increasing_id().alias("row"), "bad", tokens(F.col("url")).alias("tokens")), "labelled-urls")
    total = rows.count()
    spread = rows.select("row", F.explode("tokens").alias("token"))
    where = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("_rows"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("_rows2"))
    together = where.where((F.col("n") >= least) & (F.col("n") < total)).groupBy("n", "_rows", "_rows2").agg(F.min("token").alias("token"))
    kept = written(together.select("token", "n"), "url-tokens")
    held = spread.join(F.broadcast(kept) if fits_broadcast(kept) else kept, "token").groupBy("row").agg(F.collect_list("token").alias("_held"))
    items = rows.select("row", "bad").join(held, "row", "left").select(F.concat(F.coalesce("_held", F.array()), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array())).alias("items"))
    return items, kept


def _fired(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, and the columns of the rule) of every rule all of whose tokens a row of (key, tokens) has."""
    filed = F.broadcast(rules) if fits_broadcast(rules) else rules
    looked = rows.select(key, F.col("tokens").alias("_tokens"), F.explode("tokens").alias("filed")).join(filed, "filed")
    return looked.where(F.size(F.array_except("tokens", "_tokens")) == 0).drop("_tokens")


def mine(
    labelled: DataFrame,
    url_column: str = "url",
    bad_column: str = "bad",
    min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Rules (tokens, confidence, support, filed): sets of tokens whose labelled URLs are bad with at least ``min_confidence``.

    ``bad_column`` is a boolean; rows without it, or without a URL, teach nothing. Support
    is the share of labelled URLs that are bad and have the tokens. Repeated rows count
    each. An empty table gives no rules. Single frequent tokens pass through the driver,
    as FP-growth has it: at most the tokens of a URL on average / ``min_support``.
    """
    spark = labelled.sparkSession
    known = labelled.select(F.col(url_column).cast("string").alias("url"), F.col(bad_column).cast("boolean").alias("bad")).where("url is not null and bad is not null")
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    least = max(min_count, int(min_support * sizes["n"]))
    if sizes["bad"] < least:
        return spark.createDataFrame([], _RULE)
    items, kept = _items(known, least)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=least / sizes["n"], minConfidence=min_confidence, numPartitions=parts).fit(items)
    found = model.associationRules.where(F.array_contains("consequent", _BAD)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    found = written(found, "url-rules")
    numbers = found.select("tokens", F.explode("tokens").alias("token")).join(kept, "token")
    rarest = numbers.groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("filed"))
    rules = written(found.join(rarest, "tokens").select("tokens", "confidence", "support", "filed"), "url-rules")
    longer = rules.select(F.struct("tokens", "confidence").alias("_rule"), "tokens")
    implied = _fired(longer, rules, "_rule").where((F.size("tokens") < F.size("_rule.tokens")) & (F.col("confidence") >= F.col("_rule.confidence")))
    return written(rules.join(implied.select(F.col("_rule.tokens").alias("tokens")).distinct(), "tokens", "left_anti"), "url-rules")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", listed_rules: Sequence[tuple[str, str, str]] = LISTED) -> DataFrame:
    """id, host, path, rule, verdict, mined (tokens of the mined rule that decides) and confidence of every row.

    A listed rule decides if one fits. Else a URL is blocked if a mined rule fires (the
    one of highest confidence, support and then tokens is named), and allowed if none
    does. A null URL, and one without ``://``, has an empty host and path, which no listed
    rule fits. Null and repeated ids are kept row by row; an empty table gives no rows.
    """
    url = F.col(url_column).cast("string")
    rows = pages.select(F.col(id_column).alias("_id"), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = listed(F.col("host"), F.col("path"), listed_rules)
    rows = rows.withColumn("rule", name).withColumn("_listed", verdict)
    unlisted = rows.where("rule is null and _url is not null").select("_url", tokens(F.col("_url")).alias("tokens"))
    best = F.max(F.struct("confidence", "support", F.col("tokens").alias("mined")))
    fired = _fired(unlisted, rules, "_url").groupBy("_url").agg(best.alias("_best"))
    out = attach(rows, fired.select("_url", F.lit(False).alias("_none"), "_best.mined", "_best.confidence"), ["_url"])
    open_row = F.col("_listed").isNull()
    return out.select(
        F.col("_id").alias(id_column), "host", "path", "rule",
        F.coalesce("_listed", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(open_row, F.col("mined")).alias("mined"), F.when(open_row, F.col("confidence")).alias("confidence"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose document is labelled: the number that ends a page's path is the id of its document.

    A document is bad if any of its labels says so: quality 0 or toxic 1.
    """
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.bool_or(bad).alias("bad"))
    number = F.expr("try_cast(_number as bigint)")
    numbered = pages.select("url", F.regexp_extract(path_of(F.col("url")), r"/([0-9]+)(?:\.[A-Za-z]+)?/?$", 1).alias("_number")).select("url", number.alias("doc_id"))
    return numbered.where("doc_id is not null").join(known, "doc_id").select("url", "bad")


@query("op12_url_rules")
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = mine(labelled_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judge(pages, rules)
