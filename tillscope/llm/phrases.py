"""Phrase mining on relations of occurrences, in the manner of SETM.

An occurrence is a row (row_key, at, gram): the gram starts at place ``at`` of the text.
Marks that end a piece take a place of their own, so two occurrences at adjacent places
lie in one piece. Relations are written in buckets of whole texts, sorted by text and
place, and grow by one word a turn:

* merge join: one pass over the sorted relation puts every occurrence beside the one at
  the next place; two k-grams that overlap in all but one word are a (k+1)-gram;
* group count: occurrences of each such pair are summed before they are shuffled;
* semi-join: only occurrences of frequent pairs make up the next relation.

The relation of single words is the only one that is shuffled; later ones are computed
bucket by bucket. A word or pair that is frequent enough to fill a task is in the part
of the table that is broadcast (all of a small one, else the ``HOT_ROWS`` most frequent);
the others meet the occurrences by a plain shuffle, where none has more than
1 / HOT_ROWS of all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.registry import query
from tillscope.operators.lookup import attach, fits_broadcast
from tillscope.session import work_folder, written

MIN_COUNT = 30
MAX_WORDS = 4
INSIDE_PERCENT = 80  # a phrase that a longer one covers to this share is dropped
TOP = 2000
HOT_ROWS = 200_000
# A bucket of one file is read in the order it was written in; otherwise Spark sorts it anew for every merge.
SCAN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOT_BYTES = 64  # of a word; longer ones are not broadcast
# The lowest score of all cuts, floor(2000000 a / (l + r)), the first of equal ones; whole numbers of 38 digits on the way.
CUT = (
    "array_min(transform(sequence(1, size(firsts)), k -> struct("
    "(cast(2000000 as decimal(18,0)) * a) div (cast(firsts[k - 1] as decimal(20,0)) + rests[k - 1]) as score, k, firsts[k - 1] as l, rests[k - 1] as r)))"
)


def _occurrences(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """(row_key, lang, at, word) of every word as it is written; piece ends leave gaps in the places."""
    parted = F.regexp_replace(F.col(text_column).cast("string"), r"[.,;:!?\n\x0B\f\r]", " \n ")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.split(parted, r"[ \t]+").alias("_words"),
    )
    words = rows.select("row_key", "lang", F.posexplode("_words").alias("at", "word"))
    return words.where((F.col("word") != "") & (F.col("word") != "\n"))


class Relation:
    """Occurrences in buckets of whole texts, sorted by text and place, in shared storage."""

    def __init__(self, rows: DataFrame, buckets: int, dealt: bool) -> None:
        spark = rows.sparkSession
        self.name = f"occurrences_{uuid.uuid4().hex}"
        if not dealt:
            rows = rows.repartition(buckets, "row_key")
        writer = rows.write.bucketBy(buckets, "row_key").sortBy("row_key", "at")
        writer.option("path", work_folder(spark, "occurrences")).saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def forget(self) -> None:
        """Take the name back; the files are left to the folder's retention."""
        self.rows.sparkSession.sql(f"drop table if exists {self.name}")

    def adjacent(self) -> DataFrame:
        """(row_key, at, head, tail) of occurrences at adjacent places: the relation merged with itself, one place on."""
        following = Window.partitionBy("row_key").orderBy("at")
        beside = self.rows.select("row_key", "at", F.col("gram").alias("head"), F.lead("at").over(following).alias("_next"), F.lead("gram").over(following).alias("tail"))
        return beside.where(F.col("_next") == F.col("at") + 1).drop("_next")


def semi_joined(rows: DataFrame, frequent: DataFrame, keys: list[str], hot_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Rows whose keys are frequent, with ``gram``; and whether they stayed in their partitions.

    A small table of keys is broadcast, of a larger one the ``hot_rows`` most frequent
    (None: ``HOT_ROWS``). Rows of the others are shuffled by key.
    """
    held = frequent.select(*keys, "gram", "a")
    if hot_rows is None and fits_broadcast(held):
        return rows.join(F.broadcast(held.drop("a")), keys), True
    short = sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(0)) <= _HOT_BYTES
    hot = written(held.where(short).orderBy(F.desc("a"), "gram", *keys).limit(HOT_ROWS if hot_rows is None else hot_rows), "hot")
    cold = held.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    marked = rows.join(F.broadcast(hot.drop("a")), keys, "left")
    rest = marked.where("gram is null").drop("gram").join(cold.drop("a"), keys)
    return marked.where("gram is not null").unionByName(rest), False


def _numbered(grams: DataFrame, name: str) -> DataFrame:
    """The grams written once, each with a number of its own."""
    return written(grams.withColumn("gram", F.monotonically_increasing_id()), name)


def _words(occurrences: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words as written with their counts, the frequent words in lower case (A-Z), and the gram of each word as written."""
    seen = written(occurrences.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("a")).withColumn("phrase", F.translate("word", _UPPER, _LOWER)), "words")
    nothing = F.array().cast("array<bigint>")
    frequent = seen.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    frequent = _numbered(frequent.select("lang", "phrase", "a", nothing.alias("firsts"), nothing.alias("rests")), "grams-1")
    return seen, frequent, written(seen.join(frequent.select("lang", "phrase", "gram"), ["lang", "phrase"]).drop("phrase"), "dictionary")


def _longer(pairs: DataFrame, known: DataFrame, min_count: int) -> DataFrame:
    """Frequent pairs of adjacent grams as grams: phrase, a, and for every cut the counts of its first part and its rest."""
    counts = pairs.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= min_count)
    one = known.select(F.col("gram").alias("head"), "lang", F.col("phrase").alias("_first"), F.col("a").alias("_l"), "firsts")
    two = known.select(F.col("gram").alias("tail"), F.substring_index("phrase", " ", -1).alias("_last"), F.col("a").alias("_r"), "rests")
    return counts.join(one, "head").join(two, "tail").select(
        "head", "tail", "lang", F.concat_ws(" ", "_first", "_last").alias("phrase"), "a",
        F.concat("firsts", F.array("_l")).alias("firsts"), F.concat(F.array("_r"), "rests").alias("rests"),
    )


def _outside(grams: DataFrame, longer: DataFrame | None, inside_percent: int) -> DataFrame:
    """Grams that no gram one word longer covers to the given share; one longer still is not more frequent than that."""
    if longer is None:
        return grams
    around = longer.select(F.explode(F.array("head", "tail")).alias("gram"), F.col("a").alias("_around")).groupBy("gram").agg(F.max("_around").alias("_around"))
    covered = F.lit(100).cast("decimal(20,0)") * F.col("_around") >= F.lit(inside_percent).cast("decimal(20,0)") * F.col("a")
    return grams.join(around, "gram", "left").where(~F.coalesce(covered, F.lit(False)))


def mine(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    inside_percent: int = INSIDE_PERCENT,
    hot_rows: int | None = None,
) -> DataFrame:
    """lang, phrase, words, a, l, r, n and score of every phrase of 2 to ``max_words`` words with at least ``min_count`` occurrences.

    Texts are cut into pieces and words as the query says; a null language is ``und``.
    The score of a phrase is the lowest of its cuts, floor(2000000 a / (l + r)), at the
    first of equal ones. Phrases that a longer one covers are left out. Null and empty
    texts have no words; repeated rows count each; an empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = spark.conf.get(SCAN_ORDER, "false")
    occurrences = _occurrences(docs, text_column, lang_column)
    seen, grams, dictionary = _words(occurrences, min_count)
    turns, relations = [grams], []
    try:
        spark.conf.set(SCAN_ORDER, "true")
        rows, _ = semi_joined(occurrences, dictionary, ["lang", "word"], hot_rows)
        relations.append(Relation(rows.select("row_key", "at", "gram"), buckets, False))
        for words in range(2, max_words + 1):
            pairs = relations[-1].adjacent()
            turns.append(_numbered(_longer(pairs, turns[-1], min_count), f"grams-{words}"))
            if words < max_words:
                rows, dealt = semi_joined(pairs, turns[-1], ["head", "tail"], hot_rows)
                relations.append(Relation(rows.select("row_key", "at", "gram"), buckets, dealt))
    finally:
        spark.conf.set(SCAN_ORDER, ordered)
        for relation in relations:
            relation.forget()
    found = None
    for words, grams in enumerate(turns[1:], 2):
        kept = _outside(grams, turns[words] if words < max_words else None, inside_percent)
        part = kept.withColumn("_cut", F.expr(CUT)).select("lang", "phrase", F.lit(words).alias("words"), "a", "_cut.l", "_cut.r", "_cut.score")
        found = part if found is None else found.unionByName(part)
    return attach(found, seen.groupBy("lang").agg(F.sum("a").alias("n")), ["lang"])


_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents),
listed as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from pieces),
spread as (select lang, w, unnest(range(1, len(w) + 1)) as i from listed),
grams as (select lang, w[i:i + k - 1] as g, k, count(*) as f from spread, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(w) group by all),
totals as (select lang, sum(f) as n from grams where k = 1 group by lang),
frequent as (select * from grams where f >= 30),
cuts as (
  select c.lang, c.g, c.k, c.f as a, l.f as l, r.f as r, cut, 2000000::hugeint * c.f // (l.f::hugeint + r.f) as score
  from (select *, unnest(range(1, k)) as cut from frequent where k > 1) c
  join frequent l on l.lang = c.lang and l.g = c.g[1:cut] join frequent r on r.lang = c.lang and r.g = c.g[cut + 1:c.k]),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, cut) = 1),
inner_parts as (
  select lang, f, g[i:i + m - 1] as part from (select lang, g, f, k, m, unnest(range(1, k - m + 2)) as i from frequent, (select unnest([2, 3]) as m) where k > m)),
covered as (select lang, part as g, max(f) as around from inner_parts group by all),
kept as (select b.* from best b left join covered c on c.lang = b.lang and c.g = b.g where c.around is null or 100::hugeint * c.around < 80::hugeint * b.a),
ranked as (
  select *, array_to_string(g, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from kept)
select lang, rank, phrase, a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""


@query("op13_phrase_mining", _SQL)
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = mine(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rank", F.row_number().over(ordered).cast("long"))
    return ranked.where(F.col("rank") <= TOP).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
