"""Best fuzzy match between two tables of names, by pairs that share a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.text import lcs_length, let, word_set
from tillscope.operators.lookup import attach
from tillscope.operators.matching import MATCH_THRESHOLD
from tillscope.session import written

CELL_ROWS = 2_000
_CLASSES = 31  # of letters, two bits of a signature each


def _described(df: DataFrame, column: str) -> DataFrame:
    """Distinct texts with their word sets, and what bounds the letters two of them can share.

    A bit of ``seen`` says that letters of a class occur, one of 31 more that they occur
    twice; ``over`` counts the letters beyond. No common subsequence of two texts is
    longer than the bits both have plus the smaller of their ``over``.
    """
    texts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("text")).agg(F.count(F.lit(1)).alias("rows"))
    worded = texts.withColumn("words", word_set(F.col("text"))).where(F.size("words") > 0)
    letters = F.transform(F.split(F.array_join("words", " "), ""), lambda c: F.pmod(F.ascii(c), F.lit(_CLASSES)))
    counted = worded.withColumn("_counts", let(letters, lambda found: F.transform(
        F.sequence(F.lit(0), F.lit(_CLASSES - 1)), lambda i: F.size(F.filter(found, lambda c: c == i))
    )))
    seen = F.expr(
        f"aggregate(sequence(0, {_CLASSES - 1}), 0L, (bits, i) -> bits | shiftleft(if(_counts[i] > 0, 1L, 0L), i) | shiftleft(if(_counts[i] > 1, 1L, 0L), i + {_CLASSES}))"
    )
    over = F.aggregate("_counts", F.lit(0), lambda total, n: total + F.greatest(n - 2, F.lit(0)))
    return counted.select("text", "rows", "words", F.length(F.array_join("words", " ")).alias("width"), seen.alias("seen"), over.alias("over"))


def _best_score(mine: Column, theirs: Column, letters: Column, threshold: float) -> Column:
    """The word-set ratio of two word sets that share a word, null where it is surely below the threshold.

    The exact common subsequence is only computed if what is known before leaves it
    open: insertions and deletions are at least as many as edits, and as the letters
    that have no like in the other text; ``letters`` bounds the whole score by those.
    """
    parts = F.struct(
        F.length(F.array_join(F.array_intersect(mine, theirs), " ")).alias("shared"),
        F.array_join(F.array_except(mine, theirs), " ").alias("mine"),
        F.array_join(F.array_except(theirs, mine), " ").alias("theirs"),
        letters.alias("letters"),
    )

    def scored(p: Column) -> Column:
        shared, a, b = p.getField("shared"), p.getField("mine"), p.getField("theirs")
        n_a, n_b = F.length(a), F.length(b)
        whole = 2 * (shared + 1) + n_a + n_b
        by_words = F.greatest(*[F.lit(100.0) * (1 - (1 + n) / (2 * shared + 1 + n)) for n in (n_a, n_b)])
        by_edits = F.lit(100.0) * (1 - F.levenshtein(a, b) / whole)
        full = F.lit(100.0) * (1 - (n_a + n_b - 2 * lcs_length(a, b)) / whole)
        enough = F.greatest(by_words, F.lit(threshold - 1e-9))
        open_ = (p.getField("letters") >= enough) & (by_edits >= enough)
        return F.when((n_a == 0) | (n_b == 0), F.lit(100.0)).when(open_, F.greatest(full, by_words)).when(by_words >= threshold, by_words)

    return let(parts, scored)


def fuzzy_join(
    names: DataFrame,
    targets: DataFrame,
    name_column: str,
    target_column: str,
    threshold: float = MATCH_THRESHOLD,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """name, rows, match and score of every distinct name: its best target by word-set similarity among those that share a word with it.

    A score below the threshold is no match: both are null then. Equal scores go to the
    target that comes first in order of text. Null names are left out; names without a
    word match nothing.

    The inverted index over words joins only pairs with a common word. A word's pairs
    are dealt over cells of ``cell_rows`` names by as many targets, so a word that a third
    of all names has is many tasks' work. A pair is looked at under the first word it
    shares; one comparison of letter signatures and lengths drops most pairs before
    their words are compared, and a bound on the edits most of the rest before the
    exact score.
    """
    left, right = (written(_described(df, c), "names") for df, c in ((names, name_column), (targets, target_column)))
    spread = lambda df: df.withColumn("word", F.explode("words"))
    uses = [spread(df).groupBy("word").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias(c)) for df, c in ((left, "_across"), (right, "_down"))]
    cells = uses[0].join(uses[1], "word")
    cells = written(cells, "words")

    def placed(df: DataFrame, prefix: str, own: str, other: str) -> DataFrame:
        rows = attach(spread(df.drop("rows")), cells, ["word"]).where(F.col(own).isNotNull())
        rows = rows.withColumn("_own", F.pmod(F.xxhash64("text"), F.col(own)).cast("int"))
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        names_ = {c: f"{prefix}_{c}" for c in ("text", "words", "width", "seen", "over")}
        places = [F.col("_own").alias(own), F.col("_other").alias(other)]
        return rows.select("word", *places, *[F.col(c).alias(n) for c, n in names_.items()])

    pairs = placed(left, "a", "_across", "_down").join(placed(right, "b", "_down", "_across"), ["word", "_across", "_down"])
    alike = F.bit_count(F.col("a_seen").bitwiseAND(F.col("b_seen"))) + F.least("a_over", "b_over")
    # Whichever part of the score is highest, it is at most 2 L / (L + the shorter width), L letters being alike.
    pairs = pairs.where(200.0 * alike >= (threshold - 1e-9) * (alike + F.least("a_width", "b_width")))
    pairs = pairs.where(F.array_min(F.array_intersect("a_words", "b_words")) == F.col("word"))
    letters = 200.0 * alike / (F.col("a_width") + F.col("b_width"))
    scored = pairs.select("a_text", "b_text", _best_score(F.col("a_words"), F.col("b_words"), letters, threshold).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy(F.col("a_text").alias("text")).agg(F.min(F.struct((-F.col("score")).alias("order"), "b_text")).alias("_best"))
    distinct = names.where(F.col(name_column).isNotNull()).groupBy(F.col(name_column).cast("string").alias("text")).agg(F.count(F.lit(1)).alias("rows"))
    return distinct.join(best, "text", "left").select(F.col("text").alias("name"), "rows", F.col("_best.b_text").alias("match"), (-F.col("_best.order")).alias("score"))
