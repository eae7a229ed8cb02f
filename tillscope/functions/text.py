"""Text columns: title case, names, similarity, Markdown pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def title_case(text: Column) -> Column:
    """Capitalise the first letter of every run of letters, lower the rest.

    Spark's initcap starts a word after a space only, so the text is cut where a
    letter follows any other sign, and every piece is capitalised by itself.
    """
    pieces = F.split(F.lower(text), r"(?<=[^\p{L} ])(?=\p{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def standardize(text: Column) -> Column:
    """Trimmed, title-cased, with single spaces."""
    return title_case(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalize_name(name: Column) -> Column:
    """A column name as spaced title-case words."""
    spaced = F.regexp_replace(name, "[_-]", " ")
    plain = F.regexp_replace(spaced, r"[^A-Za-z0-9\s]", "")
    split = F.when(F.contains(plain, F.lit(" ")), plain).otherwise(F.regexp_replace(plain, "(?<!^)(?=[A-Z])", " "))
    return strip(F.regexp_replace(title_case(split), r"\s+", " "))


def word_set(text: Column) -> Column:
    """The distinct words of a text in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != "")))


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence, one table row per letter of ``left``."""
    letters = F.split(right, "")
    width = F.length(right)

    def next_row(row: Column, letter: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), width),
            F.array(F.lit(0)),
            lambda done, j: F.concat(
                done,
                F.array(
                    F.when(F.get(letters, j - 1) == letter, F.get(row, j - 1) + 1).otherwise(
                        F.greatest(F.get(row, j), F.element_at(done, -1))
                    )
                ),
            ),
        )

    table = F.aggregate(
        F.split(left, ""), F.array_repeat(F.lit(0), width + 1), next_row, lambda row: F.element_at(row, -1)
    )
    return F.when((F.length(left) == 0) | (width == 0), F.lit(0)).otherwise(table)


def indel_ratio(left: Column, right: Column) -> Column:
    """100 * 2 * LCS / (m + n); two empty texts are alike."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(left, right) / total)


def token_set_ratio(left: Column, right: Column) -> Column:
    """0-100 similarity of word sets.

    Shared words score against each side's remainder; one side's words being
    a subset of the other's gives 100.
    """
    words = F.struct(word_set(left).alias("mine"), word_set(right).alias("theirs"))
    return let(words, _score_words)


def _score_words(words: Column) -> Column:
    mine, theirs = words.getField("mine"), words.getField("theirs")
    parts = F.struct(
        F.array_join(F.array_intersect(mine, theirs), " ").alias("shared"),
        F.array_join(F.array_except(mine, theirs), " ").alias("mine"),
        F.array_join(F.array_except(theirs, mine), " ").alias("theirs"),
    )
    return F.when((F.size(mine) == 0) | (F.size(theirs) == 0), F.lit(0.0)).otherwise(let(parts, _score_parts))


def _score_parts(parts: Column) -> Column:
    only_mine, only_theirs = parts.getField("mine"), parts.getField("theirs")
    n_shared = F.length(parts.getField("shared"))
    n_mine, n_theirs = F.length(only_mine), F.length(only_theirs)
    space = F.when(n_shared > 0, 1).otherwise(0)
    edits = n_mine + n_theirs - 2 * lcs_length(only_mine, only_theirs)
    full = F.lit(100.0) * (1 - edits / (2 * (n_shared + space) + n_mine + n_theirs))
    with_mine = F.lit(100.0) * (1 - (space + n_mine) / (2 * n_shared + space + n_mine))
    with_theirs = F.lit(100.0) * (1 - (space + n_theirs) / (2 * n_shared + space + n_theirs))
    return (
        F.when((n_shared > 0) & ((n_mine == 0) | (n_theirs == 0)), F.lit(100.0))
        .when(n_shared == 0, full)
        .otherwise(F.greatest(full, with_mine, with_theirs))
    )


def strip_markup(text: Column) -> Column:
    """Bold and italic marks to tags, heading marks removed, line breaks to tags."""
    bold = F.regexp_replace(text, r"\*\*([^*]+)\*\*", "<b>$1</b>")
    italic = F.regexp_replace(bold, r"\*([^*]+)\*", "<i>$1</i>")
    plain = F.regexp_replace(italic, r"(?dm)^#{1,6}\s+", "")
    return F.replace(plain, F.lit("\n"), F.lit("<br/>"))
