"""Holidays as rules that are evaluated for every year, with windows around them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A holiday of every year between ``first_year`` and ``last_year``.

    ``kind`` says how its day is found; ``offset`` days are added.
    fixed: ``month`` and ``day``. weekday: the ``nth`` ``weekday`` (1 is Monday) of the
    month, from its end if negative. before, after: the ``weekday`` on or before, on or
    after a day. easter, orthodox: Easter Sunday of the western and eastern churches.
    ``observed`` moves a day off the weekend: ``nearest`` to Friday or Monday, ``monday``
    to Monday. ``before`` and ``after`` are the days around it that it has an effect on.
    A day of one year only is a fixed rule of that year.
    """

    name: str
    impact: str = "neutral"
    kind: str = "fixed"
    month: int | None = None
    day: int | None = None
    weekday: int | None = None
    nth: int | None = None
    offset: int = 0
    observed: str = ""
    before: int = 0
    after: int = 0
    first_year: int | None = None
    last_year: int | None = None


SCHEMA = (
    "name string, impact string, kind string, month int, day int, weekday int, nth int, offset int, observed string, before int, after int, "
    "first_year int, last_year int"
)


def _weekday(name, month, weekday, nth, impact="neutral", **more):
    return Rule(name, impact, "weekday", month, None, weekday, nth, **more)


def _fixed(name, month, day, impact="neutral", **more):
    return Rule(name, impact, "fixed", month, day, **more)


def _easter(name, offset=0, impact="neutral", **more):
    return Rule(name, impact, "easter", offset=offset, **more)


# The shopping calendar by the rules its days follow, with the impacts of the fixed table.
SHOPPING = (
    _fixed("New Year's Day", 1, 1), _fixed("Valentine's Day", 2, 14, "positive", before=7), _easter("Easter", 0, "positive", before=7),
    _weekday("Mother's Day", 5, 7, 2, "positive", before=7), _weekday("Memorial Day", 5, 1, -1, "positive", before=3),
    _weekday("Father's Day", 6, 7, 3, "positive", before=7), _fixed("Independence Day", 7, 4, "positive", before=3),
    _weekday("Labor Day", 9, 1, 1, "positive", before=3), _fixed("Halloween", 10, 31, "positive", before=7),
    _weekday("Thanksgiving", 11, 4, 4, "positive", before=3), _weekday("Black Friday", 11, 4, 4, "very_positive", offset=1, after=2),
    _weekday("Cyber Monday", 11, 4, 4, "very_positive", offset=4), _fixed("Christmas", 12, 25, "very_positive", before=14),
    _fixed("Boxing Day", 12, 26, "positive", after=2), _fixed("New Year's Eve", 12, 31),
)
# Public holidays of four countries.
NATIONAL = {
    "US": (
        _fixed("New Year's Day", 1, 1, observed="nearest"), _weekday("Martin Luther King Jr. Day", 1, 1, 3, first_year=1986),
        _weekday("Washington's Birthday", 2, 1, 3), _weekday("Memorial Day", 5, 1, -1), _fixed("Juneteenth", 6, 19, observed="nearest", first_year=2021),
        _fixed("Independence Day", 7, 4, observed="nearest"), _weekday("Labor Day", 9, 1, 1), _weekday("Columbus Day", 10, 1, 2),
        _fixed("Veterans Day", 11, 11, observed="nearest"), _weekday("Thanksgiving", 11, 4, 4), _fixed("Christmas Day", 12, 25, observed="nearest"),
    ),
    "GB": (
        _fixed("New Year's Day", 1, 1, observed="monday"), _easter("Good Friday", -2), _easter("Easter Monday", 1),
        _weekday("Early May bank holiday", 5, 1, 1), _weekday("Spring bank holiday", 5, 1, -1), _weekday("Summer bank holiday", 8, 1, -1),
        _fixed("Christmas Day", 12, 25), _fixed("Boxing Day", 12, 26),
    ),
    "DE": (
        _fixed("Neujahr", 1, 1), _easter("Karfreitag", -2), _easter("Ostermontag", 1), _fixed("Tag der Arbeit", 5, 1),
        _easter("Christi Himmelfahrt", 39), _easter("Pfingstmontag", 50), _fixed("Tag der Deutschen Einheit", 10, 3, first_year=1990),
        _fixed("Erster Weihnachtstag", 12, 25), _fixed("Zweiter Weihnachtstag", 12, 26),
    ),
    "FR": (
        _fixed("Jour de l'an", 1, 1), _easter("Lundi de Pâques", 1), _fixed("Fête du Travail", 5, 1), _fixed("Victoire 1945", 5, 8),
        _easter("Ascension", 39), _easter("Lundi de Pentecôte", 50), _fixed("Fête nationale", 7, 14), _fixed("Assomption", 8, 15),
        _fixed("Toussaint", 11, 1), _fixed("Armistice", 11, 11), _fixed("Noël", 12, 25),
    ),
}


def rule_table(spark: SparkSession, rules: Sequence[Rule] = SHOPPING) -> DataFrame:
    """The rules as rows; rows of the same shape from any other table are as good."""
    return spark.createDataFrame([tuple(r) for r in rules], SCHEMA)


def is_rules(holidays: DataFrame) -> bool:
    return {"kind", "nth", "weekday"} <= set(holidays.columns)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday of the western churches: the Sunday after the full moon of the church's table on or after 21 March."""
    golden, century = year % 19, _div(year, 100)
    # Days from 21 March to the full moon: the moon's age moves with the century's missing leap days and its own correction.
    moon = (19 * golden + century - _div(century, 4) - _div(8 * century + 13, 25) + 15) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon)
    return F.date_add(full, 7 - (F.weekday(full) + 1) % 7)


def orthodox_easter(year: Column) -> Column:
    """Easter Sunday of the eastern churches, as a Gregorian date: the same rule in the Julian calendar, whose days are that many behind."""
    moon = (19 * (year % 19) + 15) % 30
    behind = _div(year, 100) - _div(year, 400) - 2
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon + behind)
    return F.date_add(full, 7 - (F.weekday(full) + 1) % 7)


def rule_date(year: Column, rule: Rule | None = None) -> Column:
    """The date of a rule in a year; null where it has none. Without ``rule`` the columns of a rule table are meant."""
    part = lambda name: F.col(name) if rule is None else F.lit(getattr(rule, name))
    kind, month, day, weekday, nth, offset = (part(n) for n in ("kind", "month", "day", "weekday", "nth", "offset"))
    made = lambda m, d: F.to_date(F.try_make_timestamp(year, m, d, F.lit(0), F.lit(0), F.lit(0)))
    first, given = made(month, F.lit(1)), made(month, day)
    number = lambda date: F.weekday(date) + 1
    ahead = F.date_add(first, F.pmod(weekday - number(first), F.lit(7)) + 7 * (nth - 1))
    last = F.last_day(first)
    back = F.date_sub(last, F.pmod(number(last) - weekday, F.lit(7)) - 7 * (nth + 1))
    of_month = F.when(nth > 0, ahead).when(nth < 0, back)
    found = (
        F.when(kind == "fixed", given)
        .when(kind == "weekday", F.when(F.month(of_month) == month, of_month))
        .when(kind == "before", F.date_sub(given, F.pmod(number(given) - weekday, F.lit(7))))
        .when(kind == "after", F.date_add(given, F.pmod(weekday - number(given), F.lit(7))))
        .when(kind == "easter", easter(year))
        .when(kind == "orthodox", orthodox_easter(year))
    )
    moved = F.date_add(found, F.coalesce(offset, F.lit(0)))
    observed, on = F.coalesce(part("observed"), F.lit("")), F.weekday(moved)
    shift = F.when((observed == "nearest") & (on == 5), -1).when((observed == "monday") & (on == 5), 2).when((observed != "") & (on == 6), 1).otherwise(0)
    valid = (year >= F.coalesce(part("first_year"), year)) & (year <= F.coalesce(part("last_year"), year))
    return F.when(valid, F.date_add(moved, shift))


def rule_dates(rules: DataFrame, first: Column, last: Column) -> DataFrame:
    """date, name, impact, before and after of every rule's days between two dates: a row per rule and year.

    Years next to the span count too, since a day can move over New Year.
    """
    years = F.explode(F.sequence(F.year(first) - 1, F.year(last) + 1))
    # Out of a generator, so that the filter on the date is not put in place of it and evaluates the rule once more.
    dated = rules.withColumn("_year", years).select(
        F.explode(F.array(rule_date(F.col("_year")))).alias("date"), "name", "impact", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("before", "after")]
    )
    return dated.where(F.col("date").between(first, last))


def rule_hit(when: Column, rule: Rule) -> Column:
    """Whether a day lies in the window of a rule."""
    days = [rule_date(F.year(when) + step, rule) for step in (-1, 0, 1)]
    near = [when.between(F.date_sub(d, rule.before), F.date_add(d, rule.after)) for d in days]
    return reduce(lambda a, b: a | b, [F.coalesce(n, F.lit(False)) for n in near])
