"""A trend that bends: hinges at change points chosen by a sparsity penalty, with seasons, holidays and an interval."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.calendars import SHOPPING, Rule, is_rules, rule_dates, rule_table
from tillscope.operators.trend import MONTH_DAYS, daily_totals, holidays_between
from tillscope.session import written

SPACING = 15  # days between candidate bends
HISTORY = 0.9  # of a series' span may bend
INTERVAL = 0.8
RIDGE = 1e-3  # on seasons and holidays, of the mean square
PATH = 16  # penalties tried
_SWEEPS = 50
_MOST = 250  # candidate bends of one series; longer spans are spaced wider


class Trend(NamedTuple):
    """``components``: a row per series and day. ``bends``: a row per series and change of slope, per year."""

    components: DataFrame
    bends: DataFrame


def _lasso(gram: np.ndarray, moments: np.ndarray, penalty: np.ndarray, ridge: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Coordinate descent on the normal equations: squares + ridge + penalty on absolute values."""
    c = start.copy()
    scale = np.diag(gram) + ridge
    products = gram @ c
    for _ in range(_SWEEPS):
        most = 0.0
        for j in np.flatnonzero(scale > 0):
            free = moments[j] - products[j] + gram[j, j] * c[j]
            fresh = math.copysign(max(abs(free) - penalty[j], 0.0), free) / scale[j]
            step = fresh - c[j]
            if step:
                products += gram[:, j] * step
                c[j] = fresh
                most = max(most, abs(step))
        if most < 1e-4 * (1e-12 + np.abs(c).max()):
            break
    return c


def _refit(gram: np.ndarray, moments: np.ndarray, ridge: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients without a penalty on the chosen regressors, and the mean square they explain."""
    c = np.zeros(len(moments))
    part = gram[np.ix_(used, used)] + np.diag(ridge[used] + 1e-12)
    c[used] = np.linalg.solve(part, moments[used])
    return c, float(2 * c @ moments - c @ gram @ c)


def _chosen(gram: np.ndarray, moments: np.ndarray, square: float, rows: float, hinges: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hinges that the Bayesian criterion keeps, out of those the penalty's path offers, and all coefficients."""
    base = np.flatnonzero(~np.isin(np.arange(len(moments)), hinges))

    def judged(used: list[int]) -> tuple[float, np.ndarray]:
        c, explained = _refit(gram, moments, ridge, np.concatenate((base, np.array(used, np.int64))))
        left = max(square - explained, 1e-12 * square, 1e-300)
        # A bend costs its size and its place.
        return rows * math.log(left) + 2 * len(used) * math.log(max(rows, 2.0)), c

    best_score, best = judged([])
    used: list[int] = []
    if not len(hinges) or square <= 0:
        return np.array(used, np.int64), best
    c = best.copy()
    # Left when the base is fitted; no bend enters above the largest.
    top = np.abs(moments - gram @ c)[hinges].max()
    offered: list[list[int]] = []
    for strength in top * np.geomspace(1.0, 1e-3, PATH):
        penalty = np.zeros(len(moments))
        penalty[hinges] = strength
        c = _lasso(gram, moments, penalty, ridge, c)
        active = [int(h) for h in hinges if c[h]]
        # The penalty spreads a bend over neighbours: the heaviest of each run stands for it.
        runs: list[list[int]] = []
        for h in active:
            if runs and h - runs[-1][-1] == 1 and c[h] * c[runs[-1][-1]] > 0:
                runs[-1].append(h)
            else:
                runs.append([h])
        offered.append([max(run, key=lambda h: abs(c[h])) for run in runs])
        if len(active) > len(hinges) // 2 or len(active) > rows / 4:
            break
    for kept in offered:
        kept = list(kept)
        score, found = judged(kept)
        while kept:  # leave out what does not pay, move what is a little off
            changes = [[x for x in kept if x != h] for h in kept]
            changes += [sorted({*(x for x in kept if x != h), h + d}) for h in kept for d in (-1, 1) if h + d in set(hinges.tolist()) - set(kept)]
            tried = [(*judged(change), change) for change in changes]
            top_change = min(tried, key=lambda t: t[0])
            if top_change[0] >= score:
                break
            score, found, kept = top_change
        if score < best_score:
            best_score, best, used = score, found, kept
    return np.array(used, np.int64), best


def _fit(days: pd.DataFrame, yearly: int, weekly: int, monthly: int, spacing: int, history: float, z: float, holidays: dict[str, dict[int, int]]) -> tuple[pd.DataFrame, list[tuple[int, float]]]:
    """Components of one series, a row per day, and its bends as (day, slope change per year)."""
    t = days["t"].to_numpy(np.int64)
    n, total, squares = (days[c].to_numpy(np.float64) for c in ("n", "sum_y", "sum_yy"))
    rows, first, last = n.sum(), int(t.min()), int(t.max())
    mean = total.sum() / rows
    step = max(spacing, math.ceil((last - first) * history / _MOST))
    places = np.arange(first + step, first + history * (last - first), step)
    x, parts = [np.ones(len(t)), (t - first) / 365.25], ["trend", "trend"]
    x += [np.maximum(0.0, (t - p) / 365.25) for p in places]
    parts += ["trend"] * len(places)
    for part, period, order in (("yearly", 365.25, yearly), ("weekly", 7.0, weekly), ("monthly", MONTH_DAYS, monthly)):
        for k in range(1, order + 1):
            angle = t * (2 * math.pi * k / period)
            x += [np.sin(angle), np.cos(angle)]
            parts += [part, part]
    for near in holidays.values():
        hit = np.array([near.get(int(d), 0) for d in t], np.float64)
        if hit.any():
            x.append(hit)
            parts.append("holiday")
    design, parts = np.stack(x, axis=1), np.array(parts)
    scale = np.sqrt((design * design * n[:, None]).sum(axis=0) / rows)
    scale[scale == 0] = 1.0
    design = design / scale
    weighted = design * n[:, None]
    gram, moments = weighted.T @ design / rows, design.T @ (total - n * mean) / rows
    square = max(float((squares.sum() - 2 * mean * total.sum() + rows * mean * mean) / rows), 0.0)
    ridge = np.where(parts == "trend", 0.0, RIDGE)
    hinges = np.arange(2, 2 + len(places))
    used, c = _chosen(gram, moments, square, float(len(t)), hinges, ridge)
    out = {p: design[:, parts == p] @ c[parts == p] for p in ("trend", "yearly", "weekly", "monthly", "holiday")}
    out["trend"] += mean
    fitted = sum(out.values())
    free = max(rows - len(parts) + len(places) - len(used), 1.0)
    spread = math.sqrt(max(float((squares - 2 * fitted * total + n * fitted * fitted).sum()) / free, 0.0))
    frame = pd.DataFrame({"t": t, "rows": n, "mean": total / n, **out, "fitted": fitted, "lower": fitted - z * spread, "upper": fitted + z * spread})
    return frame, [(int(places[h - 2]), float(c[h] / scale[h])) for h in used]


def trend_bends(
    df: DataFrame,
    when: str,
    value: str,
    keys: Sequence[str] = (),
    yearly: int = 3,
    weekly: int = 2,
    monthly: int = 0,
    holidays: Sequence[Rule] | DataFrame | None = SHOPPING,
    spacing: int = SPACING,
    history: float = HISTORY,
    interval: float = INTERVAL,
) -> Trend:
    """Additive model of each series: a line that bends, seasons, holidays with their windows, and an interval around the fit.

    Components: keys, day, rows, mean, trend, yearly, weekly, monthly, holiday, fitted,
    lower and upper (the given share of single rows lies between, by the deviation of
    all rows from the fit). Bends: keys, day and slope_change per year.

    Rows are reduced to totals per series and day, a series to one row per day of its
    span; these few rows of a series are fitted by one task. Candidates stand every
    ``spacing`` days in the first ``history`` of the span. A path of penalties on their
    absolute slope changes, by coordinate descent on the normal equations, offers sets
    of bends; the Bayesian criterion chooses among them. Seasons and holidays carry a
    small ridge. Rows without date or value are left out; a series of one day is its mean.
    """
    days = daily_totals(df, when, value, keys)
    spark = df.sparkSession
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    number = lambda c: F.date_diff(c, F.lit("1970-01-01").cast("date"))
    windows: dict[str, dict[int, int]] = {}
    if holidays is not None:
        table = holidays if isinstance(holidays, DataFrame) else None
        bounds = span.select(F.struct(F.date_sub("first", 31).alias("first"), F.date_add("last", 31).alias("last")).alias("s")).first()["s"]
        if bounds["first"] is not None:
            if table is None or is_rules(table):
                dated = rule_dates(table if table is not None else rule_table(spark, holidays), F.lit(bounds["first"]), F.lit(bounds["last"]))
            else:
                dated = holidays_between(span, table).select("*", F.lit(0).alias("before"), F.lit(0).alias("after"))
            # A row per holiday, year and day of its window.
            for r in dated.select("name", number(F.col("date")).alias("t"), "before", "after").collect():
                for d in range(r["t"] - r["before"], r["t"] + r["after"] + 1):
                    windows.setdefault(r["name"], {})[d] = 1
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    shape = ", ".join(f"`{k}` {days.schema[k].dataType.simpleString()}" for k in keys)
    numbers = ("rows", "mean", "trend", "yearly", "weekly", "monthly", "holiday", "fitted", "lower", "upper", "slope_change")
    schema = (shape + ", " if shape else "") + "t int, " + ", ".join(f"{c} double" for c in numbers)

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        frame, bends = _fit(series.sort_values("t"), yearly, weekly, monthly, spacing, history, z, windows)
        frame = pd.concat([frame, pd.DataFrame({"t": [b[0] for b in bends], "slope_change": [b[1] for b in bends]})]).reindex(columns=["t", *numbers])
        for i, k in enumerate(keys):
            frame.insert(i, k, series[k].iloc[0] if len(series) else None)
        return frame

    rows = days.select(*keys, number(F.col("day")).alias("t"), "n", "sum_y", "sum_yy", F.lit(1).alias("_one"))
    grouped = rows.groupBy(*(keys or ["_one"]))
    found = written(grouped.applyInPandas(fit, schema), "trend-bends")
    dated = F.date_add(F.lit("1970-01-01").cast("date"), F.col("t")).alias("day")
    components = found.where("rows is not null").select(*keys, dated, F.col("rows").cast("long"), *numbers[1:-1])
    return Trend(components, found.where("slope_change is not null").select(*keys, dated, "slope_change"))
