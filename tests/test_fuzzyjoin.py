"""The two-table fuzzy join against scoring every pair that shares a word."""

import random

import pytest
from pyspark.sql import functions as F

from tillscope.operators import fuzzyjoin


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        held = [0]
        for j, y in enumerate(b):
            held.append(row[j] + 1 if x == y else max(row[j + 1], held[-1]))
        row = held
    return row[-1]


def score(a, b):
    mine, theirs = sorted(set(a.split())), sorted(set(b.split()))
    shared = [w for w in mine if w in theirs]
    x, y = " ".join(w for w in mine if w not in theirs), " ".join(w for w in theirs if w not in mine)
    s = len(" ".join(shared))
    if not shared:
        return None
    if not x or not y:
        return 100.0
    full = 100.0 * (1 - (len(x) + len(y) - 2 * lcs(x, y)) / (2 * (s + 1) + len(x) + len(y)))
    return max(full, *(100.0 * (1 - (1 + n) / (2 * s + 1 + n)) for n in (len(x), len(y))))


def brute(names, targets, threshold):
    out = {}
    for name in names:
        if name is None:
            continue
        scored = sorted(((-score(name, t), t) for t in set(targets) if t is not None and score(name, t) is not None))
        good = scored and -scored[0][0] >= threshold
        out[name] = (names.count(name), scored[0][1] if good else None, round(-scored[0][0], 9) if good else None)
    return out


WORDS = ["sales", "salse", "amount", "amuont", "total", "order", "id", "customer", "custmer", "naïve", "naive", "日本", "x", "xx", "price", "prices"]


@pytest.mark.parametrize("threshold", [55, 75, 90, 100])
@pytest.mark.parametrize("cell_rows", [2, 2000])
def test_against_all_pairs(spark, threshold, cell_rows):
    rng = random.Random(threshold)
    make = lambda n: [" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(n)]
    names, targets = [*make(60), None, "", "  ", "sales  sales", "amount " * 3], [*make(40), None, "", "total amount"]
    left = spark.createDataFrame([(n, 1) for n in names], "name string, word int")
    right = spark.createDataFrame([(t, 1) for t in targets], "name string, words int")
    rows = fuzzyjoin.fuzzy_join(left, right, "name", "name", threshold, cell_rows).collect()
    got = {r["name"]: (r["rows"], r["match"], None if r["score"] is None else round(r["score"], 9)) for r in rows}
    assert got == brute(names, targets, threshold) and len(rows) == len(got)


def test_no_letter_bound_is_too_small(spark):
    """Letters that repeat often, and those that fall into one class."""
    names = ["aaaaaaaaaa bb", "aaaaaaaaab bb", "hhhh ii", "ab cd ef gh ij kl mn op qr st uv wx yz"]
    left = spark.createDataFrame([(n,) for n in names], "name string")
    right = spark.createDataFrame([(n.replace("bb", "bb cc"),) for n in names], "name string")
    got = {r["name"]: r["match"] for r in fuzzyjoin.fuzzy_join(left, right, "name", "name").collect()}
    assert all(got[n] is not None for n in names)


def test_empty_sides(spark):
    some = spark.createDataFrame([("a b",)], "name string")
    assert fuzzyjoin.fuzzy_join(some.limit(0), some, "name", "name").collect() == []
    assert [tuple(r) for r in fuzzyjoin.fuzzy_join(some, some.limit(0), "name", "name").collect()] == [("a b", 1, None, None)]


def test_hundred_thousand_names(spark):
    """A word that every name and target has, and no cross product."""
    word = lambda c, n: F.translate(F.substring(F.md5(F.pmod(F.xxhash64(c, F.lit(n)), F.lit(4000)).cast("string")), 1, 7), "0123456789", "ghijklmnop")
    named = lambda rows, seed: spark.range(rows).select(F.concat_ws(" ", word(F.col("id") + seed, 1), word(F.col("id") + seed, 2), word(F.col("id") + seed, 3)).alias("name"))
    names, targets = named(100_000, 0), named(10_000, 50_000)
    out = fuzzyjoin.fuzzy_join(names, targets, "name", "name")
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    found = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == 100).alias("exact")).first()
    assert found["exact"] >= 10_000 and found["n"] >= 99_000
