"""The learned rank index, infilling forms and their exact way back."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillscope.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 12), st.integers(0, 100_000)), min_size=1, max_size=400), st.sampled_from([1, 8, 48]))
def test_index_is_exact_and_bounded(steps, error):
    offsets = np.cumsum(np.array(steps, np.int64))
    index = fim.RankIndex(offsets, error)
    ranks = np.arange(len(offsets))
    assert np.array_equal(index[ranks], offsets)
    assert np.abs(offsets - index.predicted(ranks)).max() <= error + 1


def test_index_is_small_on_even_steps():
    rng = np.random.default_rng(1)
    index = fim.RankIndex(np.cumsum(rng.integers(1, 10, 200_000)))
    assert len(index.firsts) < 1000 and index.residuals.dtype == np.int8


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    found = UNIT.findall(text)
    n = len(found)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


TEXTS = ["one two  three, four", None, "", "a<P>b", "x<S", "<", "é", "日本語 text 🙂 end", "\n\r\x00\x0b", "word" * 40_000, " ".join(f"w{i}é" for i in range(30_000)), "<M", "a", "ab<P", "S>x<S"]


@pytest.fixture(scope="module")
def rows():
    return [(i * 37 + j, t) for i in range(40) for j, t in enumerate(TEXTS) if i < 3 or len(t or "") < 100] + [(None, "no id here"), (None, None), (5, "same id"), (5, "same id"), (-3, "negative id")]


def test_against_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("_id", "_text", "_h1", "n", "form", "output")])
    found = fim.fill_in_middle(docs)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r[0], r[1]) for r in back), key=repr) == sorted(((a, b or "") for a, b in rows), key=repr)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_shares_follow_the_parameters(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'some words to cut' as text")
    forms = {r["form"]: r["count"] for r in fim.fill_in_middle(docs, plain_percent=50, spm_percent=50).groupBy("form").count().collect()}
    assert 900 < forms["plain"] < 1100 and 400 < forms["psm"] < 600 and 400 < forms["spm"] < 600
    assert fim.fill_in_middle(docs, seed=2).exceptAll(fim.fill_in_middle(docs)).count() > 0
