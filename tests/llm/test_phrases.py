"""Phrase mining against counting in plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillscope.llm import phrases

COLUMNS = ["lang", "phrase", "words", "a", "l", "r", "n", "score"]


def brute(rows, least, longest=4, inside=80):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        frequent = {g: c for g, c in f.items() if c >= least}
        for g, a in frequent.items():
            if len(g) < 2:
                continue
            longer = [c for h, c in frequent.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * c >= inside * a for c in longer):
                continue
            score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            out.add((lang, " ".join(g), len(g), a, l, r, totals[lang], score))
    return out


def table(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    return docs.select("*", *[F.lit("x").alias(c) for c in ("doc_id", "row_key", "at", "word", "gram", "phrase", "a", "n", "head")]).repartition(5)


def mined(docs, **options):
    return {tuple(r) for r in phrases.mine(docs, **options).select(COLUMNS).collect()}


ROWS = [
    ("The Old harbour, the old HARBOUR wall; the old harbour wall stands", "en"),
    ("the old harbour wall\nthe old mill. The old\tmill wheel", "en"),
    ("ha ha ha ha ha ha, ha ha", "en"),
    ("ÉTÉ été ÉTÉ été ÉTÉ", "fr"),
    ("the old harbour wall", None),
    ("the old harbour wall", "und"),
    (None, "en"),
    ("", "en"),
    (" \t .,;:!?\r\n", None),
    ("the old mill", ""),
]


@pytest.mark.parametrize("hot_rows", [None, 0, 2])
@pytest.mark.parametrize("least", [1, 2])
def test_against_brute_force(spark, least, hot_rows):
    rows = ROWS * 2
    assert mined(table(spark, rows), min_count=least, hot_rows=hot_rows) == brute(rows, least)


def test_long_texts_and_other_lengths(spark):
    long = " ".join(f"w{i % 7} v{i % 5}" for i in range(20_000))
    rows = [(long, "en"), ("x" * 300_000 + " y", "en"), (("x" * 300_000 + " y ") * 2, "en")]
    for longest in (2, 5):
        assert mined(table(spark, rows), min_count=2, max_words=longest) == brute(rows, 2, longest)


def test_nothing(spark):
    docs = table(spark, ROWS)
    assert mined(docs.limit(0)) == set() and mined(docs, min_count=1000) == set()


def test_tables_are_forgotten(spark):
    phrases.mine(table(spark, ROWS), min_count=2)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("occurrences")]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, [big], [big])], "a long, firsts array<long>, rests array<long>")
    found = row.selectExpr(phrases.CUT + " as cut").first()["cut"]
    assert found["score"] == 2_000_000 * big // (2 * big)


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_sorted_buckets_are_merged_as_they_lie(spark, monkeypatch, hot_rows):
    plans, merged = [], phrases.Relation.adjacent

    def noted(relation):
        out = merged(relation)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(phrases.Relation, "adjacent", noted)
    before = spark.conf.get(phrases.SCAN_ORDER, "false")
    assert mined(table(spark, ROWS * 2), min_count=2, hot_rows=hot_rows) == brute(ROWS * 2, 2)
    assert len(plans) == 3 and not any("Sort [" in plan or "Exchange" in plan for plan in plans)
    assert spark.conf.get(phrases.SCAN_ORDER, "false") == before
