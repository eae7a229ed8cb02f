"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import hashlib
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tillscope.llm import archives, decontamination, htmltext, language, ngramjoin, packing, quality, secrets, sharding, vectors

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
NOTE = "one quiet morning the grey harbour slowly filled with small boats and low voices over the water"
ROWS = [
    (1, NOTE),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, NOTE),  # a copy of 1
    (5, NOTE),  # and the same row again
    (None, NOTE),
    (None, None),
    (7, "  \n\t "),
    (8, "!!! ???"),
    (9, "short text"),
    (9, "another text under the same number"),
]
EXTRA = ["_id", "_text", "score", "spans", "root", "node", "digest", "key", "other", "_digest", "lang_pred", "size", "stays", "d", "i", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(a, b, "en" if a != 9 else None, "s", len(b or "")) for a, b in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(name).alias(name) for name in EXTRA])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with labels and a benchmark that have nulls, ties and repeated rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    labels = [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (4, 1, 0), (9, 0, 0), (9, 0, 0), (77, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "the grey harbour slowly filled with small boats and low voices"), (1, "the grey harbour slowly filled with small boats and low voices"), (2, None), (3, ""), (None, "word5x5 word6x6 word7x7 word8x8 word9x9 word10x10 word11x11 word12x12"), (4, "short text")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def keyed(df, column):
    return sorted(((r["doc_id"], r[column]) for r in df.collect()), key=repr)


def test_quality(spark, docs, nothing, sf):
    weights = quality.train(quality.labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = quality.score(docs, weights).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 7)}) == 1
    assert quality.score(nothing, weights).collect() == []
    assert quality.train(quality.labelled_sample(nothing, spark.read.parquet(f"{sf}/labels.parquet"))).any() == 0
    kept = quality.accepted(docs, weights, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.accepted(docs, weights, threshold=1.1).count() == 0


def test_language(docs, nothing):
    profiles = language.learn(docs)
    assert list(profiles) == ["en"]
    found = language.predict(docs, profiles).collect()
    assert sorted(r["lang_pred"] for r in found) == ["en"] * 7 + ["und"] * 5
    assert {r["score"] for r in found if r["lang_pred"] == "und"} == {0.0}
    assert language.learn(nothing) == {} and language.predict(nothing, profiles).collect() == []
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def test_secrets(docs, nothing, spark):
    found = secrets.scan(docs).collect()
    assert len(found) == len(ROWS) and {r["base_sha256"] for r in found} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(nothing).collect() == []
    assert secrets.redact(docs).exceptAll(docs).count() == 0 and secrets.redact(docs).columns == docs.columns
    one = spark.createDataFrame([(1, "é password: abcdef123 end"), (2, None)], "doc_id long, text string")
    assert keyed(secrets.redact(one), "text") == [(1, "é [SECRET] end"), (2, None)]


def test_sharding(docs, nothing):
    rows = sharding.lpt_shards(docs, 3).collect()
    assert len(rows) == len(ROWS) and {r["law"] for r in rows} == {"bytes"}
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(NOTE.encode())}) == 1
    assert len({r["shard"] for r in rows if r["size"] == 8}) == 1  # null and empty are one group
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.lpt_shards(nothing, 3).collect() == []


def test_packing(docs, nothing):
    rows = packing.pack(docs, corpus_pipeline.TOKENIZER).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) == 3  # two null texts and an empty one: the closing id
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in filled.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        total = sum(n for _, n in pieces)
        assert total <= packing.SEQUENCE and total & (total - 1) == 0
    assert packing.pack(nothing, corpus_pipeline.TOKENIZER).collect() == []


def test_jaccard_join(docs, nothing):
    rows = ngramjoin.jaccard_join(docs).collect()
    assert len(rows) == len(ROWS)
    notes = [r for r in rows if r["class_id"] == 1]
    assert sorted((r["doc_id"] or 0, r["n_links"], r["kept"]) for r in notes) == [(0, 3, False), (1, 3, True), (5, 3, False), (5, 3, False)]
    assert all(r["kept"] and r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in rows if r["doc_id"] in (2, 3, 4, 7, 8, 9))
    assert ngramjoin.jaccard_join(nothing).collect() == []
    left = ngramjoin.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 9]
    assert ngramjoin.one_of_each(nothing).count() == 0


def test_one_of_each_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, NOTE), (1, NOTE), (2, NOTE + " again"), (None, LONG), (None, LONG)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in ngramjoin.one_of_each(rows).collect()) == [0, 1]


def test_decontamination(spark, docs, nothing, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminations(docs, benchmark).collect()}
    assert found == {(1, 1, 0), (5, 1, 0), (None, 1, 0), (4, None, 0)}
    assert decontamination.contaminations(nothing, benchmark).collect() == []
    assert decontamination.contaminations(docs, benchmark.limit(0)).collect() == []
    left = decontamination.clean(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 2, 3, 7, 8, 9, 9]
    assert decontamination.clean(docs, benchmark.limit(0)).count() == len(ROWS)


def test_pages(spark, tmp_path):
    body = "x" * 1200
    page = f"<html><body><nav>menu</nav><article><p>{NOTE}</p></article></body></html>"
    rows = [(1, "http://a/1", body), (2, None, body), (3, "nonsense", None), (4, "http://a/2", ""), (None, "http://a/3", body), (4, "http://a/2", page), (5, "http://A/4", page * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("_id", "_host", "path", "_payload", "text", "n_chars")])
    texts = sorted((r["page_id"] or 0, r["text"][:20], r["n_chars"]) for r in htmltext.extract(pages).collect())
    assert texts[2:6] == [(2, body[:20], 1200), (3, "", 0), (4, "", 0), (4, NOTE[:20], len(NOTE))]
    assert htmltext.extract(pages.limit(0)).collect() == []

    found = archives.read_packages(archives.write_packages(pages, str(tmp_path / "p"))).collect()
    kinds = sorted((r["page"] or "", r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in found)
    big = len(page * 400)
    assert kinds == [("", "revisit", "2", 1200), ("1", "revisit", "2", 1200), ("2", "response", "", 1200), ("3", "response", "", 0), ("4", "response", "", 0), ("4", "response", "", len(page)), ("5", "response", "", big)]
    assert {r["url"] for r in found} == {r[1] for r in rows}
    assert archives.read_packages(archives.write_packages(pages.limit(0), str(tmp_path / "q"))).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.05]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [2.0, 0.0]), (10, [0.0, 1e-30]), (11, [0.0, 1e30]), (12, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("_id", "_key", "label", "part", "root")])
    found = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect()), key=repr)
    assert sorted(found) == sorted([(0, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True)])
    assert vectors.near_duplicates(table.limit(0)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, nothing, sf, name, stage):
    out = stage(spark, docs, sf)
    assert stage(spark, nothing, sf).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.dtypes == docs.dtypes
    assert out.count() <= len(ROWS) or name == corpus_pipeline.STAGES[-1][0]
