"""CSV folders whose files differ in header, encoding and line breaks."""

import csv
import io
import random

import pytest

from tillscope.sources import csv as csv_source
from tillscope.sources import files


def written_csv(rows, terminator="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=terminator).writerows(rows)
    return out.getvalue()


TEXTS = {
    "ascii": "plain words", "utf-8": "naïve 日本 €", "latin1": "déjà vu Ñ", "cp1252": "“smart” – €5 ™", "utf-16le": "wide Ł 日 ਊ", "utf-16be": "wide Ł 日 ਊ",
}


def test_five_encodings_are_told_apart_and_read_back(spark, tmp_path):
    expected = []
    for name, text in TEXTS.items():
        for bom in (False, True) if name.startswith("utf") else (False,):
            rows = [(f"{name}{bom}{i}", text + str(i)) for i in range(50)]
            body = written_csv([("k", "v"), *rows], "\r\n" if bom else "\n")
            (tmp_path / f"{name}-{bom}.csv").write_bytes((("﻿" if bom else "") + body).encode("latin-1" if name == "latin1" else name))
            expected += rows
    kinds = {r["file"].rpartition("/")[2].partition(".")[0]: r["encoding"] for r in files.file_catalogue(spark, str(tmp_path)).collect()}
    assert all(kind == name.rpartition("-")[0] for name, kind in kinds.items()) and len(kinds) == 9
    rows = files.scan_files(spark, str(tmp_path), "k string, v string")
    assert sorted(tuple(r) for r in rows.collect()) == sorted(expected)


def test_columns_follow_each_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,x,2.5\n2,y,bad\n")
    (tmp_path / "b.csv").write_text('C,"a",other\n3.5,3,zz\n')
    (tmp_path / "c d.csv").write_text("b\nonly\n")
    (tmp_path / "e.csv").write_text("b,b,a\nfirst,second,9\n")
    (tmp_path / "empty.csv").write_text("")
    rows = files.scan_files(spark, str(tmp_path), "a long, b string, c double", corrupt="bad", file_column="from").collect()
    got = sorted((r["from"].rpartition("/")[2], r["a"], r["b"], r["c"], r["bad"]) for r in rows if r["a"] is not None)
    assert got == [("a.csv", 1, "x", 2.5, None), ("a.csv", 2, "y", None, "2,y,bad"), ("b.csv", 3, None, 3.5, None), ("e.csv", 9, "first", None, None)]
    assert [(r["b"], r["c"]) for r in rows if r["a"] is None] == [("only", None)]


@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_records_over_lines_are_read_by_many_tasks(spark, tmp_path, terminator, encoding):
    rng = random.Random(5)
    pieces = ["a", "é", ",", '"', "\n", "\n\n", "long text " * 20, "", ' "quoted" ', "x\ny"]
    rows = [(str(i), "".join(rng.choices(pieces, k=rng.randint(0, 9))) + ".", "t\n" * rng.randint(0, 3) + "|") for i in range(4000)]
    rows.insert(100, ("100a", "line\n" * 20_000 + "end", "."))  # longer than a block
    (tmp_path / "big.csv").write_bytes(written_csv([("id", "text", "tail"), *rows], terminator).encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = files._lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 20
        found = files.scan_files(spark, str(tmp_path), "id string, tail string, text string", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((i, tail, text) for i, text, tail in rows)


def test_unpaired_quotes_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,5" pipe\n2,plain\n')
    (tmp_path / "b.csv").write_text('a,b\n3,"two\nlines"\n\n4,x\n')
    closed = {r["file"].rpartition("/")[2]: (r["open_lines"], r["closed"]) for r in files.file_catalogue(spark, str(tmp_path)).collect()}
    assert closed == {"a.csv": (1, False), "b.csv": (2, True)}
    rows = files.scan_files(spark, str(tmp_path), "a long, b string").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, '5" pipe'), (2, "plain"), (3, "two\nlines"), (4, "x")]


def test_escaped_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"say \\"hi\\nho"\n2,"5\\" by\n6\\""\n3,z\n')
    rows = files.scan_files(spark, str(tmp_path), "a long, b string").orderBy("a").collect()
    assert [r["b"] for r in rows] == ['say "hi\\nho', '5" by\n6"', "z"]


def test_numbers_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"x\ny"\nz\n')
    found = files.whole_records(spark, [str(tmp_path / "a.csv")]).orderBy("number").select("number", "record").collect()
    assert [tuple(r) for r in found] == [(1, "h"), (2, '"x\ny"'), (3, "z")]


def test_csv_scan_finds_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("b,a,c\nz,3,2020-01-01\n")
    (tmp_path / "c.csv").write_text("a\n4.5\n")
    rows = csv_source.csv_scan(spark, str(tmp_path))
    assert rows.dtypes == [("a", "double"), ("b", "string"), ("c", "string")]
    assert sorted(tuple(r) for r in rows.fillna("-").collect()) == [(1.0, "x", "-"), (2.0, "y", "-"), (3.0, "z", "2020-01-01"), (4.5, "-", "-")]
    typed = csv_source.csv_scan(spark, str(tmp_path), "b string, a long", corrupt="bad")
    assert sorted((r["a"] or 0, r["b"] or "", r["bad"]) for r in typed.collect()) == [(0, "", "4.5"), (1, "x", None), (2, "y", None), (3, "z", None)]
    one = csv_source.csv_scan(spark, str(tmp_path / "b.csv"), "a long, b string")
    assert [tuple(r) for r in one.collect()] == [(3, "z")]
    with_files = csv_source.csv_scan_any(spark, str(tmp_path), "a string, b string")
    assert sorted((r["a"], r["b"] or "") for r in with_files.collect()) == [("1", "x"), ("2", "y"), ("3", "z"), ("4.5", "")]
