"""The pruned cosine match against all products."""

import numpy as np
import pytest

from tillscope.operators import matching, nearest


def brute(queries, candidates):
    out = {}
    for q, v in queries:
        best = None
        for c, w in candidates:
            if v is None or w is None or len(v) != len(w) or any(x is None or not np.isfinite(x) for x in [*v, *w]) or not any(v) or not any(w):
                continue
            a, b = np.array(v) / np.linalg.norm(v), np.array(w) / np.linalg.norm(w)
            s = float((a * b).sum())
            if best is None or s > best[0] + 1e-13 or abs(s - best[0]) <= 1e-13 and c < best[1]:
                best = (s, c)
        out[q] = best
    return out


def table(spark, rows, kind):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"id {kind}, v array<double>")


def got(matches, threshold):
    return {r["id"]: (r["score"], r["match"]) for r in matches.rows.collect()}


@pytest.mark.parametrize("pivots,block", [(1, 5), (8, 3), (1024, 4000)])
def test_against_all_pairs(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    vectors = lambda n, d: [list(map(float, rng.normal(size=d))) for _ in range(n)]
    queries = [*enumerate([*vectors(40, 4), *vectors(10, 3), *vectors(3, 9)])]
    candidates = [*enumerate([*vectors(60, 4), *vectors(20, 3), *vectors(2, 1)])]
    candidates += [(1000 + i, v) for i, (_, v) in enumerate(candidates[:30])]  # equals under larger ids
    queries += [(500, None), (501, [0.0, 0.0, 0.0, 0.0]), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan")] * 4), (504, []), (505, [float("inf"), 0, 0, 0]), (506, candidates[3][1]), (507, [1e-200, 0, 0, 0]), (508, [1e200, 1e200, 0, 0])]
    candidates += [(2000, None), (2001, [0.0] * 4), (2002, [float("nan")] * 3), (2003, [])]
    found = nearest.pruned_match(table(spark, queries, "int"), table(spark, candidates, "long"), "id", "v", 0.8, 7, block, pivots)
    rows = got(found, 0.8)
    expected = brute([q for q in queries if q[0] < 507], candidates)
    assert set(rows) == {q for q, _ in queries}
    for q, best in expected.items():
        if best is None:
            assert rows[q] == (None, None)
        else:
            assert abs(rows[q][0] - best[0]) < 1e-9 and rows[q][1] == (best[1] if best[0] >= 0.8 else None)
    assert rows[507][0] is not None and rows[508][0] is not None
    work = found.work.first()
    assert 0 < work["scored"] <= work["pairs"]


def test_clusters_are_skipped(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(50, 32))
    near = lambda n: [(f"k{i}", list(map(float, centres[i % 50] + 0.1 * rng.normal(size=32)))) for i in range(n)]
    queries, candidates = near(500), near(3000)
    found = nearest.pruned_match(table(spark, queries, "string"), table(spark, candidates, "string"), "id", "v", 0.8, candidate_block=500)
    expected = brute(queries[:40], candidates)
    rows = got(found, 0.8)
    assert all(abs(rows[q][0] - best[0]) < 1e-9 and rows[q][1] == best[1] for q, best in expected.items())
    work = found.work.first()
    assert work["pairs"] == 1_500_000 and work["share"] < 0.2


def test_empty_sides(spark):
    some = table(spark, [(1, [1.0, 0.0])], "int")
    assert nearest.pruned_match(some.limit(0), some, "id", "v", 0.8).rows.collect() == []
    found = nearest.pruned_match(some, some.limit(0), "id", "v", 0.8)
    assert [tuple(r) for r in found.rows.collect()] == [(1, None, None)] and found.work.first()["pairs"] == 0


def test_a_vector_is_sent_once_a_group(spark, monkeypatch):
    """Where no cell can be left out, a query still goes to a few groups and not to every cell."""
    asked, store = [], nearest.written

    def recorded(df, name="stage"):
        out = store(df, name)
        if name == "asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(nearest, "written", recorded)
    rng = np.random.default_rng(11)
    queries, candidates = ([*enumerate(map(list, rng.normal(size=(n, 32)).tolist()))] for n in (300, 2000))
    found = nearest.pruned_match(table(spark, queries, "int"), table(spark, candidates, "int"), "id", "v", 0.8, candidate_block=100)
    a, b = (np.array([v for _, v in side]) for side in (queries, candidates))
    cosines = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    rows = got(found, -1.0)
    assert all(abs(rows[q][0] - cosines[q].max()) < 1e-9 for q, _ in queries)
    assert found.work.first()["share"] > 0.5
    assert len(asked) == 2 and max(asked) <= 300 * 20


@pytest.mark.parametrize("group_bytes", [64, 4096])
def test_cells_larger_than_a_group(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(nearest, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 4))
    near = lambda n: [(i, list(map(float, base[i % 6] * (1 + i % 3) + 0.01 * (i % 5)))) for i in range(n)]
    queries, candidates = near(50), near(400)
    rows = got(nearest.pruned_match(table(spark, queries, "int"), table(spark, candidates, "int"), "id", "v", 0.8, 7, 20), 0.8)
    for q, best in brute(queries, candidates[:90]).items():
        assert abs(rows[q][0] - best[0]) < 1e-9 and abs(np.dot(*[np.array(v) / np.linalg.norm(v) for v in (queries[q][1], candidates[rows[q][1]][1])]) - best[0]) < 1e-9


def test_the_accepted_match_is_sent_once_a_group_too(spark, monkeypatch):
    """``cosine_match`` takes the same step where candidates fill more than one block."""
    sent, store = [], nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, name="stage": sent.append((name, store(df, name))) or sent[-1][1])
    rng = np.random.default_rng(13)
    queries, candidates = ([*enumerate(rng.normal(size=(n, 16)).tolist())] for n in (100, 4500))
    rows = {r["id"]: r["score"] for r in matching.cosine_match(table(spark, queries, "int"), table(spark, candidates, "int"), "id", "v").collect()}
    assert all(abs(rows[q] - best[0]) < 1e-9 for q, best in brute(queries[:3], candidates).items())
    asked = [df.count() for name, df in sent if name == "asked"]
    assert len(asked) == 2 and max(asked) <= 100 * 8


def test_most_pairs_are_multiplied_in_single_precision():
    """Double precision is for queries that may gain by a block; scores that single precision can't tell apart are still told apart."""
    multiplied = {np.dtype(np.float32): 0, np.dtype(np.float64): 0}

    class Counted(np.ndarray):
        def __matmul__(self, other):
            multiplied[self.dtype] += len(self) * other.shape[1]
            return np.asarray(self) @ np.asarray(other)

    rng = np.random.default_rng(17)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    units, others = unit(rng.normal(size=(300, 24))), unit(rng.normal(size=(4000, 24)))
    others[3000:3300] = unit(units + 1e-4 * rng.normal(size=units.shape))
    others[3500:3800] = unit(others[3000:3300] + 1e-7 * (units - others[3000:3300]))  # nearer by less than single precision tells
    others[3800:3900] = others[3500:3600]  # equals, of which the lower rank counts
    rank = np.arange(4000)[::-1].copy()
    best, found = np.full(300, -np.inf), np.full(300, -1)
    for start in range(0, 4000, 100):
        nearest._improve(units.view(Counted), others, rank, np.arange(300), start, start + 100, best, found)
    expected = np.array([[(u * o).sum() for o in others[3000:]] for u in units])
    np.testing.assert_array_equal(best, expected.max(axis=1))
    assert all(rank[f] == rank[3000:][e == e.max()].min() for f, e in zip(found, expected, strict=True))
    assert (expected[:, 500:800].max(axis=1) - expected[:, :300].max(axis=1) < 2.0**-24).all()
    assert multiplied[np.dtype(np.float64)] < 0.4 * 300 * 4000 and multiplied[np.dtype(np.float32)] > 0.9 * 300 * 4000
