"""Region queries over crowded places: no table of all windows, the same results as the SQL."""

import duckdb
import numpy as np
import pytest

from tessera.operators import centres, windows
from tessera.plans import registry

FOLDER = "/root/testdata/sf0.01"
NAMES = ["top_regions_sum", "border_top1", "top_regions_count", "top_regions_multi_round", "distinct_keywords_regions", "top_regions_distinct_keywords", "total_score", "top_regions_hybrid", "top_regions_single_round"]


def oracle(name):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS FROM '{FOLDER}/embeddings.parquet'")
        return sorted(db.sql(registry.ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_no_table_of_all_windows(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("formed all windows")

    monkeypatch.setattr(windows, "candidates", never)
    got = registry.QUERIES[name](spark, FOLDER)
    want = oracle(name)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_a_set_of_points_is_formed_once():
    rng = np.random.default_rng(2)
    x, y = rng.random(300) * 2, rng.random(300) * 2
    s, lon, lat = windows.kernel(x, y, np.ones(300), np.floor(x).astype(int), np.floor(y).astype(int), (1, 1), 1.0, 0.0)
    assert 0 < len(s) < 1.05 * len(set(zip(lon, lat)))


def test_columns_that_cannot_reach_the_cut_are_passed_over(monkeypatch):
    """F1-F5, F7-F10: a crowded block's columns were all swept, whatever the cut."""
    rng = np.random.default_rng(3)
    for least in (1, -3):
        x, y, w = rng.random(600) * 2, rng.random(600) * 2, rng.integers(least, 6, 600).astype(float)
        at = (x, y, w, np.floor(x).astype(int), np.floor(y).astype(int), (1, 1), 1.0)
        every = sorted(zip(*windows.kernel(*at, float("-inf"))))
        cut = every[-20][0]
        summed, cumsum = [], np.cumsum
        monkeypatch.setattr(np, "cumsum", lambda *a, **k: summed.append(1) or cumsum(*a, **k))
        found = sorted(zip(*windows.kernel(*at, cut)))
        monkeypatch.undo()
        assert found == [r for r in every if r[0] >= cut] and len(summed) < 300
        assert found == sorted(r for p in range(3) for r in zip(*windows.kernel(*at, cut, p, 3)))


def around(rng, n, least=1):
    x, y, w = rng.random(n) * 3 - 1, rng.random(n) * 3 - 1, rng.integers(least, 6, n).astype(float)
    return {"lon": x, "lat": y, "w": w, "i": np.floor(x).astype(int), "j": np.floor(y).astype(int)}


def plain(rows, eps=1.0):
    """Scores and centres of all windows, one by one."""
    x, y, w = rows["lon"], rows["lat"], rows["w"]
    for tx in np.unique([x, x + eps]):
        for ty in np.unique([y, y + eps]):
            own = (x <= tx) & (x + eps > tx) & (y <= ty) & (y + eps > ty)
            if own.any():
                yield w[own].sum(), (x[own].min() + x[own].max()) / 2, (y[own].min() + y[own].max()) / 2


@pytest.mark.parametrize("least", [1, -4])
@pytest.mark.parametrize("n", [1, 3, 25, 60])
def test_best_of_a_cell_of_centres(n, least):
    for seed in range(3):
        rows = around(np.random.default_rng([n, seed]), n, least)
        want = [s for s, x, y in plain(rows) if 0 <= x < 1 and 0 <= y < 1]
        points = centres.Around(rows, (0, 0), 1.0)
        assert centres.top(points) == (max(want) if want else None)
        assert max((s for p in range(3) if (s := centres.top(points, p, 3)) is not None), default=None) == (max(want) if want else None)


def test_few_columns_decide_a_crowded_cell(monkeypatch):
    """every column of each block was swept, since the cut was the least of four cells' best."""
    points = centres.Around(around(np.random.default_rng(5), 4000), (0, 0), 1.0)
    looked, own = [], centres.Around.own
    monkeypatch.setattr(centres.Around, "own", lambda self, t: looked.append(t) or own(self, t))
    assert centres.top(points) > 0 and len(looked) < len(points.tx) / 10


@pytest.mark.parametrize("n", [4, 30, 150, 600])
def test_best_windows_by_distinct_keywords(n, monkeypatch):
    """the sweep of a crowded block went on for a whole cell after its best window."""
    for seed, values in ((0, 2), (1, 5), (2, 9), (3, 300)):
        rng = np.random.default_rng([n, seed])
        x, y, w = rng.random(n) * 2, rng.random(n) * 2, np.array([f"k{v}" for v in rng.integers(0, values, n)], object)
        at = (x, y, w, np.floor(x).astype(int), np.floor(y).astype(int), (1, 1), 1.0)
        every = sorted({(-s, a, b) for s, a, b in zip(*windows.kernel(*at, 0.0, distinct=True))})
        once = [r for k, r in enumerate(every) if r[1:] not in {e[1:] for e in every[:k]}] if n < 100 else every
        for most in (1, 3):
            to, counted, bincount = windows.Best(0.0, most, np.zeros((0, 2)), 1.0), [], np.bincount
            monkeypatch.setattr(np, "bincount", lambda *a, **k: counted.append(1) or bincount(*a, **k))
            assert not [*windows.sweep(*at, to, distinct=True)]
            monkeypatch.undo()
            assert [(-s, a, b) for s, a, b in zip(*to.taken())] == once[:most]
            assert n < 600 or values > 9 or most > 1 or len(counted) < 200


@pytest.mark.parametrize("least", [1, -4])
@pytest.mark.parametrize("n", [1, 3, 25, 60])
def test_all_windows_of_a_cell_of_centres(n, least, monkeypatch):
    for seed, grid in ((0, 0), (1, 8), (2, 3)):
        rows = around(np.random.default_rng([n, seed]), n, least)
        if grid:  # equal places on either axis and centres that several sets of points share
            rows |= {c: np.floor(rows[c] * grid) / grid for c in ("lon", "lat")}
        want = {}
        for s, x, y in plain(rows):
            if 0 <= x < 1 and 0 <= y < 1:
                want[x, y] = max(s, want.get((x, y), s))
        points = centres.Around(rows, (0, 0), 1.0)
        for parts, held in ((1, 10**6), (3, 10**6), (1, 7)):
            monkeypatch.setattr(centres, "HELD", held)
            found = [r for p in range(parts) for f in centres.every(points, part=p, parts=parts) for r in zip(*f)]
            assert sorted(found) == sorted((s, x, y) for (x, y), s in want.items())
        assert sorted(r for f in centres.every(points, 2.0) for r in zip(*f)) == sorted((s, x, y) for (x, y), s in want.items() if s >= 2)


def test_all_windows_are_compared_where_they_are_formed(spark):
    """every window was moved to be compared with those of equal centre; those below 0 were left out."""
    points = spark.createDataFrame([(k % 7 / 8, k % 5 / 4, float(k % 4 - 2)) for k in range(30)], "lon double, lat double, w double")
    plan = registry.QUERIES["window_candidates"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    found = centres.candidates(points, 0.5)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE p (lon DOUBLE, lat DOUBLE, score DOUBLE)")
        db.executemany("INSERT INTO p VALUES (?, ?, ?)", [tuple(r) for r in points.collect()])
        sql = registry._candidates("p0 AS (FROM p)", 0.5)
        want = sorted(db.sql(f"WITH {sql} SELECT s, cx, cy FROM cand").fetchall())
    assert sorted(tuple(r) for r in found.collect()) == want and want[0][0] < 0
