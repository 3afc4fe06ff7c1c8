"""Region search against brute force, on lattices with ties and on the edge cases of the data model."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import engine, model
from tessera.functions import render
from tessera.model import RegionQuery
from tessera.operators import bounds, filters, grid, scoring, selection, windows


def table(spark, points):
    return spark.createDataFrame([(i, float(x), float(y), k, float(s)) for i, (x, y, k, s) in enumerate(points)], "id bigint, lon double, lat double, keywords string, score double")


def brute_windows(points, eps, score=lambda own: sum(p[2] for p in own)):
    """score by centre of every window."""
    xs = sorted({p[0] for p in points} | {p[0] + eps for p in points})
    ys = sorted({p[1] for p in points} | {p[1] + eps for p in points})
    found = {}
    for tx, ty in itertools.product(xs, ys):
        own = [p for p in points if p[0] <= tx < p[0] + eps and p[1] <= ty < p[1] + eps]
        if own:
            x, y = [p[0] for p in own], [p[1] for p in own]
            centre = ((min(x) + max(x)) / 2, (min(y) + max(y)) / 2)
            found[centre] = max(found.get(centre, float("-inf")), score(own))
    return found


def brute_top(points, eps, k, dist=True):
    found = brute_windows(points, eps)
    return brute_greedy(found, eps, k) if dist else in_order(found)[:k]


def in_order(found):
    return sorted(((s, *c) for c, s in found.items()), key=lambda r: (-r[0], r[1], r[2]))


def brute_greedy(found, eps, k):
    chosen = []
    for r in in_order(found):
        if len(chosen) < k and all(abs(r[1] - c[1]) > eps or abs(r[2] - c[2]) > eps for c in chosen):
            chosen.append(r)
    return chosen


def lattice(seed, n=60, side=24, top=4):
    rng = random.Random(seed)
    return [(rng.randrange(side) / 8, rng.randrange(side) / 8, "a;b" if rng.random() < 0.5 else "b;c", float(rng.randrange(1, top))) for _ in range(n)]


def plain(points):
    return [(x, y, s) for x, y, _, s in points]


def rows_of(regions):
    rows = sorted(regions.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["score"], r["lon"], r["lat"]) for r in rows]


@pytest.mark.parametrize("seed,algo", list(itertools.product(range(2), ["single_round", "hybrid", "multi_round"])))
def test_strategies_equal_brute_force(spark, seed, algo):
    points = lattice(seed)
    got = engine.top_regions(table(spark, points), RegionQuery(topk=4, eps=0.5, f="score", algo=algo))
    assert rows_of(got) == brute_top(plain(points), 0.5, 4)


def test_overlapping_and_windows_equal_brute_force(spark):
    points = lattice(5)
    got = engine.top_regions(table(spark, points), RegionQuery(topk=12, eps=0.5, f="score", dist=False))
    assert rows_of(got) == brute_top(plain(points), 0.5, 12, dist=False)
    every = windows.candidates(filters.weighted(table(spark, points), "score"), 0.5)
    assert {(r["lon"], r["lat"]): r["score"] for r in every.collect()} == brute_windows(plain(points), 0.5)


@pytest.mark.parametrize("algo,split", [("single_round", 512), ("hybrid", 4)])
def test_distinct_keywords_equal_brute_force(spark, monkeypatch, algo, split):
    monkeypatch.setattr(windows, "SPLIT", split)
    monkeypatch.setattr(windows, "STEP", 40)
    rng = random.Random(9)
    points = [(x, y, ";".join(rng.sample("abcdefg", rng.randrange(1, 4))), s) for x, y, _, s in lattice(9, n=70, side=20)]
    kept = table(spark, [*points, (0.0, 0.0, "", 1), (0.0, 0.0, None, 1)])
    query = RegionQuery(topk=4, eps=0.5, algo=algo, score="distinct_keywords", keywords_column="keywords")
    sets = lambda own: float(len({k for p in own for k in p[2].split(";")}))
    order = brute_windows([p[:3] for p in points], 0.5, sets)
    want = brute_greedy(order, 0.5, 4)
    assert rows_of(engine.top_regions(kept, query)) == want
    assert engine.top_regions(kept.where("false"), query).count() == 0


def test_score_names(spark):
    points = lattice(3)
    count = RegionQuery(topk=3, eps=0.5, f="score", score="count")
    assert rows_of(engine.top_regions(table(spark, points), count)) == brute_top([(x, y, 1.0) for x, y, _, _ in points], 0.5, 3)
    for given in ({"score": "median"}, {"score": "distinct_keywords"}):
        with pytest.raises(model.InvalidQuery):
            RegionQuery(topk=1, eps=1, **given)
    asked = RegionQuery.from_parameters({"topk": "1", "eps": "1", "score": "distinct_keywords", "keywordsColumn": "keywords"})
    assert asked.score == "distinct_keywords"


def test_dense_blocks_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(windows, "SPLIT", 5)
    monkeypatch.setattr(windows, "STEP", 40)
    points = lattice(6, n=80, side=8)
    every = windows.candidates(filters.weighted(table(spark, points), "score"), 0.5)
    assert {(r["lon"], r["lat"]): r["score"] for r in every.collect()} == brute_windows(plain(points), 0.5)


def test_approximate_equals_a_plain_loop():
    rng = random.Random(8)
    candidates = [(float(rng.randrange(20)), rng.randrange(30) / 4, rng.randrange(30) / 4) for _ in range(80)]

    def free(answers, n):
        order = sorted((c for c in candidates if all(not selection.conflict(c, a, 1.0) for a in answers)), key=lambda r: (-r[0], r[1], r[2]))
        return order[:n]

    for sigma in (0.5, 0.9):
        answers = []
        while len(answers) < 6 and (rows := free(answers, 6 - len(answers))):
            own, mark, limit = [], 0, None
            for r in rows:
                if limit is not None and r[0] < sigma * limit:
                    del own[mark:]
                    break
                if all(not selection.conflict(r, o, 1.0) for o in own):
                    own.append(r)
                elif limit is None:
                    limit, mark = r[0], len(own)
            answers += own
        original = selection.free_top
        try:
            selection.free_top = lambda _, a, n, eps: free(a, n)
            got = selection.approximate(None, 6, 1.0, sigma)
        finally:
            selection.free_top = original
        assert got == sorted(answers, key=lambda r: (-r[0], r[1], r[2]))


def test_half_open_windows_and_closed_conflicts(spark):
    apart = table(spark, [(0, 0, "a", 1.0), (1, 0, "a", 1.0)])
    assert [r[0] for r in rows_of(engine.top_regions(apart, RegionQuery(topk=5, eps=1.0, f="score", algo=1)))] == [1.0]
    near = table(spark, [(0, 0, "a", 1.0), (0.875, 0, "a", 1.0)])
    assert [r[0] for r in rows_of(engine.top_regions(near, RegionQuery(topk=5, eps=1.0, f="score", algo=1)))] == [2.0]


@pytest.mark.parametrize("algo", [0, 1, 2, 8, 9])
def test_edges(spark, algo):
    nothing = table(spark, [])
    assert engine.top_regions(nothing, RegionQuery(topk=3, eps=1.0, algo=algo)).count() == 0
    same = table(spark, [(1, 1, "a", 2.5)] * 4)
    assert rows_of(engine.top_regions(same, RegionQuery(topk=3, eps=100.0, f="score", algo=algo)))[0][0] == 10.0
    nulls = spark.createDataFrame([(1, None, 1.0, "a", 1.0), (2, 1.0, None, "a", 1.0), (3, 1.0, 1.0, None, None), (4, 2.0, 2.0, "a", 3.0)], nothing.schema)
    got = rows_of(engine.top_regions(nulls, RegionQuery(topk=3, eps=0.5, f="score", algo=algo)))
    assert [r[0] for r in got] == [3.0]


def test_large_and_negative_scores(spark):
    points = [(0, 0, "a", 3_000_000.5), (0.25, 0, "a", -1.0), (5, 5, "a", 2.0)]
    got = rows_of(engine.top_regions(table(spark, points), RegionQuery(topk=2, eps=1.0, f="score", algo=1)))
    assert got == brute_top(plain(points), 1.0, 2)


def test_empty_cell_windows_are_found(spark):
    """A best window whose corner is in a cell without points."""
    points = [(10, 10, "a", 1.0), (-0.3, 0.55, "a", 1.0), (0.55, -0.3, "a", 1.0)]
    assert rows_of(engine.top_regions(table(spark, points), RegionQuery(topk=1, eps=1.0, algo=1)))[0][0] == 2.0


def test_invariance_and_no_overlap(spark):
    points = lattice(9)
    base = rows_of(engine.top_regions(table(spark, points), RegionQuery(topk=5, eps=0.5, f="score")))
    moved = rows_of(engine.top_regions(table(spark, [(x + 64, y - 32, k, s) for x, y, k, s in points]), RegionQuery(topk=5, eps=0.5, f="score")))
    assert [(s, x + 64, y - 32) for s, x, y in base] == moved
    assert all(not selection.conflict(a, b, 0.5) for a, b in itertools.combinations(base, 2))
    assert [r[0] for r in base] == sorted((r[0] for r in base), reverse=True)


@pytest.mark.parametrize("seed", range(6))
def test_threshold_is_never_too_large(spark, seed):
    points = lattice(seed, n=40, side=40)
    cells = bounds.cell_sums(filters.weighted(table(spark, points), "score"), 0.5)
    for k, dist in ((1, True), (2, True), (3, False)):
        found = brute_top(plain(points), 0.5, k, dist)
        if len(found) == k:
            assert bounds.threshold(cells, k, dist).first()["theta"] <= found[-1][0]


def test_keywords(spark):
    rows = spark.createDataFrame([(1, "10.10;x"), (2, "10.1"), (3, None), (4, " X ;y")], "id int, k string")
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(filters.with_keywords(rows, "k", "10.10")) == [1]
    assert ids(filters.with_keywords(rows, "k", "x")) == [1]
    assert ids(filters.with_keywords(rows, "k", "x", casefold=True)) == [1, 4]
    assert ids(filters.with_keywords(rows, "null", "x")) == [1, 2, 3, 4]


def test_grid_columns(spark):
    points = table(spark, [(0, 0, "a", 1), (10, 0, "a", 1), (10, 10, "a", 1), (9.5, 9.5, "a", 1)])
    spec = grid.GridSpec.of(points, 1.0, 4)
    assert (spec.cells, spec.width, spec.side) == (11, 2, 6)
    rows = {r["id"]: r for r in spec.local(spec.with_cells(points)).collect()}
    assert (rows[0]["cell_i"], rows[0]["cell_j"], rows[0]["node"]) == (0, 10, 3)
    assert (rows[2]["cell_i"], rows[2]["cell_j"], rows[2]["node"]) == (10, 0, 2)
    assert spec.widths(2) == [2, 1]
    one = grid.GridSpec.of(points.limit(1), 100.0)
    assert one.cells == 1 and grid.GridSpec.of(points.where("false"), 1.0) is None
    assert sorted(r["shift"] for r in grid.shifted_copies(points.limit(1), 1.0).collect()) == [0, 1, 2, 3]


def test_neighbours(spark):
    rng = random.Random(2)
    points = [(rng.randrange(20) / 4, rng.randrange(20) / 4, "a", 1.0) for _ in range(50)]
    got = {(r["id"], r["other"]) for r in grid.neighbours(table(spark, points), 0.5).collect()}
    assert got == {(a, b) for a in range(50) for b in range(50) if a != b and all(abs(points[a][c] - points[b][c]) <= 0.5 for c in (0, 1))}


def test_rendering(spark, tmp_path):
    regions = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (2, 3.0, 4.0, 4.0)], model.RESULT)
    assert render.result_json(regions) == '[{"rank": 1, "center": [1.0, 2.0], "score": 5.0}, {"rank": 2, "center": [3.0, 4.0], "score": 4.0}]'
    assert render.result_json(regions.where("false")) == "[\n{\n}\n]"
    assert render.text_lines(regions, 1.0).first()["value"] == "1.0:2.0;POLYGON ((0.5 1.5, 0.5 2.5, 1.5 2.5, 1.5 1.5, 0.5 1.5));5.0"
    assert '"coordinates": [1.0, 2.0]' in render.geojson(regions)
    render.write_delimited(regions, str(tmp_path / "out"), 1.0, "|")
    assert render.total_score(regions).first()["total_score"] == 9.0


def test_resolution_and_scores(spark):
    rows = spark.createDataFrame([(1.0, 0.10001, 0.2), (2.0, 0.10002, 0.2), (1.0, 0.5, 0.5)], "score double, lon double, lat double")
    assert {(r["score"], r["lon"]) for r in windows.at_resolution(rows, 1e-4).collect()} == {(2.0, 0.10002), (1.0, 0.5)}
    points = filters.weighted(table(spark, [(0, 0, "a", 1), (0.1, 0.1, "a", 5), (3, 3, "a", 4)]), "score")
    assert scoring.uniform_grid(points, 1.0, 1, "max").first()["score"] == 5.0
    assert scoring.uniform_grid(points, 1.0, 9, lambda w: F.min(w)).count() == 2


def test_kernel_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(1)
    x, y, w = rng.random(30), rng.random(30), rng.random(30)
    zero = np.zeros(30, int)
    whole = windows.kernel(x, y, w, zero, zero, (0, 0), 1.0, 0.0)
    parts = [windows.kernel(x, y, w, zero, zero, (0, 0), 1.0, 0.0, p, 3) for p in range(3)]
    assert sorted(zip(*whole)) == sorted(t for p in parts for t in zip(*p))


def test_separator_is_no_pattern(spark):
    points = spark.createDataFrame([(0.0, 0.0, "ab|c"), (1.0, 1.0, "a|b")], "lon double, lat double, k string")
    assert [r["k"] for r in filters.with_keywords(points, "k", "ab", separator="|").collect()] == ["ab|c"]


def test_nan_is_no_place(spark):
    points = spark.createDataFrame([(0.0, float("nan")), (float("nan"), 0.0), (1.0, 1.0), (None, 1.0)], "lon double, lat double")
    assert filters.located(points).count() == 1


def test_chain_of_falling_scores(spark):
    """Each region conflicts with the next: elimination decides one a round, and stops once k are certain."""
    chain = spark.createDataFrame([(1000.0 - n, 0.75 * n, 0.0) for n in range(640)], "score double, lon double, lat double")
    assert selection.hybrid(chain, 3, 1.0, engine.written) == selection.single_round(chain, 3, 1.0) == [(1000.0 - 2 * n, 1.5 * n, 0.0) for n in range(3)]


def test_kernel_in_steps_equals_one_step(monkeypatch):
    rng = np.random.default_rng(4)
    x, y, w = rng.integers(0, 64, 120) / 32, rng.integers(0, 64, 120) / 32, rng.integers(1, 9, 120).astype(float)
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    whole = sorted(zip(*windows.kernel(x, y, w, i, j, (1, 1), 1.0, 20.0)))
    monkeypatch.setattr(windows, "STEP", 1000)
    assert sorted(zip(*windows.kernel(x, y, w, i, j, (1, 1), 1.0, 20.0))) == whole and whole
