"""Registered queries over the standard tables, with their SQL oracles.

``p`` stands for the points in every oracle; E is the side of the squares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import engine
from tessera.functions import render
from tessera.model import RegionQuery
from tessera.operators import bounds, centres, filters, grid, scoring, windows
from tessera.sources import poi
from tessera.streaming import grid as stream_grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EMB, EVT = f"p AS ({poi.EMBEDDING_SQL})", f"p AS ({poi.EVENT_SQL})"
GRID_EPS, WINDOW_EPS, EMB_EPS = 1 / 16, 1 / 64, 1 / 32
PARTITIONS, BASE = 100, 4


def D(x: float) -> str:
    """A double literal for DuckDB."""
    return f"CAST({x!r} AS DOUBLE)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- filters and projections ----

KEYWORDS_ONE, KEYWORDS_TWO = "L1;L3", "P0;P2"


@query(f"WITH {EVT} SELECT id, lon, lat FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL")
def poi_not_null(spark, sf_dir):
    return filters.located(poi.event_points(spark, sf_dir)).select("id", "lon", "lat")


@query(f"WITH {EVT} SELECT lon, lat, CAST(1 AS DOUBLE) AS w FROM p")
def poi_projection_count(spark, sf_dir):
    return filters.weighted(poi.event_points(spark, sf_dir))


@query(f"WITH {EVT} SELECT lon, lat, CAST(score AS DOUBLE) AS w FROM p WHERE score IS NOT NULL")
def poi_projection_score(spark, sf_dir):
    return filters.weighted(poi.event_points(spark, sf_dir), "score")


@query(f"WITH {EMB} SELECT id, keywords FROM p WHERE list_has_any(string_split(keywords, ';'), ['L1', 'L3'])")
def keyword_filter_one(spark, sf_dir):
    return filters.with_keywords(poi.embedding_points(spark, sf_dir), "keywords", KEYWORDS_ONE).select("id", "keywords")


@query(f"WITH {EMB} SELECT id, keywords FROM p WHERE list_has_any(string_split(keywords, ';'), ['L1', 'L3']) AND list_has_any(string_split(keywords, ';'), ['P0', 'P2'])")
def keyword_filter_two(spark, sf_dir):
    rows = filters.with_keywords(poi.embedding_points(spark, sf_dir), "keywords", KEYWORDS_ONE)
    return filters.with_keywords(rows, "keywords", KEYWORDS_TWO).select("id", "keywords")


@query(f"WITH {EMB} SELECT id, keywords FROM p WHERE list_has_any(list_transform(string_split(lower(keywords), ';'), lambda k: trim(k)), ['l1', 'p2'])")
def keyword_filter_casefold(spark, sf_dir):
    return filters.with_keywords(poi.embedding_points(spark, sf_dir), "keywords", " l1 ; p2", casefold=True).select("id", "keywords")


@query(f"WITH {EVT} SELECT id, lon, lat FROM p WHERE lon BETWEEN 1 AND 3 AND lat BETWEEN 2 AND 5")
def bbox_filter(spark, sf_dir):
    return filters.in_box(poi.event_points(spark, sf_dir), (1, 2, 3, 5)).select("id", "lon", "lat")


# ---- grid ----

_SPEC = f"""x AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p),
g AS (SELECT *, CAST(greatest(1, ceil((floor(greatest(x1 - x0, y1 - y0) / {D(GRID_EPS)}) + 1) / 10.0)) AS INTEGER) AS side FROM x),
c AS (SELECT id, lon, lat, side, x0, y1, CAST(floor((lon - x0) / {D(GRID_EPS)}) AS INTEGER) AS cell_i, CAST(floor((y1 - lat) / {D(GRID_EPS)}) AS INTEGER) AS cell_j FROM p, g),
n AS (SELECT *, CAST(cell_i // side AS INTEGER) AS node_i, CAST(cell_j // side AS INTEGER) AS node_j FROM c),
l AS (SELECT *, CAST(node_j * 10 + node_i + 1 AS INTEGER) AS node, CAST(cell_i - node_i * side AS INTEGER) AS local_i, CAST(cell_j - node_j * side AS INTEGER) AS local_j FROM n)"""


def _grid(spark, sf_dir) -> tuple[DataFrame, grid.GridSpec]:
    points = poi.event_points(spark, sf_dir).select("id", "lon", "lat")
    return points, grid.GridSpec.of(points, GRID_EPS, PARTITIONS)


@query(f"WITH {EVT} SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM p")
def extent(spark, sf_dir):
    return grid.extent(poi.event_points(spark, sf_dir))


@query(f"WITH {EVT}, {_SPEC} SELECT id, cell_i, cell_j FROM l")
def cell_index(spark, sf_dir):
    points, spec = _grid(spark, sf_dir)
    return spec.with_cells(points).select("id", "cell_i", "cell_j")


@query(f"WITH {EVT}, {_SPEC} SELECT id, node_i, node_j, node FROM l")
def node_index(spark, sf_dir):
    points, spec = _grid(spark, sf_dir)
    return spec.with_cells(points).select("id", "node_i", "node_j", "node")


@query(f"""WITH {EVT}, {_SPEC},
h AS (SELECT id, node_i AS to_i, node_j AS to_j FROM l
  UNION ALL SELECT id, node_i - 1, node_j FROM l WHERE local_i = 0 AND node_i > 0
  UNION ALL SELECT id, node_i, node_j - 1 FROM l WHERE local_j = 0 AND node_j > 0
  UNION ALL SELECT id, node_i - 1, node_j - 1 FROM l WHERE local_i = 0 AND node_i > 0 AND local_j = 0 AND node_j > 0)
SELECT id, CAST(to_i AS INTEGER) AS to_i, CAST(to_j AS INTEGER) AS to_j FROM h""")
def halo_partitions(spark, sf_dir):
    points, spec = _grid(spark, sf_dir)
    return spec.halo(points).select("id", "to_i", "to_j")


@query(f"WITH {EVT}, {_SPEC} SELECT id, local_i, local_j FROM l")
def local_cell_index(spark, sf_dir):
    points, spec = _grid(spark, sf_dir)
    return spec.local(spec.with_cells(points)).select("id", "local_i", "local_j")


@query(f"WITH {EVT}, {_SPEC} SELECT DISTINCT cell_i, cell_j FROM l WHERE local_i IN (0, side - 1) OR local_j IN (0, side - 1)")
def border_cells(spark, sf_dir):
    points, spec = _grid(spark, sf_dir)
    return spec.local(spec.with_cells(points)).where(spec.is_border()).select("cell_i", "cell_j").distinct()


@query(f"WITH {EVT}, {_SPEC} SELECT node_i, node_j, CAST(node_i // {BASE} AS INTEGER) AS parent_i, CAST(node_j // {BASE} AS INTEGER) AS parent_j, count(*) AS n FROM l GROUP BY ALL")
def coarsen_nodes(spark, sf_dir):
    points, spec = _grid(spark, sf_dir)
    return spec.coarsen(spec.with_cells(points), BASE).groupBy("node_i", "node_j", "parent_i", "parent_j").agg(F.count("*").alias("n"))


@query(f"WITH {EVT}, {_SPEC} SELECT DISTINCT node, x0 + node_i * (side * {D(GRID_EPS)}) AS corner_lon, y1 - node_j * (side * {D(GRID_EPS)}) AS corner_lat FROM l")
def node_corners(spark, sf_dir):
    points, spec = _grid(spark, sf_dir)
    lon, lat = spec.corner()
    return spec.with_cells(points).select("node", lon.alias("corner_lon"), lat.alias("corner_lat")).distinct()


def _cells(eps: float) -> str:
    return f"k AS (SELECT *, CAST(floor(lon / {D(eps)}) AS BIGINT) AS i, CAST(floor(lat / {D(eps)}) AS BIGINT) AS j FROM p)"


@query(f"WITH {EVT}, {_cells(GRID_EPS)}, a AS (SELECT i, j, count(*) AS n FROM k GROUP BY ALL) SELECT (SELECT min(lon) FROM p) AS min_lon, (SELECT max(lon) FROM p) AS max_lon, (SELECT min(lat) FROM p) AS min_lat, (SELECT max(lat) FROM p) AS max_lat, count(*) AS n_cells, max(n) AS max_cell FROM a")
def cell_stats(spark, sf_dir):
    return grid.statistics(poi.event_points(spark, sf_dir), GRID_EPS)


@query(f"WITH {EVT}, {_cells(GRID_EPS)} SELECT i, j, count(*) AS n, i * {D(GRID_EPS)} AS west, j * {D(GRID_EPS)} AS south, (i + 1) * {D(GRID_EPS)} AS east, (j + 1) * {D(GRID_EPS)} AS north FROM k GROUP BY i, j")
def cell_polygons(spark, sf_dir):
    return grid.cell_polygons(poi.event_points(spark, sf_dir), GRID_EPS).drop("wkt")


@query(f"WITH {EVT} SELECT a.id, b.id AS other FROM p a JOIN p b ON a.id <> b.id AND b.lon BETWEEN a.lon - {D(1 / 256)} AND a.lon + {D(1 / 256)} AND b.lat BETWEEN a.lat - {D(1 / 256)} AND a.lat + {D(1 / 256)}")
def neighbors(spark, sf_dir):
    return grid.neighbours(poi.event_points(spark, sf_dir), 1 / 256)


@query(f"""WITH {EVT}, m AS (SELECT 0 AS shift, 0.0 AS dx, 0.0 AS dy UNION ALL SELECT 1, {D(GRID_EPS / 2)}, 0.0 UNION ALL SELECT 2, 0.0, {D(GRID_EPS / 2)} UNION ALL SELECT 3, {D(GRID_EPS / 2)}, {D(GRID_EPS / 2)}),
k AS (SELECT shift, CAST(floor((lon + dx) / {D(GRID_EPS)}) AS BIGINT) AS i, CAST(floor((lat + dy) / {D(GRID_EPS)}) AS BIGINT) AS j FROM p, m)
SELECT CAST(shift AS INTEGER) AS shift, i, j, count(*) AS n FROM k GROUP BY ALL""")
def shifted_grid(spark, sf_dir):
    copies = grid.shifted_copies(poi.event_points(spark, sf_dir).select("lon", "lat"), GRID_EPS)
    return grid.hash_cells(copies, GRID_EPS).groupBy("shift", "i", "j").agg(F.count("*").alias("n"))


# ---- aggregates ----


def _uniform(view: str, score: str, where: str = "true") -> str:
    e = D(GRID_EPS)
    return f"""WITH {view}, q AS (SELECT * FROM p WHERE {where}), x AS (SELECT min(lon) AS x0, min(lat) AS y0 FROM q),
c AS (SELECT floor((lon - x0) / {e}) * {e} + {e} / 2 + x0 AS lon, floor((lat - y0) / {e}) * {e} + {e} / 2 + y0 AS lat, CAST({score} AS DOUBLE) AS score FROM q, x GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, lon, lat) AS INTEGER) AS rank FROM c)
SELECT rank, lon, lat, score FROM r WHERE rank <= 10"""


@query(_uniform(EVT, "count(*)").replace("GROUP BY ALL", "GROUP BY 1, 2"))
def uniform_grid_count(spark, sf_dir):
    return engine.top_regions(poi.event_points(spark, sf_dir), RegionQuery(topk=10, eps=GRID_EPS, algo=9))


@query(_uniform(EVT, "sum(score)").replace("GROUP BY ALL", "GROUP BY 1, 2"))
def uniform_grid_sum(spark, sf_dir):
    return engine.top_regions(poi.event_points(spark, sf_dir), RegionQuery(topk=10, eps=GRID_EPS, f="score", algo="uniform"))


@query(_uniform(EVT, "sum(score)", "list_has_any(string_split(keywords, ';'), ['P1'])").replace("GROUP BY ALL", "GROUP BY 1, 2"))
def uniform_grid_filtered(spark, sf_dir):
    return engine.top_regions(poi.event_points(spark, sf_dir), RegionQuery(topk=10, eps=GRID_EPS, f="score", algo=9, keywords_column="keywords", keywords="P1"))


@query(f"WITH {EVT} SELECT CAST(floor(lon * 100000.0) AS BIGINT) AS x, CAST(floor(lat * 100000.0) AS BIGINT) AS y, count(*) AS n, sum(score) AS w FROM p GROUP BY 1, 2")
def merge_colocated(spark, sf_dir):
    return scoring.merge_colocated(filters.weighted(poi.event_points(spark, sf_dir), "score"))


@query(f"WITH {EVT}, d AS (SELECT DISTINCT lon, lat FROM p) SELECT count(*) AS n_locations FROM d")
def distinct_locations(spark, sf_dir):
    return scoring.distinct_locations(poi.event_points(spark, sf_dir))


_SUMS = f"{_cells(WINDOW_EPS)}, s AS (SELECT i, j, sum(score) AS s, count(*) AS n FROM k GROUP BY ALL)"


@query(f"WITH {EVT}, {_SUMS}, u AS (SELECT i + di AS i, j + dj AS j, s, n FROM s, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj)) SELECT i, j, sum(s) AS ub, CAST(sum(n) AS BIGINT) AS m FROM u GROUP BY i, j")
def cell_upper_bound(spark, sf_dir):
    return bounds.upper_bounds(bounds.cell_sums(filters.weighted(poi.event_points(spark, sf_dir), "score"), WINDOW_EPS))


@query(f"""WITH {EVT}, {_SUMS}, r AS (SELECT s, row_number() OVER (PARTITION BY abs(i % 2), abs(j % 2) ORDER BY s DESC) AS n FROM s)
SELECT coalesce(max(s) FILTER (n = 37), 0) AS theta FROM r""")
def theta(spark, sf_dir):
    cells = bounds.cell_sums(filters.weighted(poi.event_points(spark, sf_dir), "score"), WINDOW_EPS)
    return bounds.threshold(cells, 10, True)


@query(f"WITH {EVT}, {_SUMS} SELECT i, j, s, n FROM s")
def streaming_cell_sums(spark, sf_dir):
    """The streaming aggregation, on a table at rest."""
    return stream_grid.cell_sums(poi.event_points(spark, sf_dir), WINDOW_EPS, "score")


# ---- windows and regions ----


def _candidates(view: str, eps: float, score: str = "score", where: str = "true", total: str = "sum(w)") -> str:
    e = D(eps)
    return f"""{view}, q AS (SELECT lon, lat, {score} AS w FROM p WHERE {where}),
tx AS (SELECT DISTINCT lon AS t FROM q UNION SELECT DISTINCT lon + {e} FROM q),
ty AS (SELECT DISTINCT lat AS t FROM q UNION SELECT DISTINCT lat + {e} FROM q),
cand0 AS (SELECT tx.t AS x, ty.t AS y, {total} AS s, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1
  FROM q JOIN tx ON tx.t >= lon AND tx.t < lon + {e} JOIN ty ON ty.t >= lat AND ty.t < lat + {e} GROUP BY 1, 2),
cand AS (SELECT max(s) AS s, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM cand0 GROUP BY 2, 3)"""


def _greedy(view: str, eps: float, k: int, score: str = "score", where: str = "true", tail: str = "SELECT CAST(step AS INTEGER) AS rank, cx AS lon, cy AS lat, s AS score FROM g", total: str = "sum(w)") -> str:
    e = D(eps)
    return f"""WITH RECURSIVE {_candidates(view, eps, score, where, total)},
g AS (SELECT * FROM (SELECT 1 AS step, s, cx, cy, [{{'cx': cx, 'cy': cy}}] AS picked FROM cand ORDER BY s DESC, cx, cy LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT g.step + 1, b.s, b.cx, b.cy, list_append(g.picked, {{'cx': b.cx, 'cy': b.cy}})
    FROM g, cand b WHERE g.step < {k} AND len(list_filter(g.picked, lambda r: abs(r.cx - b.cx) <= {e} AND abs(r.cy - b.cy) <= {e})) = 0
    ORDER BY b.s DESC, b.cx, b.cy LIMIT 1))
{tail}"""


def _regions(spark, sf_dir, view=poi.embedding_points, eps: float = EMB_EPS, **given) -> DataFrame:
    return engine.top_regions(view(spark, sf_dir), RegionQuery(**({"topk": 10, "eps": eps, "f": "score", "algo": 1} | given)))


@query(f"WITH {_candidates(EMB, EMB_EPS)} SELECT s AS score, cx AS lon, cy AS lat FROM cand")
def window_candidates(spark, sf_dir):
    return centres.candidates(filters.weighted(poi.embedding_points(spark, sf_dir), "score"), EMB_EPS)


@query(f"WITH {_candidates(EMB, EMB_EPS)} SELECT CAST(floor(cx / {D(EMB_EPS)}) AS BIGINT) AS i, CAST(floor(cy / {D(EMB_EPS)}) AS BIGINT) AS j, max(s) AS top FROM cand GROUP BY 1, 2")
def border_top1(spark, sf_dir):
    """The exact best window of each cell of centres."""
    return centres.cell_tops(filters.weighted(poi.embedding_points(spark, sf_dir), "score"), EMB_EPS)


@query(_greedy(EMB, EMB_EPS, 10))
def top_regions_sum(spark, sf_dir):
    return _regions(spark, sf_dir)


@query(_greedy(EVT, WINDOW_EPS, 10))
def top_regions_events(spark, sf_dir):
    return _regions(spark, sf_dir, poi.event_points, WINDOW_EPS)


@query(_greedy(EMB, EMB_EPS, 10, "CAST(1 AS DOUBLE)"))
def top_regions_count(spark, sf_dir):
    return _regions(spark, sf_dir, f=None)


@query(_greedy(EMB, EMB_EPS, 10, where="list_has_any(string_split(keywords, ';'), ['L1', 'L3'])"))
def top_regions_filtered(spark, sf_dir):
    return _regions(spark, sf_dir, keywords_column="keywords", keywords=KEYWORDS_ONE)


@query(_greedy(EMB, EMB_EPS, 10, "unnest(string_split(keywords, ';'))", total="CAST(count(DISTINCT w) AS DOUBLE)"))
def top_regions_distinct_keywords(spark, sf_dir):
    """Regions with the most distinct keywords."""
    return _regions(spark, sf_dir, score="distinct_keywords", keywords_column="keywords")


@query(_greedy(EMB, EMB_EPS, 1))
def best_region(spark, sf_dir):
    return engine.best_region(poi.embedding_points(spark, sf_dir), EMB_EPS, "score")


@query(f"WITH {_candidates(EMB, EMB_EPS)}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY s DESC, cx, cy) AS INTEGER) AS rank FROM cand) SELECT rank, cx AS lon, cy AS lat, s AS score FROM r WHERE rank <= 10")
def top_regions_overlapping(spark, sf_dir):
    return _regions(spark, sf_dir, dist=False)


@query(_greedy(EMB, EMB_EPS, 10))
def top_regions_single_round(spark, sf_dir):
    return _regions(spark, sf_dir, algo="single_round")


@query(_greedy(EMB, EMB_EPS, 10))
def top_regions_hybrid(spark, sf_dir):
    return _regions(spark, sf_dir, algo="hybrid")


@query(_greedy(EMB, EMB_EPS, 10))
def top_regions_multi_round(spark, sf_dir):
    return _regions(spark, sf_dir, algo="multi_round")


@query()
def top_regions_approx(spark, sf_dir):
    """Tolerance 0.9; its steps back have no SQL form, so it is tested against a plain loop."""
    return _regions(spark, sf_dir, algo="approximate", sigma=0.9)


@query(_greedy(EMB, EMB_EPS, 10, tail=f"SELECT g.cx AS lon, g.cy AS lat, count(DISTINCT w.word) AS n_keywords FROM g JOIN (SELECT lon, lat, unnest(string_split(keywords, ';')) AS word FROM p) w ON abs(w.lon - g.cx) <= {D(EMB_EPS / 2)} AND abs(w.lat - g.cy) <= {D(EMB_EPS / 2)} GROUP BY 1, 2"))
def distinct_keywords_regions(spark, sf_dir):
    return windows.distinct_keywords(poi.embedding_points(spark, sf_dir), _regions(spark, sf_dir), EMB_EPS)


# ---- results ----

_TEN = _uniform(EVT, "count(*)").replace("GROUP BY ALL", "GROUP BY 1, 2")


@query(f"SELECT sum(score) AS total_score FROM ({_greedy(EMB, EMB_EPS, 10)})")
def total_score(spark, sf_dir):
    return render.total_score(_regions(spark, sf_dir))


@query(f"""SELECT rank, '{{"type":"Feature","properties":{{"id":"' || rank || '","score":' || CAST(score AS VARCHAR) || '}},"geometry":{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}}}}' AS feature FROM ({_TEN})""")
def regions_geojson(spark, sf_dir):
    return render.geojson_features(uniform_grid_count(spark, sf_dir))


_WEST, _SOUTH, _EAST, _NORTH = (f"CAST({c} {s} {D(GRID_EPS / 2)} AS VARCHAR)" for c, s in (("lon", "-"), ("lat", "-"), ("lon", "+"), ("lat", "+")))
_RING = f"{_WEST} || ' ' || {_SOUTH} || ', ' || {_WEST} || ' ' || {_NORTH} || ', ' || {_EAST} || ' ' || {_NORTH} || ', ' || {_EAST} || ' ' || {_SOUTH} || ', ' || {_WEST} || ' ' || {_SOUTH}"


@query(f"SELECT rank, CAST(lon AS VARCHAR) || ':' || CAST(lat AS VARCHAR) AS id, 'POLYGON ((' || {_RING} || '))' AS wkt, score FROM ({_TEN})")
def regions_wkt(spark, sf_dir):
    return render.with_wkt(uniform_grid_count(spark, sf_dir), GRID_EPS)


@query(f"SELECT CAST(lon AS VARCHAR) || ':' || CAST(lat AS VARCHAR) || ';POLYGON ((' || {_RING} || '));' || CAST(score AS VARCHAR) AS value FROM ({_TEN})")
def regions_text(spark, sf_dir):
    return render.text_lines(uniform_grid_count(spark, sf_dir), GRID_EPS)


@query(f"SELECT rank || ':' || CAST(lon AS VARCHAR) || ':' || CAST(lat AS VARCHAR) || '     ' || CAST(score AS VARCHAR) AS value FROM ({_TEN})")
def regions_ranked_lines(spark, sf_dir):
    return render.rank_lines(uniform_grid_count(spark, sf_dir))
