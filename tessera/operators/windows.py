"""All windows of side eps, by a kernel over 2-by-2 blocks of cells.

A window (tx, ty) holds the points with x <= tx < x + eps and y <= ty < y + eps.  It only changes
where tx is some x or x + eps, and all its points are in the cell of (tx, ty) and the three cells to its
left and below, so each cell's windows can be formed from that block alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bounds
from tessera.operators.grid import hash_cells

#: Windows handed on at once; rows of a block beyond which its work is dealt to several tasks, the same where a row is a keyword of a point, and where few blocks are asked for.
STEP, SPLIT, KEYWORD_SPLIT, FEW_SPLIT = 1_000_000, 2048, 8192, 256
WINDOWS, BLOCK_WINDOWS = "score double, lon double, lat double", "ci bigint, cj bigint, score double, lon double, lat double"
Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


class Every:
    """Takes all windows of at least theta."""

    def __init__(self, theta: float):
        self.cut, self.found, self.size = theta, [], 0

    def add(self, s: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> None:
        self.found.append((s, lon, lat))
        self.size += len(s)

    def taken(self) -> Arrays:
        found, self.found, self.size = self.found, [], 0
        return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0),) * 3


class Best:
    """Takes the n best windows by score descending, lon, lat, one for each centre, that conflict with no answer."""

    def __init__(self, theta: float, n: int, answers: np.ndarray, eps: float):
        self.cut, self.n, self.answers, self.eps = theta, n, answers, eps
        self.rows: Arrays = (np.zeros(0),) * 3
        self.last: tuple[float, float, float] | None = None

    def add(self, s: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> None:
        keep = np.ones(len(s), bool)
        if self.last is not None:
            _, x, y = self.last
            keep = (s > self.cut) | (lon < x) | (lon == x) & (lat < y)
        for x, y in self.answers:
            keep &= (np.abs(lon - x) > self.eps) | (np.abs(lat - y) > self.eps)
        if not keep.any():
            return
        s, lon, lat = (np.concatenate([r, v[keep]]) for r, v in zip(self.rows, (s, lon, lat), strict=True))
        order = np.lexsort((-s, lat, lon))
        s, lon, lat = s[order], lon[order], lat[order]
        first = np.append(True, (lon[1:] != lon[:-1]) | (lat[1:] != lat[:-1]))
        s, lon, lat = s[first], lon[first], lat[first]
        order = np.lexsort((lat, lon, -s))[: self.n]
        self.rows = s[order], lon[order], lat[order]
        if len(order) == self.n:
            self.last = tuple(float(v[-1]) for v in self.rows)
            self.cut = self.last[0]

    def taken(self) -> Arrays:
        return self.rows


def exact_terms(w: np.ndarray) -> list[np.ndarray] | None:
    """Terms whose sums are w and whose running sums have no rounding, so scores don't depend on any order; None where two are too few."""
    terms, rest = [], w
    for _ in range(2):
        total = float(np.abs(rest).sum())
        if total == 0.0 and terms:
            return terms
        if not np.isfinite(total) or 0.0 < total < 1e-200 or total > 1e200:
            return None
        unit = 2.0 ** (np.frexp(total)[1] - 51)
        terms.append(np.round(rest / unit) * unit)
        rest = rest - terms[-1]
    return None if rest.any() else terms


def middles(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Middles of the least and the largest of v[a:b] for each a < b, by tables over lengths that are powers of two."""
    level = np.frexp((b - a).astype(float))[1] - 1
    out, ends = np.empty(len(a)), np.stack([v, -v])  # the largest is the least of the negative ones
    for n, count in enumerate(np.bincount(level)):
        if count:
            here = (level == n).nonzero()[0] if count < len(a) else slice(None)
            l, h = a[here], b[here] - (1 << n)
            out[here] = (np.minimum(ends[0][l], ends[0][h]) - np.minimum(ends[1][l], ends[1][h])) / 2
            if count == len(a):
                break
        if ends.shape[1] > 1 << n:
            ends = np.minimum(ends[:, : -(1 << n)], ends[:, 1 << n :])
    return out


def sweep(x: np.ndarray, y: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray, at: tuple[int, int], eps: float, to: Every | Best, part: int = 0, parts: int = 1, distinct: bool = False) -> Iterator[Arrays]:
    """Hands a cell's windows of at least ``to.cut`` to ``to``, by a sweep over tx; part: which of its corners' columns are taken.

    For one tx, points in order of y are a range for each ty: a score is a difference of running sums, and centres come
    from the range's ends and its least and largest x.  Only such (tx, ty) are formed where a point comes or goes on
    either axis: any other window holds the points of one of them, further left or down, in its cell or another.
    Between two columns no score rises by more than the weight that comes (or, below 0, goes): columns that can't reach
    ``to.cut`` from the last one's best are passed over; so are, for distinct keywords, those with fewer, and where no window can
    have more than ``to`` has, those that hold points too far right for a centre further left.  Yields where ``to`` holds many, and leaves the rest there.
    """
    order = np.lexsort((x, y))
    x, y, w, i, j = x[order], y[order], w[order], i[order], j[order]
    x_end, y_end = x + eps, y + eps
    event = np.where(i == at[0], x, np.where(i == at[0] - 1, x_end, np.nan))
    tx = np.unique(event[~np.isnan(event)])
    tx = tx[len(tx) * part // parts : len(tx) * (part + 1) // parts]
    by_event = np.argsort(event, kind="stable")  # y stays in order for each of them
    first, last = (np.searchsorted(event[by_event], tx, side) for side in ("left", "right"))
    # ty with the point that comes or goes there, and the range of the block's points in reach
    comes, goes = (j == at[1]).nonzero()[0], (j == at[1] - 1).nonzero()[0]
    ty, source = np.concatenate([y[comes], y_end[goes]]), np.concatenate([comes, goes])
    order = np.argsort(ty, kind="stable")
    ty, source = ty[order], source[order]
    lows, highs = np.searchsorted(y_end, ty, "right"), np.searchsorted(y, ty, "right")
    from_, until = np.searchsorted(ty, y, "left"), np.searchsorted(ty, y_end, "left")
    if distinct:
        value = pa.array(w).dictionary_encode().indices.to_numpy()
        by_code = np.lexsort((y, value))
        code, code_from, code_until = value[by_code], from_[by_code], until[by_code]
        if to.cut > code[-1] + 1:
            return  # the whole block has fewer values
        doubt = 1e-9 * eps + 1e-14 * float(np.abs(x).max())
    else:
        terms = exact_terms(w)
        slack = 0.0 if terms is not None else 1e-9 * float(np.abs(w).sum())
        rise = np.append(0.0, np.cumsum(np.maximum(np.where(i == at[0], w, -w), 0.0)[by_event]))
        doubt = 1e-9 * float(np.abs(w).sum())
    sums, count, need = np.zeros(len(x) + 1), np.zeros(len(x) + 1, int), -np.inf
    for t, e0, e1 in zip(tx, first, last, strict=True):
        if not distinct and rise[e1] < need:
            continue
        own, far = (x <= t) & (x_end > t), None
        if distinct and isinstance(to, Best) and to.last is not None and to.cut > code[-1]:
            # nothing has more values than the block, so centres must be further left: such a window holds no point too far right
            far = own & (x > 2 * to.last[1] - t + eps + doubt)
            out = far.nonzero()[0]
            if t - eps > to.last[1] or len(out) and y[out[0]] <= ty[0] and y_end[out[-1]] > ty[-1] and (y_end[out[:-1]] >= y[out[1:]]).all():
                break  # each ty has one in reach, and there are only more of them from here on
        if distinct and np.count_nonzero(np.bincount(value[own])) < to.cut:
            continue
        # only ty for which a point that comes or goes at t is in reach
        gone = by_event[e0:e1]
        l, h = from_[gone[0]], until[gone].max()
        at_ty = own[source[l:h]].nonzero()[0] + l
        if e1 - e0 > 1:
            at_ty = at_ty[np.searchsorted(y[gone], ty[at_ty], "right") > np.searchsorted(y_end[gone], ty[at_ty], "right")]
        if far is not None and len(at_ty):
            np.cumsum(far, out=count[1:])
            at_ty = at_ty[count[lows[at_ty]] == count[highs[at_ty]]]
        if not len(at_ty):
            continue
        a, b = lows[at_ty], highs[at_ty]
        if distinct:
            # a row counts from its ty until eps more or its keyword's next row
            mine = own[by_code].nonzero()[0]
            k, start, end = code[mine], code_from[mine], code_until[mine]
            same = (k[1:] == k[:-1]).nonzero()[0]
            end[same] = np.minimum(end[same], start[same + 1])
            score = np.cumsum(np.bincount(start, minlength=len(ty) + 1) - np.bincount(end, minlength=len(ty) + 1))[at_ty].astype(float)
        else:
            score = 0.0
            for v in [w] if terms is None else terms:
                np.cumsum(np.where(own, v, 0.0), out=sums[1:])
                score = score + (sums[b] - sums[a])
            if np.isfinite(doubt) and score.max() < to.cut:  # else the next column may reach it too
                every = 0.0
                for v in [w] if terms is None else terms:
                    np.cumsum(np.where(own, v, 0.0), out=sums[1:])
                    every = every + (sums[highs] - sums[lows])
                need = rise[e1] + (to.cut - float(every.max())) - doubt
        fits = (~(score < to.cut - slack) if slack else score >= to.cut) if not distinct else score >= to.cut
        if not fits.any():
            continue
        np.cumsum(own, out=count[1:])
        a, b = count[a], count[b]
        fits = (fits & (b > a)).nonzero()[0]
        if not len(fits):
            continue
        own = own.nonzero()[0]
        a, b, score = a[fits], b[fits], score[fits]
        if not distinct and terms is None:  # weights too far apart for running sums without rounding: one by one, points in order
            pw = w[own]
            score = np.array([pw[l:h].sum() for l, h in zip(a, b, strict=True)])
            keep = (score >= to.cut).nonzero()[0]
            if not len(keep):
                continue
            a, b, score = a[keep], b[keep], score[keep]
        py = y[own]
        to.add(score, middles(x[own], a, b), (py[a] + py[b - 1]) / 2)
        if isinstance(to, Every) and to.size >= STEP:
            yield to.taken()


def kernel(x: np.ndarray, y: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray, at: tuple[int, int], eps: float, theta: float, part: int = 0, parts: int = 1, distinct: bool = False) -> Arrays:
    """Scores and centres of a cell's windows of at least theta; part: which of its corners' columns are taken."""
    to = Every(theta)
    found = [*sweep(x, y, w, i, j, at, eps, to, part, parts, distinct), to.taken()]
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def blocks(weights: DataFrame, eps: float, theta: float, distinct: bool, only: list[tuple[int, int, int]] | None = None, sums: DataFrame | None = None) -> DataFrame:
    """The points of each 2-by-2 block that may reach theta (or those of ``only``), dealt to tasks, sorted; sums: of cells, where they are there already."""
    if only is None:
        cells = bounds.upper_bounds(bounds.cell_sums(weights, eps, distinct) if sums is None else sums).where(F.col("ub") >= theta)
        split = KEYWORD_SPLIT if distinct else SPLIT
        cells = cells.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.greatest(F.lit(1), F.ceil(F.col("m") / split)).cast("int").alias("parts"))
    elif len(only) > 256:
        cells = F.broadcast(weights.sparkSession.createDataFrame(only, "ci bigint, cj bigint, parts int"))
    else:  # as literals: less of a job
        asked = F.array(*(F.struct(F.lit(i).cast("bigint").alias("ci"), F.lit(j).cast("bigint").alias("cj"), F.lit(parts).alias("parts")) for i, j, parts in only))
        cells = F.broadcast(weights.sparkSession.range(1).select(F.inline(asked)))
    step = F.sequence(F.lit(0), F.lit(1))
    spread = hash_cells(weights, eps).withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    spread = spread.withColumns({"ci": F.col("i") + F.col("di"), "cj": F.col("j") + F.col("dj")}).drop("di", "dj")
    dealt = spread.join(cells, ["ci", "cj"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return to_tasks(dealt.select("ci", "cj", "part", "parts", "lon", "lat", "w", "i", "j"), "ci", "cj", "part", "lon", "lat", "w", most=None if only is None else sum(parts for *_, parts in only))


def to_tasks(rows: DataFrame, *order: str, most: int | None = None) -> DataFrame:
    """Rows of ci, cj, part in one task each, in order; a stated number (no more than blocks, if that is known): small rows, long work, so partitions are not to be put together."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks if most is None else min(tasks, most), "ci", "cj", "part").sortWithinPartitions(*order)


def each_block(swept: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands on the rows of blocks (ci, cj, part) that come one after the other; one that a batch cuts is kept for the next."""

    def solve(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[dict[str, np.ndarray]] = []
        for frame in chain(frames, [None]):
            if frame is not None and frame.num_rows:
                rest.append({n: frame.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(frame.schema.names)})
                ends = [rest[0], rest[-1]]
                if all(ends[0][n][0] == ends[1][n][-1] for n in ("ci", "cj", "part")):
                    continue  # one block so far
            if not rest or frame is not None and not frame.num_rows:
                continue
            rows = {n: np.concatenate([r[n] for r in rest]) for n in rest[0]}
            ci, cj, part = rows["ci"], rows["cj"], rows["part"]
            edges = np.flatnonzero((ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1]) | (part[1:] != part[:-1])) + 1
            starts = np.concatenate([[0], edges])
            ends = np.append(edges, len(ci)) if frame is None else edges
            rest = [{n: c[starts[-1] :] for n, c in rows.items()}]
            for a, b in zip(starts, ends, strict=False):
                yield from swept({n: c[a:b] for n, c in rows.items()})

    return solve


def solver(eps: float, to: Callable[[tuple[int, int]], Every | Best], distinct: bool, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sweeps blocks."""

    def swept(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = (int(rows["ci"][0]), int(rows["cj"][0]))
        taker = to(at)
        for last, found in chain(((False, f) for f in sweep(*(rows[c] for c in ("lon", "lat", "w", "i", "j")), at, eps, taker, int(rows["part"][0]), int(rows["parts"][0]), distinct)), [(True, None)]):
            found = taker.taken() if last else found
            own = [np.full(len(found[0]), c) for c in at] if names[0] == "ci" else []
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*own, *found)], names=names)

    return each_block(swept)


def candidates(weights: DataFrame, eps: float, theta: float = 0.0, distinct: bool = False) -> DataFrame:
    """score, lon, lat of every window of at least theta, one row for each centre (its best score).

    ``distinct``: a score is the number of distinct values of w.
    """
    eps = float(eps)
    found = blocks(weights, eps, theta, distinct).mapInArrow(solver(eps, lambda at: Every(theta), distinct, ["score", "lon", "lat"]), WINDOWS)
    return found.groupBy("lon", "lat").agg(F.max("score").alias("score")).select("score", "lon", "lat")


def best_of_parts(weights: DataFrame, eps: float, theta: float, n: int, answers: list[tuple[float, float, float]] = (), distinct: bool = False, only: list[tuple[int, int, int]] | None = None, sums: DataFrame | None = None) -> DataFrame:
    """ci, cj, score, lon, lat: the n best windows with a corner in each part of a cell's columns that conflict with no answer.

    ``only``: the cells asked for and their parts.
    """
    eps, taken = float(eps), np.array([(x, y) for _, x, y in answers]).reshape(-1, 2)
    return blocks(weights, eps, theta, distinct, only, sums).mapInArrow(solver(eps, lambda at: Best(theta, n, taken, eps), distinct, ["ci", "cj", "score", "lon", "lat"]), BLOCK_WINDOWS)


def best_of_blocks(weights: DataFrame, eps: float, theta: float, n: int, distinct: bool = False, sums: DataFrame | None = None) -> DataFrame:
    """ci, cj, score, lon, lat, r: the n best windows with a corner in each cell (one for each centre), and their ranks."""
    found = best_of_parts(weights, eps, theta, n, distinct=distinct, sums=sums).groupBy("ci", "cj", "lon", "lat").agg(F.max("score").alias("score"))
    order = Window.partitionBy("ci", "cj").orderBy(F.desc("score"), "lon", "lat")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)


def at_resolution(found: DataFrame, resolution: float) -> DataFrame:
    """Centres that agree to a resolution are one: the best of them stays."""
    key = lambda c: F.floor(F.col(c) / F.lit(resolution))
    order = F.struct(F.col("score"), -F.col("lon"), -F.col("lat"))
    best = found.groupBy(key("lon").alias("a"), key("lat").alias("b")).agg(F.max(order).alias("top"))
    return best.select(F.col("top.score").alias("score"), (-F.col("top.col2")).alias("lon"), (-F.col("top.col3")).alias("lat"))


def distinct_keywords(points: DataFrame, regions: DataFrame, eps: float, keyword_column: str = "keywords") -> DataFrame:
    """lon, lat, n_keywords: distinct keywords of the points in each region's square (borders count)."""
    half = F.lit(float(eps) / 2)
    around = F.sequence(F.lit(-1), F.lit(1))
    given = hash_cells(points.select("lon", "lat", keyword_column), eps).withColumnsRenamed({"lon": "x", "lat": "y"})
    asked = hash_cells(regions.select("lon", "lat"), eps).withColumn("di", F.explode(around)).withColumn("dj", F.explode(around))
    asked = asked.select("lon", "lat", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    inside = (F.abs(F.col("x") - F.col("lon")) <= half) & (F.abs(F.col("y") - F.col("lat")) <= half)
    found = asked.join(given, ["i", "j"]).where(inside).select("lon", "lat", F.explode(F.split(keyword_column, ";")).alias("k"))
    return found.groupBy("lon", "lat").agg(F.countDistinct("k").alias("n_keywords"))
