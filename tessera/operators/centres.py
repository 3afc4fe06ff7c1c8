"""Windows of side eps by the cell of their centres, from the points of the cell and the eight around it.

A window's corner (tx, ty) is in its centre's cell or the next one, on either axis.  All windows with
one centre meet in one place, so none of them has to be moved to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bounds, filters, windows
from tessera.operators.grid import hash_cells

#: Points around a cell beyond which its work is dealt to several tasks, each with its own strip of centres; the same where all windows are formed, and windows of a strip held at once.
SPLIT, EVERY_SPLIT, HELD = 16384, 4096, 1_000_000


class Around:
    """The points around a cell of centres in order of y, and the columns tx and rows ty of its windows' corners."""

    def __init__(self, rows: dict[str, np.ndarray], at: tuple[int, int], eps: float):
        order = np.lexsort((rows["w"], rows["lon"], rows["lat"]))
        self.x, self.y, self.w, i, j = (rows[c][order] for c in ("lon", "lat", "w", "i", "j"))
        self.at, self.eps, self.x_end, self.y_end = at, eps, self.x + eps, self.y + eps
        event, self.point, self.come = self._events(self.x, self.x_end, i, at[0])
        self.tx, self.first = np.unique(event, return_index=True)
        self.last = np.append(self.first[1:], len(event))
        self.ty, self.source, _ = self._events(self.y, self.y_end, j, at[1])
        #: The range of the points in reach of each ty.
        self.lows, self.highs = np.searchsorted(self.y_end, self.ty, "right"), np.searchsorted(self.y, self.ty, "right")
        self.doubt = 1e-9 * eps + 1e-14 * float(np.abs(self.x).max() + np.abs(self.y).max())

    @staticmethod
    def _events(v: np.ndarray, end: np.ndarray, cell: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a point comes or goes, the point, and whether it comes, in order."""
        comes, goes = (cell >= at).nonzero()[0], (cell <= at).nonzero()[0]
        event, point, come = np.concatenate([v[comes], end[goes]]), np.concatenate([comes, goes]), np.arange(len(comes) + len(goes)) < len(comes)
        order = np.lexsort((point, event))
        return event[order], point[order], come[order]

    def own(self, t: float) -> np.ndarray:
        return (self.x <= t) & (self.x_end > t)

    def free(self, t: float, least: float, largest: float) -> bool:
        """Whether a window at t may hold no point left of the least and right of the largest x."""
        out = (self.own(t) & ((self.x < least) | (self.x > largest))).nonzero()[0]
        return not len(out) or self.y[out[0]] > self.ty[0] or self.y_end[out[-1]] <= self.ty[-1] or bool((self.y_end[out[:-1]] < self.y[out[1:]]).any())

    def columns(self, west: float, east: float) -> tuple[int, int]:
        """The range of columns that may have centres from west to east: the others' windows hold points too far left or right.

        Points too far left get fewer from column to column from ``west`` on, and those too far right get more until
        ``east`` + eps, so both ends are found by halving.
        """
        low, high = np.searchsorted(self.tx, [west - self.doubt / 2, east + self.eps + self.doubt / 2])
        ends = [int(low), int(high)]
        for k, ok in enumerate((lambda t: self.free(t, 2 * west - t - self.doubt, np.inf), lambda t: not self.free(t, -np.inf, 2 * east - t + self.eps + self.doubt))):
            a, b = int(low), int(high)
            while a < b:
                c = (a + b) // 2
                a, b = (a, c) if ok(self.tx[c]) else (c + 1, b)
            ends[k] = a
        return ends[0], ends[1]

    def strip(self, lon: np.ndarray, parts: int) -> np.ndarray:
        """The number of each centre's strip, of so many in a cell, and another one for centres in other cells."""
        cell = lon / self.eps
        return np.where(np.floor(cell) == self.at[0], np.clip(np.floor((cell - self.at[0]) * parts), 0, parts - 1), -1)

    def ends(self, part: int, parts: int) -> tuple[float, float]:
        return (self.at[0] + part / parts) * self.eps, (self.at[0] + (part + 1) / parts) * self.eps

    def ends_lat(self) -> tuple[float, float]:
        return self.at[1] * self.eps, (self.at[1] + 1) * self.eps


def top(points: Around, part: int = 0, parts: int = 1) -> float | None:
    """The best score of the windows with centres in a strip of the cell; None without any.

    One column after the other is looked at as a whole, and columns are passed over as long as the weight that comes
    (or, below 0, goes) can't lift the last one's best over the best so far.  Points too far up or down for a centre in
    the cell don't count towards a column's best, since no window with such a centre holds them.
    """
    west, east = points.ends(part, parts)
    south, north = points.ends_lat()
    low, high = points.columns(west, east)
    if low >= high:
        return None
    lows = np.maximum(points.lows, np.searchsorted(points.y, 2 * south - points.ty - points.doubt))
    highs = np.minimum(points.highs, np.searchsorted(points.y, 2 * north - points.ty + points.eps + points.doubt, "right"))
    rows = (lows < highs).nonzero()[0]
    lows, highs, all_lows, all_highs = lows[rows], highs[rows], points.lows[rows], points.highs[rows]
    terms, total = windows.exact_terms(points.w), float(np.abs(points.w).sum())
    slack = 0.0 if terms is not None else 1e-9 * total
    w = points.w[points.point]
    rise = np.cumsum(np.maximum(np.where(points.come, w, -w), 0.0))[points.last - 1]
    best: float | None = None
    sums, count = np.zeros(len(points.x) + 1), np.zeros(len(points.x) + 1, int)

    def look(k: int) -> float:
        """A column's best, of the points that count; the best of its centres in the strip is taken."""
        nonlocal best
        own, score = points.own(points.tx[k]), 0.0
        for v in [points.w] if terms is None else terms:
            np.cumsum(np.where(own, v, 0.0), out=sums[1:])
            score = score + (sums[highs] - sums[lows])
        better = (np.ones(len(rows), bool) if best is None else ~(score + slack <= best)).nonzero()[0]
        if len(better):
            np.cumsum(own, out=count[1:])
            a, b = count[all_lows[better]], count[all_highs[better]]
            better, a, b = better[a < b], a[a < b], b[a < b]
        if len(better):
            px, py, pw = points.x[own], points.y[own], points.w[own]
            ours = (points.strip(windows.middles(px, a, b), parts) == part) & (np.floor((py[a] + py[b - 1]) / 2 / points.eps) == points.at[1])
            if ours.any():
                found = score[better[ours]] if terms is not None else np.array([pw[l:h].sum() for l, h in zip(a[ours], b[ours], strict=True)])
                best = float(found.max() if best is None else np.maximum(best, found.max()))
        return float(score.max())

    if not len(rows):
        return None
    if high - low > 64:
        for k in range(low, high, (high - low) // 32):
            look(k)
    k = low
    while k < high and not (best is not None and np.isnan(best)):  # nothing is over NaN
        most, after = look(k), k + 1
        if best is not None and np.isfinite(total):
            after = max(after, int(np.searchsorted(rise, rise[k] + (best - most) - 1e-9 * total)))
        k = after
    return best


def strip_windows(points: Around, theta: float, part: int, parts: int) -> windows.Arrays | None:
    """Scores and centres of a strip's windows of at least theta, a set of points once; None if there are too many for one strip.

    As in ``windows.sweep``, only those (tx, ty) are formed where a point comes or goes on either axis.  Rows where
    points that are in reach of all the strip's columns are too far up or down for the cell are left out first, then
    the points that are in reach of no column or row.
    """
    none, eps, doubt = (np.zeros(0),) * 3, points.eps, points.doubt
    west, east = points.ends(part, parts)
    south, north = points.ends_lat()
    low, high = points.columns(west, east)
    if low >= high:
        return none
    tx = points.tx[low:high]
    always = np.append(0, np.cumsum((points.x <= tx[0]) & (points.x_end > tx[-1])))
    too_low, too_high = np.searchsorted(points.y, 2 * south - points.ty - doubt), np.searchsorted(points.y, 2 * north - points.ty + eps + doubt, "right")
    rows = (always[np.maximum(points.lows, too_low)] == always[points.lows]) & (always[np.minimum(points.highs, too_high)] == always[points.highs])
    rows &= points.lows < points.highs
    if not rows.any():
        return none
    ty, lows, highs = points.ty[rows], points.lows[rows], points.highs[rows]
    kept = (points.x_end >= tx[0]) & (points.x <= tx[-1])
    kept[: np.searchsorted(points.y_end, ty[0])] = kept[highs[-1] :] = False
    new = np.append(0, np.cumsum(kept))
    lows, highs, source = new[lows], new[highs], points.source[rows]
    source = np.where(kept[source], new[source], new[-1])  # one place more, for points that are in no column
    x, y, w, x_end, y_end = (v[kept] for v in (points.x, points.y, points.w, points.x_end, points.y_end))
    event = points.point[points.first[low] : points.last[high - 1]]
    column = np.repeat(np.arange(high - low), points.last[low:high] - points.first[low:high])[kept[event]]
    event = new[event[kept[event]]]
    if not len(event):
        return none
    columns, first = np.unique(column, return_index=True)
    last = np.append(first[1:], len(column))
    terms = windows.exact_terms(points.w)
    terms = terms if terms is None else [v[kept] for v in terms]
    by_x, by_end = np.argsort(x, kind="stable"), np.argsort(x_end, kind="stable")
    come, gone = np.searchsorted(x[by_x], tx[columns], "right"), np.searchsorted(x_end[by_end], tx[columns], "right")
    from_, until = np.searchsorted(ty, y, "left"), np.searchsorted(ty, y_end, "left")
    own, count, found, size = np.zeros(len(x) + 1, bool), np.zeros(len(x) + 1, int), [], 0
    came = went = 0
    for c, e0, e1 in zip(range(len(columns)), first, last, strict=True):
        own[by_x[came : come[c]]] = True
        own[by_end[went : gone[c]]] = False
        came, went = come[c], gone[c]
        events = event[e0:e1]
        l, h = from_[events[0]], until[events[-1]]
        if l >= h:
            continue
        at_ty = own[source[l:h]].nonzero()[0] + l
        if e1 - e0 > 1:
            at_ty = at_ty[np.searchsorted(y[events], ty[at_ty], "right") > np.searchsorted(y_end[events], ty[at_ty], "right")]
        np.cumsum(own[:-1], out=count[1:])
        a, b = count[lows[at_ty]], count[highs[at_ty]]
        fits = a < b
        if not fits.all():
            a, b = a[fits], b[fits]
        if not len(a):
            continue
        here = own.nonzero()[0]
        py = y[here]
        lat = (py[a] + py[b - 1]) / 2
        if not (lat.min() > south + doubt and lat.max() < north - doubt):
            fits = np.floor(lat / eps) == points.at[1]
            a, b, lat = a[fits], b[fits], lat[fits]
            if not len(a):
                continue
        lon = windows.middles(x[here], a, b)
        if not (lon.min() > west + doubt and lon.max() < east - doubt):
            fits = points.strip(lon, parts) == part
            a, b, lat, lon = a[fits], b[fits], lat[fits], lon[fits]
        if terms is None:  # weights too far apart for running sums without rounding: one by one, points in order
            pw = w[here]
            score = np.array([pw[l:h].sum() for l, h in zip(a, b, strict=True)])
        else:
            score = 0.0
            for v in terms:
                sums = np.append(0.0, np.cumsum(v[here]))
                score = score + (sums[b] - sums[a])
        if theta > -np.inf:
            fits = score >= theta
            score, lon, lat = score[fits], lon[fits], lat[fits]
        found.append((score, lon, lat))
        size += len(score)
        if size > HELD and parts < 1 << 30:
            return None
    return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else none


def once(score: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> windows.Arrays:
    """The best score of each centre: rows that share a hash with another one are compared, all others stay as they are."""
    lon, lat = lon + 0.0, lat + 0.0  # 0 and -0 are one
    mixed = lon.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lat.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    in_order = np.sort(mixed)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return score, lon, lat
    ends = np.zeros(1 << 16, bool)
    ends[twice & np.uint64(0xFFFF)] = True
    some = ends[mixed & np.uint64(0xFFFF)].nonzero()[0]
    shared = np.zeros(len(mixed), bool)
    shared[some[np.isin(mixed[some], twice)]] = True
    s, x, y = score[shared], lon[shared], lat[shared]
    order = np.lexsort((s, y, x))  # NaN last: it is the largest
    s, x, y = s[order], x[order], y[order]
    last = np.append((x[1:] != x[:-1]) | (y[1:] != y[:-1]), True)
    return tuple(np.concatenate([v[~shared], o[last]]) for v, o in zip((score, lon, lat), (s, x, y), strict=True))


def every(points: Around, theta: float = float("-inf"), part: int = 0, parts: int = 1) -> Iterator[windows.Arrays]:
    """Scores and centres of the windows of at least theta with centres in a strip of the cell, one for each centre, strip by strip."""
    strips = max(1, int((len(points.x) / 9) ** 2 * 8 / HELD / parts))
    todo = [(strips * part + n, strips * parts) for n in reversed(range(strips))]
    while todo:
        n, of = todo.pop()
        found = strip_windows(points, theta, n, of)
        if found is None:
            todo += [(2 * n + 1, 2 * of), (2 * n, 2 * of)]
        elif len(found[0]):
            yield once(*found)


def dealt(weights: DataFrame, eps: float, split: int) -> DataFrame:
    """The points around each cell that may have centres, one row for each place, dealt to tasks, sorted."""
    around = F.sequence(F.lit(-1), F.lit(1))
    near = lambda rows: rows.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around)).withColumns({"ci": F.col("i") + F.col("di"), "cj": F.col("j") + F.col("dj")}).drop("di", "dj")
    places = filters.merged(weights)
    cells = near(bounds.cell_sums(places, eps)).groupBy("ci", "cj").agg(F.ceil(F.sum("n") / split).cast("int").alias("parts"))
    rows = near(hash_cells(places, eps)).join(cells, ["ci", "cj"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return windows.to_tasks(rows.select("ci", "cj", "part", "parts", "lon", "lat", "w", "i", "j"), "ci", "cj", "part")


def cell_tops(weights: DataFrame, eps: float) -> DataFrame:
    """i, j, top: the best window's score in each cell of centres."""
    eps = float(eps)

    def solve(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = (int(rows["ci"][0]), int(rows["cj"][0]))
        found = top(Around(rows, at, eps), int(rows["part"][0]), int(rows["parts"][0]))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (found, *at)], names=["top", "i", "j"])

    found = dealt(weights, eps, SPLIT).mapInArrow(windows.each_block(solve), "top double, i bigint, j bigint")
    return found.groupBy("i", "j").agg(F.max("top").alias("top"))


def candidates(weights: DataFrame, eps: float, theta: float = float("-inf")) -> DataFrame:
    """score, lon, lat of every window of at least theta, one row for each centre (its best score)."""
    eps = float(eps)

    def solve(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        points = Around(rows, (int(rows["ci"][0]), int(rows["cj"][0])), eps)
        for found in every(points, theta, int(rows["part"][0]), int(rows["parts"][0])):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["score", "lon", "lat"])

    return dealt(weights, eps, EVERY_SPLIT).mapInArrow(windows.each_block(solve), windows.WINDOWS)
