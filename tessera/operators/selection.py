"""Choosing k regions from candidates (score, lon, lat).

Two squares conflict if they touch: both centre distances are at most eps.  The order is
score descending, then lon, then lat, everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bounds, windows

Region = tuple[float, float, float]  # score, lon, lat


def conflict(a: Region, b: Region, eps: float) -> bool:
    return abs(a[1] - b[1]) <= eps and abs(a[2] - b[2]) <= eps


class Chosen:
    """Regions picked so far, looked up by cell, so a conflict test is nine look-ups."""

    def __init__(self, eps: float):
        self.eps, self.rows, self.cells = eps, [], {}

    def _cell(self, r: Region) -> tuple[int, int]:
        return int(r[1] // self.eps), int(r[2] // self.eps)

    def free(self, r: Region) -> bool:
        i, j = self._cell(r)
        return not any(conflict(r, other, self.eps) for di in (-1, 0, 1) for dj in (-1, 0, 1) for other in self.cells.get((i + di, j + dj), ()))

    def add(self, r: Region) -> None:
        self.rows.append(r)
        self.cells.setdefault(self._cell(r), []).append(r)

    def keep_first(self, n: int) -> None:
        for r in self.rows[n:]:
            self.cells[self._cell(r)].remove(r)
        del self.rows[n:]


def greedy(ordered: Iterable[Region], k: int, eps: float) -> list[Region]:
    """The best candidate that conflicts with none before it, k times."""
    chosen = Chosen(eps)
    for r in ordered:
        if chosen.free(r):
            chosen.add(r)
            if len(chosen.rows) == k:
                break
    return chosen.rows


def in_order(candidates: DataFrame) -> Iterator[Region]:
    """Candidates best first, a partition at a time, without holding more."""
    for r in candidates.orderBy(F.desc("score"), "lon", "lat").select("score", "lon", "lat").toLocalIterator(prefetchPartitions=True):
        yield (r["score"], r["lon"], r["lat"])


def prefixes(candidates: DataFrame, k: int, factor: int = 16) -> Iterator[list[Region]]:
    """Ever longer prefixes of the order, by top-k jobs, while a longer one is a matter of a few rows; the last one says all."""
    n = factor * k
    while n <= 100_000:
        rows = [tuple(r) for r in candidates.orderBy(F.desc("score"), "lon", "lat").limit(n).select("score", "lon", "lat").collect()]
        yield rows
        if len(rows) < n:
            return
        n *= 8


class Blocks:
    """The best windows of each block of cells, in place of a table of all windows.

    Windows with their upper right corner in one cell are a block.  A square touches those of 4 by 4 blocks at most,
    and a centre is listed in 2 by 2 at most, so k regions, each among the n best free ones when it is picked,
    come from the 16 (k - 1) + 4 n blocks with the best windows: no others are held here.  A block whose listed
    windows don't tell the next best is asked again, for windows that conflict with no answer.
    """

    def __init__(self, weights: DataFrame, sums: DataFrame, eps: float, theta: float, k: int, n: int, distinct: bool, checkpoint: Callable[[DataFrame], DataFrame]):
        self.weights, self.sums, self.eps, self.theta, self.distinct, self.checkpoint = weights, sums, float(eps), theta, distinct, checkpoint
        held = 16 * (k - 1) + 4 * n
        n = min(n, 16)
        found = checkpoint(windows.best_of_blocks(weights, eps, theta, n, distinct=distinct, sums=sums))
        first = found.where("r = 1").orderBy(F.desc("score"), "lon", "lat", "ci", "cj").limit(held).select("ci", "cj")
        #: All that is not listed of a block comes after this; None: nothing is left.
        self.ends: dict[tuple[int, int], tuple[float, float, float] | None] = {}
        self.rows: dict[tuple[int, int], list[Region]] = {}
        self._hold(found.join(F.broadcast(first), ["ci", "cj"]), n, theta)
        self.complete = len(self.rows) < held
        #: What is worse than this may have better ones in blocks that are not held.
        self.bar = None if self.complete else max(self.order(rows[0]) for rows in self.rows.values())
        self.sizes: dict[tuple[int, int], int] | None = None

    @staticmethod
    def order(r: Region) -> tuple[float, float, float]:
        return (-r[0], r[1], r[2])

    def _hold(self, found: DataFrame, n: int, floor: float) -> None:
        best: dict[tuple[int, int], dict[tuple[float, float], float]] = {}
        for r in found.select("ci", "cj", "score", "lon", "lat").collect():
            scores = best.setdefault((r["ci"], r["cj"]), {})
            scores[r["lon"], r["lat"]] = max(r["score"], scores.get((r["lon"], r["lat"]), r["score"]))
        for at in [*self.rows.keys(), *best.keys() - self.rows.keys()]:
            if at not in self.ends:
                rows = self.rows[at] = sorted(((s, x, y) for (x, y), s in best.get(at, {}).items()), key=self.order)[:n]
                self.ends[at] = self.order(rows[-1]) if len(rows) == n else (-floor, math.inf, math.inf) if floor > self.theta else None

    def ask(self, cells: list[tuple[int, int]], answers: list[Region], n: int, floor: float | None = None) -> None:
        """The n best windows of these blocks, of at least a score, that conflict with no answer."""
        floor = self.theta if floor is None else max(floor, self.theta)
        spark = self.weights.sparkSession
        if self.sizes is None:
            held = spark.createDataFrame(list(self.rows), "i bigint, j bigint")
            sums = bounds.upper_bounds(self.sums).join(F.broadcast(held), ["i", "j"])
            self.sizes = {(r["i"], r["j"]): r["m"] for r in sums.collect()}
        for at in cells:
            self.rows[at] = []
            del self.ends[at]
        only = [(*at, -(-self.sizes[at] // windows.FEW_SPLIT)) for at in cells]
        self._hold(windows.best_of_parts(self.weights, self.eps, floor, n, answers, self.distinct, only), n, floor)

    def free(self, answers: list[Region], n: int) -> list[Region]:
        """The n best windows that conflict with no answer."""
        chosen = Chosen(self.eps)
        for r in answers:
            chosen.add(r)
        while True:
            open_ = {at: [r for r in rows if chosen.free(r)] for at, rows in self.rows.items()}
            best: dict[tuple[float, float], Region] = {}
            for rows in open_.values():
                for r in rows:
                    if r[1:] not in best or best[r[1:]][0] < r[0]:
                        best[r[1:]] = r
            found = sorted(best.values(), key=self.order)[:n]
            end = self.order(found[-1]) if len(found) == n else None
            stale = [at for at, last in self.ends.items() if last is not None and len(open_[at]) < n and (end is None or last < end)]
            if not stale:
                return found
            self.ask(stale, answers, n, None if end is None else found[-1][0])

    def rounds(self, k: int) -> list[Region]:
        """Greedy's k picks by elimination: each round picks every window that is the best of all blocks it may touch."""
        picked = Chosen(self.eps)
        while True:
            lost = [at for at, rows in self.rows.items() if self.ends[at] is not None and not any(map(picked.free, rows))]
            if lost:
                self.ask(lost, picked.rows, 1)
            open_ = {at: best for at, rows in self.rows.items() if (best := next(filter(picked.free, rows), None)) is not None}
            ordered = sorted(open_.items(), key=lambda e: self.order(e[1]))
            done = sorted(picked.rows, key=self.order)[:k]
            if not ordered or len(done) == k and self.order(done[-1]) < self.order(ordered[0][1]):
                return done
            before: set[tuple[int, int]] = set()
            for (i, j), best in ordered:
                if not any((i + di, j + dj) in before and open_[i + di, j + dj] != best for di in range(-3, 4) for dj in range(-3, 4)) and picked.free(best):
                    picked.add(best)
                before.add((i, j))


def single_round(candidates: DataFrame | Blocks, k: int, eps: float) -> list[Region]:
    """Greedy over a prefix, longer if needed; a pick depends on better candidates only, so a prefix is enough."""
    if isinstance(candidates, Blocks):
        found: list[Region] = []
        while len(found) < k and (best := candidates.free(found, 1)):
            found += best
        return found
    for rows in prefixes(candidates, k):
        found = greedy(rows, k, eps)
        if len(found) == k or len(rows) < 16 * k:
            return found
    return greedy(in_order(candidates), k, eps)


def decided(candidates: DataFrame, eps: float, checkpoint, k: int | None = None) -> DataFrame:
    """Regions that greedy selection would pick, by rounds of a distributed elimination: all, or the k best at least.

    A candidate without a better undecided neighbour is picked, and its neighbours go; the best one left is always
    decided, so this ends, and after k rounds at the latest k picks are better than all that is open.  ``checkpoint`` cuts a table's lineage.
    """
    e = F.lit(float(eps))
    around = F.sequence(F.lit(-1), F.lit(1))
    cells = candidates.select("score", "lon", "lat", F.floor(F.col("lon") / e).alias("i"), F.floor(F.col("lat") / e).alias("j"))
    open_, picked = checkpoint(cells), None
    while (best := open_.orderBy(F.desc("score"), "lon", "lat").select("score", "lon", "lat").first()) is not None:
        if k is not None and picked is not None:
            s, x, y = (F.lit(v) for v in best)
            ahead = (F.col("score") > s) | (F.col("score") == s) & ((F.col("lon") < x) | (F.col("lon") == x) & (F.col("lat") < y))
            if picked.where(ahead).limit(k).count() == k:
                break
        near = open_.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around))
        near = near.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), F.col("score").alias("s"), F.col("lon").alias("x"), F.col("lat").alias("y"))
        touching = (F.abs(F.col("x") - F.col("lon")) <= e) & (F.abs(F.col("y") - F.col("lat")) <= e)
        better = (F.col("s") > F.col("score")) | (F.col("s") == F.col("score")) & ((F.col("x") < F.col("lon")) | (F.col("x") == F.col("lon")) & (F.col("y") < F.col("lat")))
        losing = open_.join(near, ["i", "j"]).where(touching & better).select("lon", "lat").distinct()
        won = checkpoint(open_.join(losing, ["lon", "lat"], "left_anti").select("score", "lon", "lat", "i", "j"))
        reach = won.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around)).select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), F.col("lon").alias("x"), F.col("lat").alias("y"))
        gone = open_.join(reach, ["i", "j"]).where(touching).select("lon", "lat").distinct()
        open_ = checkpoint(open_.join(gone, ["lon", "lat"], "left_anti").select("score", "lon", "lat", "i", "j"))
        picked = won if picked is None else picked.unionByName(won)
    return (picked if picked is not None else open_).select("score", "lon", "lat")


def hybrid(candidates: DataFrame | Blocks, k: int, eps: float, checkpoint) -> list[Region]:
    """Distributed elimination on a prefix of the order, longer if needed, or on blocks."""
    if isinstance(candidates, Blocks):
        return candidates.rounds(k)
    n = 64 * k
    while True:
        part = checkpoint(candidates.orderBy(F.desc("score"), "lon", "lat").limit(n))
        found = [tuple(r) for r in decided(part, eps, checkpoint, k).orderBy(F.desc("score"), "lon", "lat").limit(k).collect()]
        if len(found) == k or part.count() < n:
            return found
        n *= 8


def multi_round(candidates: DataFrame | Blocks, k: int, eps: float, kprime: int = 5) -> list[Region]:
    """Rounds: the best candidates that conflict with no answer so far; of these the prefix up to the first conflict is accepted."""
    chosen = Chosen(eps)
    while len(chosen.rows) < k:
        rows = free_top(candidates, chosen.rows, min(kprime, k - len(chosen.rows)), eps)
        if not rows:
            break
        for r in rows:
            if not chosen.free(r):
                break
            chosen.add(r)
    return chosen.rows


def free_top(candidates: DataFrame | Blocks, answers: list[Region], n: int, eps: float) -> list[Region]:
    """The n best candidates that conflict with no answer; answers are a literal array of k rows at most."""
    if isinstance(candidates, Blocks):
        return candidates.free(answers, n)
    rows = candidates
    if answers:
        taken = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for _, x, y in answers))
        rows = rows.where(~F.exists(taken, lambda t: (F.abs(t["x"] - F.col("lon")) <= F.lit(float(eps))) & (F.abs(t["y"] - F.col("lat")) <= F.lit(float(eps)))))
    return [tuple(r) for r in rows.orderBy(F.desc("score"), "lon", "lat").limit(n).select("score", "lon", "lat").collect()]


def approximate(candidates: DataFrame | Blocks, k: int, eps: float, sigma: float) -> list[Region]:
    """As multi_round, but a round goes on after its first conflict, at score c, while scores reach sigma * c.

    Falling below that takes back what the round accepted after the conflict, and ends it.
    """
    answers: list[Region] = []
    while len(answers) < k:
        rows = free_top(candidates, answers, k - len(answers), eps)
        if not rows:
            break
        chosen, mark, limit = Chosen(eps), 0, None
        for r in rows:
            if limit is not None and r[0] < sigma * limit:
                chosen.keep_first(mark)
                break
            if chosen.free(r):
                chosen.add(r)
            elif limit is None:
                limit, mark = r[0], len(chosen.rows)
        answers += chosen.rows
    return sorted(answers, key=lambda r: (-r[0], r[1], r[2]))
