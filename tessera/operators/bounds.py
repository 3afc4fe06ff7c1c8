"""Bounds that let most cells be dropped before any window is formed.

Weights are not negative.  Cells have side eps and a common origin.  A cell's number of distinct
keywords may take the place of its sum: no block has more of them than its cells together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.grid import hash_cells


def cell_sums(weights: DataFrame, eps: float, distinct: bool = False) -> DataFrame:
    """i, j, s, n: weight, or number of distinct values of w, and rows of each cell with points."""
    score = F.count_distinct("w").cast("double") if distinct else F.sum("w")
    return hash_cells(weights, eps).groupBy("i", "j").agg(score.alias("s"), F.count("*").alias("n"))


def upper_bounds(cells: DataFrame) -> DataFrame:
    """i, j, ub, m: the weight and rows of a cell, its left, its lower and its lower left neighbour.

    No window whose upper right corner is in the cell weighs more.  Cells without points
    of their own are listed too.
    """
    step = F.sequence(F.lit(0), F.lit(1))
    spread = cells.withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    spread = spread.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "s", "n")
    return spread.groupBy("i", "j").agg(F.sum("s").alias("ub"), F.sum("n").alias("m"))


def threshold(cells: DataFrame, k: int, distinct: bool) -> DataFrame:
    """One row, theta: a lower bound of the k-th result's score (0 if unknown).

    A cell's points are a window, so with overlap the k-th largest cell will do.  Without overlap, cells
    of equal parity are mutually disjoint and a square touches four of them at most, so k - 1 results
    block 4 (k - 1): the (4 k - 3)-th largest of any one parity class will do.
    """
    nth = 4 * k - 3 if distinct else k
    parity = (F.pmod("i", F.lit(2)) * 2 + F.pmod("j", F.lit(2))) if distinct else F.lit(0)
    ranked = []
    for p in range(4 if distinct else 1):  # a top-k of each class: nothing but nth rows leaves a task
        top = cells.where(parity == p).orderBy(F.desc("s")).limit(nth)
        ranked.append(top.agg(F.min("s").alias("least"), F.count("*").alias("n")).select(F.when(F.col("n") == nth, F.col("least")).otherwise(F.lit(0.0)).alias("theta")))
    found = ranked[0]
    for other in ranked[1:]:
        found = found.unionByName(other)
    return found.agg(F.coalesce(F.max("theta"), F.lit(0.0)).alias("theta"))


def best_of_cells(candidates: DataFrame, eps: float) -> DataFrame:
    """i, j, top: the best candidate's score in each cell of centres."""
    return hash_cells(candidates, eps).groupBy("i", "j").agg(F.max("score").alias("top"))


def rank_all(rows: DataFrame) -> DataFrame:
    """Adds rank to a small result (the caller has limited it): score descending, then lon and lat."""
    order = Window.orderBy(F.desc("score"), "lon", "lat")
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))
