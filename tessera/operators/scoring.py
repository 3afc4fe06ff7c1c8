"""Scores of point sets: grid aggregates and merging of equal places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import bounds

Score = Callable[[Column], Column]
#: Named aggregates over a point set's weights; any function of a column to an aggregate may take their place.
SCORES: dict[str, Score] = {"sum": F.sum, "count": lambda w: F.count(w).cast("double"), "max": F.max, "distinct_keywords": lambda w: F.count_distinct(w).cast("double")}


def uniform_grid(weights: DataFrame, eps: float, k: int, score: str | Score = "sum") -> DataFrame:
    """rank, lon, lat, score: the k best cells of a grid that starts at the least lon and lat; fewer if there are fewer."""
    aggregate = SCORES[score] if isinstance(score, str) else score
    e = F.lit(float(eps))
    corner = weights.agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"))
    own = weights.crossJoin(F.broadcast(corner))  # one row
    cells = own.groupBy(F.floor((F.col("lon") - F.col("x0")) / e).alias("i"), F.floor((F.col("lat") - F.col("y0")) / e).alias("j"), "x0", "y0").agg(aggregate(F.col("w")).alias("score"))
    centre = cells.select((F.col("i") * e + e / 2 + F.col("x0")).alias("lon"), (F.col("j") * e + e / 2 + F.col("y0")).alias("lat"), "score")
    return bounds.rank_all(centre.orderBy(F.desc("score"), "lon", "lat").limit(k)).select("rank", "lon", "lat", "score")


def merge_colocated(points: DataFrame, scale: float = 1e5) -> DataFrame:
    """Points that agree when scaled and rounded down are one: the number and weight of each place."""
    key = lambda c: F.floor(F.col(c) * F.lit(float(scale)))
    return points.groupBy(key("lon").alias("x"), key("lat").alias("y")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def distinct_locations(points: DataFrame) -> DataFrame:
    return points.select("lon", "lat").distinct().agg(F.count("*").alias("n_locations"))

