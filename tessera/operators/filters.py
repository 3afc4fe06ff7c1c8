"""Filters and projections; all are column expressions, so they reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import absent


def located(points: DataFrame) -> DataFrame:
    """Points with both coordinates; null and NaN are none."""
    return points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan(F.col("lon").cast("double")) & ~F.isnan(F.col("lat").cast("double")))


def with_keywords(points: DataFrame, column: str | None, keywords: str | None, separator: str = ";", casefold: bool = False) -> DataFrame:
    """Points that have one of the keywords; unused if the column is absent."""
    if absent(column):
        return points
    pattern = re.escape(separator)  # the separator is meant as it stands, on both sides
    have, wanted = F.split(F.col(column), pattern), (keywords or "").split(separator)
    if casefold:
        have = F.transform(F.split(F.lower(F.col(column)), pattern), lambda k: F.trim(k))
        wanted = [k.strip().lower() for k in wanted]
    return points.where(F.arrays_overlap(have, F.array(*map(F.lit, wanted))))


def in_box(points: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """bbox: least lon, least lat, largest lon, largest lat; borders belong to it."""
    if bbox is None:
        return points
    west, south, east, north = map(float, bbox)
    return points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def weighted(points: DataFrame, f: str | None = None) -> DataFrame:
    """lon, lat, w: weight 1, or the column ``f`` as a double; rows without it are left out."""
    if absent(f):
        return points.select("lon", "lat", F.lit(1.0).alias("w"))
    return points.where(F.col(f).isNotNull()).select("lon", "lat", F.col(f).cast("double").alias("w"))


def keyword_places(points: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """lon, lat, w: each place's distinct keywords, one row for each; empty ones and null are none."""
    words = F.explode(F.split(F.col(column), re.escape(separator)))
    return points.select("lon", "lat", words.alias("w")).where(F.col("w") != "").distinct()


def merged(weights: DataFrame) -> DataFrame:
    """One row for each place, with its whole weight: no loss, and hot places shrink before any exchange."""
    return weights.groupBy("lon", "lat").agg(F.sum("w").alias("w"))
