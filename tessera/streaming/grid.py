"""Running grid sums over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import hash_cells


def cell_sums(points: DataFrame, eps: float, f: str | None = None) -> DataFrame:
    """i, j, s, n of a streaming (or plain) table of points; for output modes complete and update."""
    weight = F.col(f).cast("double") if f else F.lit(1.0)
    rows = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("w", weight).where(F.col("w").isNotNull())
    return hash_cells(rows, eps).groupBy("i", "j").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
