"""Stand-in points over the standard tables: id, lon, lat, keywords, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular points: the two first components of each vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.selectExpr(
        "vec_id AS id",
        "CAST(embedding[0] AS DOUBLE) AS lon",
        "CAST(embedding[1] AS DOUBLE) AS lat",
        "concat('L', CAST(label AS STRING), ';', 'P', CAST(vec_id % 3 AS STRING)) AS keywords",
        "CAST(label + 1 AS DOUBLE) AS score",
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered points on multiples of 1/1024."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.selectExpr(
        "event_id AS id",
        "CAST(user_id % 32 AS DOUBLE)*0.25D + CAST((event_id*7919) % 256 AS DOUBLE)/1024.0D AS lon",
        "CAST((user_id*7) % 32 AS DOUBLE)*0.25D + CAST((event_id*104729) % 256 AS DOUBLE)/1024.0D AS lat",
        "concat(event_type, ';', 'P', CAST(event_id % 3 AS STRING)) AS keywords",
        "CAST(floor(value*100 + 0.5D) AS DOUBLE) AS score",
    )


# The same views for DuckDB.
EMBEDDING_SQL = """SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat,
  concat('L', CAST(label AS VARCHAR), ';', 'P', CAST(vec_id % 3 AS VARCHAR)) AS keywords, CAST(label + 1 AS DOUBLE) AS score FROM embeddings"""
EVENT_SQL = """SELECT event_id AS id,
  CAST(user_id % 32 AS DOUBLE)*0.25 + CAST((event_id*7919) % 256 AS DOUBLE)/1024.0 AS lon,
  CAST((user_id*7) % 32 AS DOUBLE)*0.25 + CAST((event_id*104729) % 256 AS DOUBLE)/1024.0 AS lat,
  concat(event_type, ';', 'P', CAST(event_id % 3 AS VARCHAR)) AS keywords,
  CAST(floor(value*100 + 0.5) AS DOUBLE) AS score FROM events"""
