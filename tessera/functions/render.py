"""Results as JSON, GeoJSON, WKT and text."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import square_wkt

#: What an empty result is printed as.
EMPTY = "[\n{\n}\n]"


def region_id(lon: str = "lon", lat: str = "lat") -> Column:
    return F.concat_ws(":", F.col(lon).cast("string"), F.col(lat).cast("string"))


def square(eps: float) -> Column:
    half = F.lit(float(eps) / 2)
    return square_wkt(F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half)


def with_wkt(regions: DataFrame, eps: float) -> DataFrame:
    """id, wkt, score of each region."""
    return regions.select("rank", region_id().alias("id"), square(eps).alias("wkt"), "score")


def text_lines(regions: DataFrame, eps: float, separator: str = ";") -> DataFrame:
    """id, polygon and score in a line."""
    return with_wkt(regions, eps).select(F.concat_ws(separator, "id", "wkt", F.col("score").cast("string")).alias("value"))


def rank_lines(regions: DataFrame) -> DataFrame:
    return regions.select(F.concat(F.col("rank").cast("string"), F.lit(":"), region_id(), F.lit("     "), F.col("score").cast("string")).alias("value"))


def geojson_features(regions: DataFrame) -> DataFrame:
    """rank, feature: a GeoJSON point for each region."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct(F.col("rank").cast("string").alias("id"), F.col("score").alias("score"))
    return regions.select("rank", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def result_json(regions: DataFrame, whole_scores: bool = False) -> str:
    """The k regions (few rows) as a JSON array of rank, center and score."""
    rows = [{"rank": r["rank"], "center": [r["lon"], r["lat"]], "score": int(r["score"]) if whole_scores else r["score"]} for r in regions.orderBy("rank").collect()]
    return json.dumps(rows) if rows else EMPTY


def geojson(regions: DataFrame) -> str:
    features = [json.loads(r["feature"]) for r in geojson_features(regions).orderBy("rank").collect()]
    return json.dumps({"type": "FeatureCollection", "features": features})


def write_delimited(regions: DataFrame, path: str, eps: float, separator: str = ";") -> None:
    """id, polygon, score as delimited files."""
    with_wkt(regions, eps).select("id", "wkt", "score").write.option("sep", separator).csv(path)


def total_score(regions: DataFrame) -> DataFrame:
    return regions.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total_score"))


def replace_file(path: str, text: str) -> None:
    """Write a file so that readers see the old or the new one."""
    with open(path + ".new", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(path + ".new", path)
