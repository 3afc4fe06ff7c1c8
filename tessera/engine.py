"""``top_regions``: from points and a query to ranked regions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.model import RegionQuery, absent
from tessera.operators import bounds, filters, scoring, selection


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write; a folder of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """``rows`` as a table in the shared folder, or a folder of it: computed once, without lineage."""
    path = f"{folder or shared_folder(rows.sparkSession)}/regions-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def selected(points: DataFrame, query: RegionQuery) -> DataFrame:
    """lon, lat, w of the points that pass the query's filters; w is a keyword where distinct ones are counted."""
    rows = filters.in_box(filters.located(points), query.bbox)
    if query.score != "distinct_keywords":
        rows = filters.with_keywords(rows, query.keywords_column, query.keywords)
        rows = filters.with_keywords(rows, query.keywords_column2, query.keywords2)
        return filters.weighted(rows, None if query.score == "count" else query.f)
    if not absent(query.keywords):  # without any, the column only names what is counted
        rows = filters.with_keywords(rows, query.keywords_column, query.keywords)
    rows = filters.with_keywords(rows, query.keywords_column2, query.keywords2)
    return filters.keyword_places(rows, query.keywords_column)


def blocks_for(weights: DataFrame, query: RegionQuery, n: int, written: Callable[[DataFrame], DataFrame] = written) -> selection.Blocks | None:
    """Blocks with the windows that may be among the results: those that reach the threshold, where no weight is negative. None without points."""
    distinct = query.score == "distinct_keywords"
    facts = weights.agg((F.min(F.lit(0.0)) if distinct else F.min("w")).alias("least")).first()
    if facts["least"] is None:
        return None
    theta, sums = float("-inf"), written(bounds.cell_sums(weights, query.eps, distinct))
    if facts["least"] >= 0:
        theta = bounds.threshold(sums, query.topk, query.dist).first()["theta"]
    return selection.Blocks(weights, sums, query.eps, theta, query.topk if query.dist else 1, n, distinct, written)


def top_regions(points: DataFrame, query: RegionQuery) -> DataFrame:
    """rank, lon, lat, score: the query's k best regions, fewer if there are fewer."""
    spark, name = points.sparkSession, model.strategy_name(query.algo)
    folder = f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"
    keep = lambda rows: written(rows, folder)
    weights = selected(points, query)
    if name == "uniform":
        return scoring.uniform_grid(weights, query.eps, query.topk, query.score)
    weights = keep(weights if query.score == "distinct_keywords" else filters.merged(weights))
    k, eps = query.topk, query.eps
    ahead = k if not query.dist or name == "approximate" else query.kprime if name == "multi_round" else 1
    found = blocks_for(weights, query, min(k, ahead), keep)
    if found is None:
        rows = []
    elif not query.dist:
        rows = found.free([], k)
    elif name == "hybrid":
        rows = selection.hybrid(found, k, eps, keep)
    elif name == "multi_round":
        rows = selection.multi_round(found, k, eps, query.kprime)
    elif name == "approximate":
        rows = selection.approximate(found, k, eps, query.sigma)
    else:
        rows = selection.single_round(found, k, eps)
    delete(spark, folder)
    return spark.createDataFrame([(n, lon, lat, score) for n, (score, lon, lat) in enumerate(rows, 1)], model.RESULT)


def best_region(points: DataFrame, eps: float, f: str | None = None) -> DataFrame:
    return top_regions(points, RegionQuery(topk=1, eps=eps, f=None if absent(f) else f, algo=1))
