"""Reading points: CSV, Parquet, JDBC, positional text, and reused extracts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import absent


def read_csv(spark: SparkSession, path: str, numeric: tuple[str, ...] = ("lon", "lat"), delimiter: str = ",") -> DataFrame:
    """A CSV file with a header; the numeric columns are doubles, all others stay strings (so 10.10 stays a keyword)."""
    raw = spark.read.option("header", True).option("sep", delimiter).option("nullValue", "null").csv(path)
    return raw.select(*(F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in raw.columns))


def identifier(name: str) -> str:
    """A quoted SQL name of plain characters, parts separated by dots."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)*", name or ""):
        raise ValueError(f"not a plain name: {name!r}")
    return ".".join(f'"{part}"' for part in name.split("."))


def fetch_sql(table: str, columns: list[str | None]) -> str:
    """The query sent to a database: used columns only, rows with both coordinates."""
    wanted = ["lat", "lon", *dict.fromkeys(c for c in columns if not absent(c))]
    return f"select {', '.join(identifier(c) for c in wanted)} from {identifier(table)} where \"lat\" is not null and \"lon\" is not null"


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str | None], user: str = "", password: str = "", **options: str) -> DataFrame:
    """The columns of a database table; filter and projection run in the database."""
    reader = spark.read.format("jdbc").option("url", url).option("query", fetch_sql(table, columns))
    for k, v in {"user": user, "password": password, **options}.items():
        if v:
            reader = reader.option(k, v)
    return reader.load()


def extract_name(table: str, columns: list[str | None]) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "_", "-".join([table, *(c for c in columns if not absent(c))]))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached_extract(spark: SparkSession, folder: str, table: str, columns: list[str | None], fetch) -> DataFrame:
    """The extract of a table as Parquet; ``fetch()`` is called only where it isn't there yet."""
    path = f"{folder}/{extract_name(table, columns)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        fetch().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_positions(spark: SparkSession, path: str, lon: int | None, lat: int | None, id: int | None = None, name: int | None = None, keywords: int | None = None, score: int | None = None, csv_delimiter: str = ",", keyword_delimiter: str = ";", wanted: str | None = None) -> DataFrame:
    """Points from delimited text without a header, by 1-based column numbers; malformed lines are skipped.

    Missing columns: id a running number, name empty, score 1, keywords null.  ``wanted`` keeps points
    that have one of its keywords, trimmed and in any case.
    """
    if lon is None or lat is None:
        raise ValueError("the columns of lon and lat are needed")
    parts = F.split(F.col("value"), re.escape(csv_delimiter), -1)
    at = lambda i: F.trim(F.get("parts", F.lit(i - 1)))
    number = lambda i: F.expr(f"try_cast(trim(get(parts, {i - 1})) as double)")
    rows = spark.read.text(path).withColumn("parts", parts).where(F.length("value") > 0)
    rows = rows.withColumns({"lon": number(lon), "lat": number(lat), "score": number(score) if score else F.lit(1.0), "keywords": at(keywords) if keywords else F.lit(None).cast("string")})
    rows = rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("score").isNotNull())
    if not absent(wanted):
        have = F.transform(F.split(F.lower("keywords"), re.escape(keyword_delimiter)), lambda k: F.trim(k))
        rows = rows.where(F.arrays_overlap(have, F.array(*(F.lit(k.strip().lower()) for k in wanted.split(keyword_delimiter)))))
    own_id: Column = at(id) if id else F.monotonically_increasing_id().cast("string")
    return rows.select(own_id.alias("id"), (at(name) if name else F.lit("")).alias("name"), "lon", "lat", "keywords", "score")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Cached results, a JSON object in each line."""
    return spark.read.schema("key string, out string, error string").json(path)
