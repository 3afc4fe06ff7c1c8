"""Nearest neighbours where one id holds many rows."""

import random

import pytest

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F  # noqa: E402
from test_operators import brute_knn  # noqa: E402

from tessera.llm import knn  # noqa: E402


def found(spark, rows, k, **sizes):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = {}
    for r in sorted(knn.top_k(table, F.col("id") % 20 == 0, k=k, **sizes).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_own_id_with_more_rows_than_k(spark):
    rows = [(20, [8.0, 0.0])] * 25 + [(j, [-1.0, 0.25 * j]) for j in range(1, 6)]
    got = found(spark, rows, 20)
    assert len(got[20]) == 5 and got == brute_knn(rows, 20, lambda i: i % 20 == 0)


def test_many_rows_of_few_ids(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        centre = [rng.uniform(-4, 4) for _ in range(3)]
        rows += [(i, [c + rng.choice([0.0, 0.0, 0.5]) for c in centre]) for _ in range(30 if i % 20 == 0 else rng.randrange(1, 4))]
    assert found(spark, rows, 6, pivots=8, data_block=16, query_block=3) == brute_knn(rows, 6, lambda i: i % 20 == 0)
