"""Exact top-k search by a Voronoi join.

Vectors are whole numbers, floor(64 * component).  The largest inner products with a
query are its nearest neighbours once every data vector x gets one more component
sqrt(M - |x|^2), with M the largest |x|^2, and every query a zero: the squared distance
is then |q|^2 + M - 2 q.x.  In that space:

1. Pivots, a bounded number of data vectors, cut data and queries into cells.
2. A summary of each cell (its radius, the smallest distances of its ids to the pivot, its size)
   bounds, for each cell of queries, the distance of the k-th neighbour of any query in it; the k-th
   neighbours that queries find in their own cell lower that bound.
3. Neighbouring cells of queries form groups of up to ``QUERY_BLOCK`` queries.  A data vector is replicated
   once to a group, and only if the triangle inequality allows it within the bound of one of its cells; so a vector has
   at most as many copies as there are groups and blocks of queries.  Groups and data meet in blocks of bounded size.
4. Blocks are solved by whole-number products; each block keeps k rows a query, which are merged.

Bounds are loosened by a relative slack, so rounding never drops a neighbour; scores are exact.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part, nor do null ids; vectors of different lengths meet as if padded with zeros; repeated
rows are candidates each, but a query's own id never is; a repeated query id is answered once,
by its first vector in order; ties go to the smaller id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Pivots; data vectors and queries of one block; smallest distances kept for each cell.
PIVOTS, DATA_BLOCK, QUERY_BLOCK = 24, 8192, 2048
SLACK = 1e-9
#: Products beyond this are not exact in double precision; Python integers take over.
EXACT = 2**53


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def scaled(vector: Column, factor: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("bigint"))


def norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def pad_flat(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, padded with zeros."""
    ends = np.asarray(column.offsets)
    sizes = np.diff(ends)
    values = np.asarray(column.values)[ends[0] : ends[-1]]
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v (whole numbers), n2 (squared length) of the rows that take part, as a written table."""
    v = F.col(vector_column)
    rows = table.where(usable(v) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), scaled(v).alias("v"))
    return common.written(rows.withColumn("n2", norm2(F.col("v"))), "knn-vectors")


def placed(rows: DataFrame, pivots: np.ndarray, top: float, is_query: bool) -> DataFrame:
    """Adds the nearest pivot's cell and the distance to it, in the extended space."""
    width = pivots.shape[1] - 1

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (pivots * pivots).sum(1)
        for frame in frames:
            x = pad_flat(frame.column("v"), width).astype(float)
            n2 = np.asarray(frame.column("n2"))
            last = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(top - n2, 0))
            own = n2 + last * last
            d2 = own[:, None] + lengths[None, :] - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[None, :, -1])
            cell = d2.argmin(1)
            d = np.sqrt(np.maximum(d2[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(cell.astype(np.int32)), pa.array(d)], names=[*frame.schema.names, "cell", "d"])

    return rows.mapInArrow(place, "id bigint, v array<bigint>, n2 double, cell int, d double")


def between(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0))


def summary_bounds(queries: pd.DataFrame, near: pd.DataFrame, pivots: np.ndarray, k: int) -> dict[int, float]:
    """For each cell of queries a distance within which all its queries have k neighbours, from summaries alone.

    ``queries``: a row for each cell with its largest distance to the pivot;
    ``near``: the smallest distances of k + 1 ids of each data cell (one id may be the query's own, with any number of rows).
    """
    apart, found = between(pivots), {}
    for i, radius in zip(queries["cell"], queries["far"], strict=True):
        # an id counts once, by its nearest row: whatever id asks, k others are within the bound
        reach = np.sort(pd.Series(radius + apart[i, near["cell"]] + near["d"].to_numpy()).groupby(near["id"].to_numpy()).min().to_numpy())
        found[int(i)] = float(reach[k]) if len(reach) > k else np.inf  # the k-th besides the query's own id
    return found


def groups(queries: pd.DataFrame, pivots: np.ndarray, most: int) -> dict[int, int]:
    """The group of each cell of queries: cells along a chain of nearest pivots share one while they hold ``most`` queries at most."""
    apart, size = between(pivots), dict(zip(queries["cell"].tolist(), queries["n"].tolist(), strict=True))
    found: dict[int, int] = {}
    left, at, group, held = set(size), min(size), 0, 0
    while left:
        at = min(left, key=lambda c: (apart[at, c], c))
        left.remove(at)
        if held and held + size[at] > most:
            group, held = group + 1, 0
        found[at] = group
        held += size[at]
    return found


def routes(data: pd.DataFrame, queries: pd.DataFrame, bounds: dict[int, float], of: dict[int, int], pivots: np.ndarray) -> list[tuple]:
    """(group of queries, cell of data, least and largest distance to the pivot) of what must be replicated.

    ``data``, ``queries``: a row for each cell with its largest distance to the pivot.  A group needs what one of its cells needs.
    """
    apart, found = between(pivots), {}
    for i, radius in zip(queries["cell"], queries["far"], strict=True):
        bound = bounds[i]
        for j, far in zip(data["cell"], data["far"], strict=True):
            slack = SLACK * (1 + far + radius + apart[i, j]) + 1e-3
            low, high = apart[i, j] - radius - bound - slack, min(apart[i, j] + radius + bound + slack, 1e300)
            if low <= far:
                key = (of[i], int(j))
                before = found.get(key, (low, high))
                found[key] = (float(min(low, before[0])), float(max(high, before[1])))
    return [(g, j, low, high) for (g, j), (low, high) in sorted(found.items())]


def top_rows(q_ids, q, x_ids, x, k: int) -> dict[str, np.ndarray]:
    """The k best rows of x for each row of q: larger product first, then smaller id; never its own id."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    if most < EXACT:
        scores = (q.astype(float) @ x.astype(float).T).astype(np.int64)
    else:
        scores = q.astype(object) @ x.astype(object).T
    out = ([], [], [])
    for r in range(len(q_ids)):
        s = scores[r]
        others = x_ids != q_ids[r]
        if most < EXACT and len(s) > 4 * k:
            kth = np.partition(np.where(others, s, np.iinfo(np.int64).min), len(s) - k)[len(s) - k]
            keep = np.flatnonzero((s >= kth) & others)
        else:
            keep = np.flatnonzero(others)
        best = keep[np.argsort(-s[keep], kind="stable")[:k]]
        out[0].append(np.full(len(best), q_ids[r]))
        out[1].append(x_ids[best])
        out[2].append(s[best])
    return {n: np.concatenate(c) if c else np.zeros(0, np.int64) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)}


def top_k(table: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best other rows.

    ``is_query``: a condition on the column ``id``.
    """
    spark = table.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = vectors(table, id_column, vector_column)
    facts = rows.agg(F.max("n2").alias("top"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    if not facts["n"]:
        common.discard(rows)
        return spark.createDataFrame([], result)
    top, width = facts["top"], facts["width"]
    first = Window.partitionBy("id").orderBy("v")
    asked = rows.where(is_query).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect()
    centres = padded([r["v"] for r in chosen], width).astype(float)
    centres = np.unique(np.concatenate([centres, np.sqrt(np.maximum(top - (centres * centres).sum(1), 0))[:, None]], 1), axis=0)

    data = common.written(placed(rows, centres, top, False), "knn-data")
    queries = common.written(placed(asked, centres, top, True), "knn-queries")
    per_cell = lambda df: df.groupBy("cell").agg(F.max("d").alias("far"), F.count("*").alias("n")).orderBy("cell").toPandas()
    nearest, cells, asked_cells = smallest(data, k + 1), per_cell(data), per_cell(queries)
    if not len(asked_cells):
        common.discard(rows, data, queries)
        return spark.createDataFrame([], result)
    size, own = ({int(c): int(n) for c, n in zip(t["cell"], t["n"], strict=True)} for t in (cells, asked_cells))

    def met(plan: list[tuple], of: dict[int, int]) -> DataFrame:
        """query_id, vec_id, score: k rows a query of each block, of what the plan brings to each group of query cells."""
        held, asking_in = {g: 0 for g in of.values()}, {g: 0 for g in of.values()}
        for g, j, _, _ in plan:
            held[g] += size.get(j, 0)
        for i, g in of.items():
            asking_in[g] += own[i]
        parts, blocks = ({g: max(1, -(-n // most)) for g, n in counts.items()} for counts, most in ((held, data_block), (asking_in, query_block)))
        # PIVOTS squared rows at most
        table_of = spark.createDataFrame([(g, j, low, high, parts[g], blocks[g]) for g, j, low, high in plan], "to int, cell int, low double, high double, parts int, blocks int")
        sent = data.join(F.broadcast(table_of), "cell").where((F.col("d") >= F.col("low")) & (F.col("d") <= F.col("high")))
        sent = sent.select("to", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
        sizes = spark.createDataFrame([(i, g, parts[g], blocks[g]) for i, g in of.items()], "cell int, to int, parts int, blocks int")
        asking = queries.join(F.broadcast(sizes), "cell")
        asking = asking.select("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int").alias("block"), "id", "v")

        def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return pd.DataFrame(top_rows(left["id"].to_numpy(), padded(list(left["v"]), width), right["id"].to_numpy(), padded(list(right["v"]), width), k))

        key = ["to", "part", "block"]
        return asking.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nth = lambda rows: rows.withColumn("rank", F.row_number().over(rank))
    bounds = summary_bounds(asked_cells, nearest, centres, k)
    # the k-th neighbour in a query's own cell is no nearer than its k-th of all
    alone = met([(i, i, 0.0, 1e300) for i in own if i in size], {i: i for i in own if i in size})
    kth = nth(alone).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("n2") + F.lit(float(top)) - 2 * F.col("kth").cast("double")))
    found = queries.join(kth, "id", "left").groupBy("cell").agg(F.max(reach).alias("reach"), F.count_if(F.col("kth").isNull()).alias("open"))
    for r in found.collect():  # a row for each cell
        if not r["open"]:
            bounds[r["cell"]] = min(bounds[r["cell"]], r["reach"])
    of = groups(asked_cells, centres, query_block)
    local = met(routes(cells, asked_cells, bounds, of, centres), of)
    answer = common.written(nth(local).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "knn-result")
    common.discard(rows, data, queries)
    return answer


def smallest(data: DataFrame, count: int) -> pd.DataFrame:
    """cell, id, d: the ``count`` ids of each cell with the smallest distances, each with its least, found a partition at a time first."""

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"cell": pd.Series(dtype="int32"), "id": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})
        for frame in frames:
            kept = pd.concat([kept, frame]).sort_values("d", kind="stable").drop_duplicates(["cell", "id"]).groupby("cell").head(count)
        yield kept

    local = data.select("cell", "id", "d").mapInPandas(least, "cell int, id bigint, d double")
    order = Window.partitionBy("cell").orderBy("d", "id")
    each = local.groupBy("cell", "id").agg(F.min("d").alias("d"))
    return each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= count).select("cell", "id", "d").toPandas()
