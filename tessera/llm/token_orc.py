"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on doc_id.

Texts are dealt to ranges of doc_id and sorted within each; a task encodes its range
and writes it in that order, so ids themselves are never shuffled.  Ranges come from a sample, so they
only balance files; the order is exact.  Readers take stripes in parallel and skip
stripes and row groups by min, max and Bloom filter of doc_id.

Defined results: null text is the empty text (the end id alone); a text of any length is one row; null doc_ids come
first; rows of one doc_id are ordered by text, and repeated rows are stored once each; extra columns of any name are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common, pieces

#: Documents of one range, and the most ranges; beyond, ranges grow and Spark's sort spills.
ROWS_A_RANGE, MOST_RANGES = 8192, 65536
#: part: the range's number; row: the document's place in it.
SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, part int, row bigint"


def ended(ids: pa.ListArray, end_id: int) -> pa.ListArray:
    """The lists, each with ``end_id`` behind it."""
    ends = np.asarray(ids.offsets)
    values = np.insert(np.asarray(ids.values), ends[1:], end_id)
    return pa.ListArray.from_arrays(pa.array(ends + np.arange(len(ends), dtype=np.int32)), pa.array(values))


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Stored rows of a range's doc_id, text and part, in order. Batches are taken whole: the more texts, the fewer distinct words for each."""
    encoder, row = pieces.library_encoder(tokenizer), 0
    for batch in batches:
        ids = ended(encoder.encode_column(batch.column("text")), end_id)
        place = pa.array(np.arange(row, row + len(ids)))
        row += len(ids)
        rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), ids.value_lengths().cast(pa.int64()), ids, batch.column("part"), place], names=["doc_id", "n_tokens", "ids", "part", "row"])
        yield from common.slices(iter([rows]))  # the JVM holds the ids of so many rows only


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20, index_rows: int = 1000) -> None:
    """Encode all texts and write them as ORC under ``path``, a file or more for each range of doc_id."""
    parts = max(1, min(MOST_RANGES, -(-docs.select("doc_id").count() // ROWS_A_RANGE)))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs))
    ranges = docs.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_rows), "orc.create.index": "true", "compression": "zstd"}
    rows = ranges.withColumn("part", F.spark_partition_id()).mapInArrow(lambda batches: encoded(batches, tokenizer, end_id), SCHEMA)
    with common.small_batches(docs.sparkSession):
        rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, row, n_tokens, ids_crc32 of stored rows."""
    pieces.forget()  # the worker may have written them
    for batch in common.slices(batches):
        ids = batch.column("ids")
        ends, values = np.asarray(ids.offsets), np.asarray(ids.values).astype("<i4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Starts are sums within a range plus the totals of the ranges before it.
    """

    stored = read_tokens(spark, path).select("doc_id", "part", "row", "ids")
    # a few numbers a document: ids are read once, in small batches whatever the caller's session says
    rows = common.written(stored.mapInArrow(digests, "doc_id bigint, part int, row bigint, n_tokens bigint, ids_crc32 bigint"), "token-digests")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    # base has one row per range, MOST_RANGES at most
    return rows.join(F.broadcast(base), F.col("part") == F.col("of")).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
