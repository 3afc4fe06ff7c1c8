"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two (full
sequences first, then the binary digits of the rest, largest first).  A piece is
a sequence of its own and shares a length bucket with equal pieces, so no sequence
crosses documents and none needs padding.  The power stands in the lowest
bits of sequence_id, so a number names its bucket and pieces need no exchange.

Defined results: null text is the empty text, whose document is the separator
alone; a text of any length is cut whole; a null doc_id stays null; repeated rows are packed once each, so ties can't
arise; extra columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, pieces

#: The lowest bits of a sequence's number: its bucket's power.
BUCKET_BITS = 5
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids_le binary"


def decompose(n: int, longest: int) -> list[int]:
    """Piece lengths of ``n`` ids: all powers of two, at most ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack(docs: DataFrame, tokenizer: str, separator: int = 0, longest: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_le, sequence_id, offset, bucket.

    ``ids_le`` holds the ids, little-endian, 32 bits each.  ``longest`` is a power of two.
    ``bucket`` is the piece's length, 2 to the power of the lowest ``BUCKET_BITS`` bits of sequence_id; ``write_buckets`` stores sequences by it.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.library_encoder(tokenizer)
        for batch in common.slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(encoder.encode(text) + end)
                n, at = len(ids) // 4, 0
                for length in decompose(n, longest):
                    for column, value in zip(rows, (doc_id, at, length, n, ids[4 * at : 4 * (at + length)].tobytes()), strict=True):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids_le"])

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs)).mapInArrow(cut, SCHEMA)
    power = F.bit_count(F.col("length") - 1).cast("bigint")  # of a power of two
    number = F.shiftleft(F.monotonically_increasing_id(), BUCKET_BITS) + power
    return found.select("*", number.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences as Parquet, a folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """sequence_id, ids (exactly ``length`` of them) of one bucket; no other folder is read."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids_le").to_pylist()), "<i4")
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * length
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["sequence_id", "ids"])

    stored = spark.read.parquet(path).where(F.col("bucket") == length)
    return stored.select("sequence_id", "ids_le").mapInArrow(whole, "sequence_id bigint, ids array<int>")
