"""Token counts by a separator scan over flat token files.

``write_flat`` stores ids, 16 bits each where the vocabulary allows it, with a separator after each document and
no index.  ``scan_blocks`` reads any byte ranges of such files, finds the separators with one vector comparison, and
gives each block's separator positions.  A prefix scan over the blocks of a file (last position and number of
separators so far) stitches documents that cross block borders.

Defined results: null text is the empty text, of no tokens; special tokens' strings in a text
are ordinary text, so only true separators count; a null doc_id stays null; repeated rows are
documents of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common, pieces

BLOCK_BYTES = 16 << 20
#: Tokens held before they are written.
WRITE_TOKENS = 2 << 20


def write_flat(docs: DataFrame, path: str, tokenizer: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """Writes a file for each partition under ``path``; returns the written table (file, ordinal, doc_id) of what they hold.

    A task writes to a name of its attempt and renames at its end, so a repeated task leaves one whole file.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        name = f"part-{context.partitionId():06d}.bin"
        trial = f"{root}/.{name}-{context.taskAttemptId()}"
        encoder, last = pieces.library_encoder(tokenizer, special_as_text=True), np.array([separator], "<u4").tobytes()
        ordinal = 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(trial) as out:
            for frame in frames:
                n, waiting = frame.num_rows, []
                for text in frame.column("text").to_pylist():
                    waiting += [encoder.encode(text), last]
                    if sum(map(len, waiting[-2:])) > 4 * WRITE_TOKENS or len(waiting) > 2000:
                        out.write(narrow(b"".join(waiting), dtype))
                        waiting = []
                out.write(narrow(b"".join(waiting), dtype))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), frame.column("doc_id")], names=["file", "ordinal", "doc_id"])
                ordinal += n
        if ordinal:
            store.move(trial, f"{root}/{name}")
        else:
            store.delete_file(trial)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs))
    return common.written(rows.mapInArrow(run, "file string, ordinal bigint, doc_id bigint"), "token-files")


def narrow(ids: bytes, dtype: str) -> bytes:
    values = np.frombuffer(ids, "<u4")
    if len(values) and values.max() > np.iinfo(dtype).max:
        raise ValueError(f"an id does not fit {dtype}")
    return values.astype(dtype).tobytes()


def blocks_of(spark: SparkSession, path: str, block_bytes: int, size: int) -> DataFrame:
    """file, block, at, bytes: every file's byte ranges. Only names and sizes are listed here."""
    store, root = fs.FileSystem.from_uri(path)
    found = [(f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".bin") and not f.base_name.startswith(".")]
    step = max(size, block_bytes // size * size)
    files = spark.createDataFrame(found or [("", 0)], "file string, bytes bigint").where("bytes > 0")
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / step)))
    cut = files.select("file", "bytes", block.alias("block")).select("file", "block", (F.col("block") * step).alias("at"), F.least(F.lit(step), F.col("bytes") - F.col("block") * step).alias("bytes"))
    return cut.repartition("file", "block")


def scan_blocks(blocks: DataFrame, path: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """file, block, n (separators), last (position of the last one, or null), ends: positions, counted in tokens from the file's start."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        size = np.dtype(dtype).itemsize
        for frame in frames:
            for file, block, at, length in zip(*(frame.column(c).to_pylist() for c in ("file", "block", "at", "bytes")), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    source.seek(at)
                    tokens = np.frombuffer(source.read(length), dtype)
                ends = np.flatnonzero(tokens == separator) + at // size
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "n", "last", "ends"])

    return blocks.mapInArrow(run, "file string, block bigint, n bigint, last bigint, ends array<bigint>")


def stitched(scanned: DataFrame) -> DataFrame:
    """file, ordinal, start, n_tokens of each document: a prefix scan over each file's blocks."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("from", F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)))
    rows = carried.where("n > 0").select("file", "base", "from", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("from")).otherwise(F.element_at("ends", F.greatest("k", F.lit(1))) + 1)
    return rows.select("file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def counts(docs: DataFrame, tokenizer: str, separator: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens: counts of all documents, from the files alone; doc_id by place in the file."""
    spark = docs.sparkSession
    path = common.new_path(spark, "tokens")
    names = write_flat(docs, path, tokenizer, separator, dtype)
    found = stitched(scan_blocks(blocks_of(spark, path, block_bytes, np.dtype(dtype).itemsize), path, separator, dtype))
    # both sides grow with the corpus: one plan at every size, no broadcast
    return names.join(found.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
