"""Media columns: texts as lossless progressive JPEG payloads, read back with features.

Defined results: null text is the empty text, whose payload is 64 zero bytes; a null
doc_id stays null; repeated rows are stored once each with equal values; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, jpeg

#: Blocks of one batch of files; a larger file is a batch of its own.
BATCH_BLOCKS = 16_384


def payload(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)


def batches_of(payloads: list[bytes]) -> Iterator[list[int]]:
    own, blocks = [], 0
    for i, p in enumerate(payloads):
        if own and blocks + len(p) // 64 > BATCH_BLOCKS:
            yield own
            own, blocks = [], 0
        own.append(i)
        blocks += len(p) // 64
    if own:
        yield own


def feature(rgb: np.ndarray) -> str:
    """Size, sum of each channel, and checksum of the tensor."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(rgb):08x}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the file), payload (read back from it), feature: one row per document."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("text").to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            payloads = [payload(t) for t in texts]
            del texts
            for own in batches_of(payloads):
                files = jpeg.payload_jpegs([payloads[i] for i in own])
                read = jpeg.Decoded(files)
                back = [read.payload(j)[: len(payloads[i])] for j, i in enumerate(own)]
                features = [feature(read.rgb(j)) for j in range(len(own))]
                yield pa.RecordBatch.from_arrays(
                    [frame.column("doc_id").take(pa.array(own)), pa.array([sizes[i] for i in own], pa.int64()), pa.array(files, pa.binary()), pa.array(back, pa.binary()), pa.array(features)],
                    names=["doc_id", "n_bytes", "media", "payload", "feature"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string")


def tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, height, width, rgb (row-major bytes) of progressive JPEG files; null files give nulls."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for doc_id, file in zip(frame.column("doc_id").to_pylist(), frame.column("file").to_pylist(), strict=True):
                rgb = jpeg.Decoded([file]).rgb(0) if file is not None else None
                height, width = rgb.shape[:2] if rgb is not None else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([rgb.tobytes() if rgb is not None else None], pa.binary())], names=["doc_id", "height", "width", "rgb"])

    return media.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).alias("file")).mapInArrow(run, "doc_id bigint, height int, width int, rgb binary")
