"""What workers and the buffers beside them hold: few bytes a batch, and no memo that nothing asks any more."""

import pytest

pytest.importorskip("tessera.llm")

import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import common, pieces, token_orc  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
ROWS, LETTERS = 3000, 8000
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_long_rows_reach_workers_in_small_batches(spark):
    def sizes(frames):
        for frame in frames:
            yield pa.RecordBatch.from_arrays([pa.array([frame.num_rows]), pa.array([frame.nbytes])], names=["n", "size"])

    before = spark.conf.get(BYTES)
    rows = spark.range(0, ROWS, 1, 1).select(F.repeat(F.lit("x"), LETTERS).alias("text"))
    found = common.written(rows.mapInArrow(sizes, "n bigint, size bigint"), "sizes").collect()
    assert sum(r["n"] for r in found) == ROWS
    assert max(r["size"] for r in found) < 8 << 20 < ROWS * LETTERS
    assert spark.conf.get(BYTES) == before


def test_reading_tokens_lets_go_of_the_encoder():
    pieces.library_encoder(WORD).encode("some words")
    assert pieces.library_encoder.cache_info().currsize
    assert list(token_orc.digests(iter([]))) == []
    assert pieces.library_encoder.cache_info().currsize == 0
