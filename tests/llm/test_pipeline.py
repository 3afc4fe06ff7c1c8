"""Every stage of the pipeline against brute force, on the rows its predecessor left."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

import public_tokenizers  # noqa: E402
from test_operators import brute_components, brute_repeats  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from tessera.llm import queries, secrets, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before each stage and after the last; each stage's rows are written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs.collect())
    return found


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_toxicity_drops_rows_only(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    chain = queries.toxicity_chain(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    ids = list(before)
    toxic = chain.score([before[i] for i in ids])[:, 1] >= toxicity.THRESHOLD
    assert set(before) - set(after) == {i for i, t in zip(ids, toxic, strict=True) if t}
    assert len(after) >= 0.8 * len(before)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == {i for i, _, c in brute_components(list(before.items())) if i == c}
    assert all(after[i] == before[i] for i in after)


def test_repeats_are_removed(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want = {i: (t if n == 0 else kept) for (i, _, n, kept), t in ((r, before[r[0]]) for r in brute_repeats(list(before.items())))}
    assert after == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_secrets_are_masked(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert after == {i: secrets.redacted(t) for i, t in before.items()}
    assert not any(secrets.base_spans(t) for t in after.values())


def test_packing_holds_every_id(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = {}
    for r in sorted(stages[5], key=lambda r: r["start"]):
        assert r["length"] & (r["length"] - 1) == 0
        packed[r["doc_id"]] = packed.get(r["doc_id"], b"") + bytes(r["ids_le"])
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in texts(stages[4]).items()}
    assert packed == want


def test_run_is_the_chain_of_stages(spark, stages):
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    digest = lambda rows: sorted((r["doc_id"], r["start"], hashlib.sha256(bytes(r["ids_le"])).hexdigest()) for r in rows)
    assert digest(rows) == digest(stages[5])
