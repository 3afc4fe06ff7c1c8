"""The registered queries on the smallest tables against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("tessera.llm")

import public_tokenizers  # noqa: E402
from test_operators import brute_components, brute_knn, brute_repeats  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import __spark_entry__  # noqa: E402
from tessera.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def rows(spark, number):
    name = next(n for n in __spark_entry__.queries() if n.startswith(f"op{number}_"))
    return __spark_entry__.queries()[name](spark, SF).collect()


def encoded(file):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in DOCS.items()}


def le(ids):
    return np.array(ids, "<u4").tobytes()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    want = brute_knn(vectors, 20, lambda i: i % 20 == 0)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(spark, 1)}
    assert got == {(i, n): v for i, found in want.items() for n, v in enumerate(found, 1)}


def test_op2(spark):
    ids, there = {i: [*x, 0] for i, x in encoded("byte_bpe_50k.json").items()}, {i: 0 for i in DOCS}
    found = sorted(rows(spark, 2), key=lambda r: (r["doc_id"], r["start"]))
    for r in found:
        own = ids[r["doc_id"]]
        assert r["start"] == there[r["doc_id"]] and r["doc_tokens"] == len(own) and r["length"] <= 1024
        assert r["ids_crc32"] == zlib.crc32(le(own[r["start"] : r["start"] + r["length"]]))
        there[r["doc_id"]] += r["length"]
    assert there == {i: len(x) for i, x in ids.items()}
    assert len({r["sequence_id"] for r in found}) == len(found) and all(r["offset"] == 0 for r in found)


def test_op3(spark):
    assert {r["doc_id"]: r["n_tokens"] for r in rows(spark, 3)} == {i: len(x) for i, x in encoded("byte_bpe_50k.json").items()}


def test_op4(spark):
    kinds = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))
    for r in rows(spark, 4):
        spans = []
        for k, (kind, pattern) in enumerate(kinds):
            own = [m for m in re.finditer(pattern, DOCS[r["doc_id"]], re.A) if (len(m[2]) >= 8 if k == 0 else len(m[0]) >= (16 if k == 1 else 32))]
            assert r[f"n_{kind}"] == len(own)
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in own]
        base = [s[2] for s in sorted(spans)]
        assert r["base_sha256"] == sha(",".join(base).encode())
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def test_op5(spark):
    """The smallest table has few labels: what is flagged must be toxic by label or hold an insult seen in one."""
    found = {r["doc_id"]: r for r in rows(spark, 5)}
    assert set(found) == set(DOCS)
    toxic = {r["doc_id"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["toxic"] == 1}
    flagged = {i for i, r in found.items() if r["toxic"]}
    assert flagged == {i for i, r in found.items() if r["p_toxic"] >= toxicity.THRESHOLD}
    assert len(flagged & toxic) >= len(toxic) / 2 and len(flagged - toxic) <= 0.05 * len(DOCS)


def test_op6(spark):
    want = {i: (n, gone, sha(kept.encode())) for i, n, gone, kept in brute_repeats(list(DOCS.items()))}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, 6)} == want


def test_op7(spark):
    want = {i: (len(x), sha(le(x)), sha(DOCS[i].encode())) for i, x in encoded("byte_bpe_50k.json").items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, 7)} == want


def test_op8(spark):
    got = rows(spark, 8)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(list(DOCS.items()))


def test_op9(spark):
    want, at = {}, 0
    for i, ids in sorted(encoded("word_bpe_49k.json").items()):
        want[i] = (at, len(ids) + 1, zlib.crc32(le([*ids, 2])))
        at += len(ids) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, 9)} == want


def test_op10(spark):
    for r in rows(spark, 10):
        data = DOCS[r["doc_id"]].encode()
        payload = data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), sha(payload))
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] > 0
