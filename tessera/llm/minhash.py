"""Near-duplicate documents by min-max hashing, with exact confirmation.

A document is the set of its distinct word shingles.  For each of ``BANDED``
permutations both the smallest and the largest value are kept, so half the
evaluations give a full signature.  Bands of four values make buckets; with 44 bands a
pair of similarity 0.75 shares no bucket with a probability of 6e-8.

Documents of equal sets are one node.  Links are confirmed on full sets, and only
as many as decide the components: first each bucket's members against the bucket's
smallest and largest node (stars, linear in the bucket), then, where a bucket still holds
several components, members outside its largest component against the others, in blocks.  For these
nodes alone longer signatures are made, from ``HASHES`` permutations: a sketch keeps two bits of each of
their 2,048 values, and its estimates have a standard error of 0.0115.  A first pass takes each node's
likeliest partner, a second, with the components that this left, all pairs that the sketches hold for similar
(a similarity of 0.75 is estimated under ``LEAST_ESTIMATE`` with a probability under 1e-6).
No list of pairs within a bucket is formed.

Defined results: null text and text without words have an empty set and stay alone; fewer
words than a shingle are one shingle; a text of any length is taken whole; rows of one doc_id are one document whose
links are those of its rows; null doc_ids have no links and null components; ties cannot
arise, a component's id is its smallest doc_id; extra columns of any name are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, components, pieces
from tessera.llm import words as W

SHINGLE, PERCENT = 5, 75
#: Permutations of the bands (so 2 * BANDED / ROWS bands of ROWS values) and of the sketches.
BANDED, ROWS, HASHES = 88, 4, 1024
LEAST_ESTIMATE = 0.6925
#: Members of a bucket that are compared with as many others in one step.
BLOCK = 1024
#: Shingles hashed in one step: the products stay in the cache. Documents described in one step.
_STEP, _DOCS = 256, 256
_SEEDS = np.random.default_rng(88).integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(89).integers(1, 2**63, (2 * BANDED // ROWS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """Minimum and maximum of the set under each of the first ``hashes`` permutations, a pair for each."""
    low, high, seeds = np.full(hashes, 2**64 - 1, np.uint64), np.zeros(hashes, np.uint64), _SEEDS[None, :hashes]
    step = _STEP * max(1, HASHES // hashes // 4)
    for at in range(0, len(shingles), step):
        value = shingles[at : at + step, None] * seeds
        np.minimum(low, value.min(0), out=low)
        np.maximum(high, value.max(0), out=high)
    return np.stack([low, high], 1)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    return np.stack([signature(s, hashes) for s in sets]) if sets else np.zeros((0, hashes, 2), np.uint64)


def bands(signed: np.ndarray) -> np.ndarray:
    """A bucket's key for each band of each signature, ascending in the band; a band has minima or maxima only."""
    parts = W.mix(signed[:, :BANDED]).swapaxes(1, 2).reshape(len(signed), -1, ROWS)
    return W.mix((parts * _BAND[None]).sum(2) + np.arange(parts.shape[1], dtype=np.uint64)[None, :])


def sketches(signed: np.ndarray) -> np.ndarray:
    """Two bits of each value, four values a byte."""
    two = (W.mix(signed) >> np.uint64(62)).astype(np.uint8).reshape(len(signed), -1, 4)
    return two[:, :, 0] << 6 | two[:, :, 1] << 4 | two[:, :, 2] << 2 | two[:, :, 3]


#: For each byte, how many of its four values are zero.
_ALIKE = np.array([sum(b >> shift & 3 == 0 for shift in (0, 2, 4, 6)) for b in range(256)], np.uint8)
#: Values that must agree: by chance a quarter of those that differ do.
_LEAST_ALIKE = 2 * HASHES * (0.25 + 0.75 * LEAST_ESTIMATE)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix of whole numbers as an Arrow column of its rows."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.view(np.int64).reshape(-1)))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, the set's key (k1, k2) and its buckets; a written table."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()  # the worker may have packed another corpus
        for frame in common.slices(frames, _DOCS):
            sets = W.shingle_sets(frame.column("text").to_pylist(), SHINGLE)
            keys = np.array([[W.mix(s).sum(), W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()] for s in sets], np.uint64).reshape(-1, 2).astype(np.int64)
            buckets = _lists(bands(signatures(sets, BANDED)))
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), buckets], names=["doc_id", "n", "k1", "k2", "buckets"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs))
    return common.written(rows.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, buckets array<bigint>"), "minhash")


def sketched(held: DataFrame, texts: DataFrame) -> DataFrame:
    """node, n, buckets, sketch of the nodes of ``held``, from their texts; a written table."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in common.slices(frames, _DOCS):
            sets = W.shingle_sets(frame.column("text").to_pylist(), SHINGLE)
            signed = signatures(sets, HASHES)
            sketch = pa.array([row.tobytes() for row in sketches(signed)], pa.binary())
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _lists(bands(signed)), sketch], names=["node", "n", "buckets", "sketch"])

    wanted = held.select(F.col("node").alias("doc_id")).distinct()
    rows = texts.join(wanted.hint("merge"), "doc_id", "left_semi")
    return common.written(rows.mapInArrow(run, "node bigint, n bigint, buckets array<bigint>, sketch binary").where("n > 0"), "minhash-sketches")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text of the nodes that share a bucket, read from the documents once; a written table."""
    wanted = nodes.select(F.col("node").alias("doc_id")).distinct()
    # both sides grow with the corpus: one plan at every size
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    return common.written(rows, "minhash-texts")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), written, those whose full sets are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for frame in common.slices(frames, _DOCS):
            a, b, text_a, text_b = (frame.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            sets_a = W.shingle_sets(text_a, SHINGLE)
            fresh = [i for i in range(len(b)) if text_b[i] != (text_b[i - 1] if i else last[0])]
            sets_b = dict(zip(fresh, W.shingle_sets([text_b[i] for i in fresh], SHINGLE), strict=True))
            keep = []
            for i, own in enumerate(sets_a):
                if i in sets_b:
                    last = (text_b[i], sets_b[i])
                both = len(np.intersect1d(own, last[1], assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(own) + len(last[1]) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return common.written(rows.mapInArrow(check, "a bigint, b bigint").distinct(), "minhash-links")


def members(nodes: DataFrame) -> DataFrame:
    """key, node, low, high (the bucket's smallest and largest node), size of every bucket with two nodes at least; a written table."""
    rows = nodes.select("node", F.explode("buckets").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low < high")
    # both sides grow with the corpus: one plan at every size
    return common.written(rows.join(shared.hint("merge"), "key"), "minhash-buckets")


def undecided(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, component, top (the bucket's largest component), blocks inside and outside it, of buckets that hold several; a written table.

    Buckets of two nodes are decided: their pair is a star.
    """
    rows = buckets.where("size > 2").select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    shared = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts"), F.sum("c").alias("size")).where("parts > 1")
    in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shared = shared.select("key", F.col("top.component").alias("top"), in_blocks(F.col("size")).alias("blocks"), in_blocks(F.col("size") - F.col("top.c")).alias("outside"))
    return common.written(rows.join(shared, "key"), "minhash-rest")


def likely(held: DataFrame, sketch: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of different components, in an undecided bucket, that the sketches hold for similar; a written table.

    Members outside the largest component are asked about all: blocks of them meet blocks of all members.
    best: of each asked member only the pair with the best estimate in a block.
    """
    rows = held.join(sketch, "node")
    dealt = lambda seed, of: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asked = rows.where("component <> top").withColumn("one", dealt(1, "outside")).withColumn("other", each("blocks")).withColumn("side", F.lit(0))
    given = rows.withColumn("other", dealt(2, "blocks")).withColumn("one", each("outside")).withColumn("side", F.lit(1))
    columns = ["key", "one", "other", "side", "node", "n", "component", "sketch", "buckets"]
    both = asked.select(columns).unionByName(given.select(columns)).repartition("key", "one", "other").sortWithinPartitions("key", "one", "other", "side")
    return common.written(both.mapInArrow(lambda frames: _alike(frames, best), "a bigint, b bigint").distinct(), "minhash-pairs")


def _alike(frames: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Within each block: asked rows (side 0) against the others as they come.

    A pair that shares several buckets is compared in the first of them only.
    """
    group, asked = None, None

    def matched(own: pd.DataFrame, given: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(own["sketch"]), np.uint8).reshape(len(own), -1)
        y = np.frombuffer(b"".join(given["sketch"]), np.uint8).reshape(len(given), -1)
        x_keys, y_keys = (np.stack(d["buckets"]) for d in (own, given))
        band = int(np.flatnonzero(x_keys[0] == own["key"].iat[0])[0])
        x_keys, y_keys = x_keys[:, :band], y_keys[:, :band]
        for i in range(len(own)):
            node, n, part = own["node"].iat[i], own["n"].iat[i], own["component"].iat[i]
            sizes = given["n"].to_numpy()
            able = np.flatnonzero((given["component"].to_numpy() != part) & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * PERCENT))
            able = able[~(y_keys[able] == x_keys[i]).any(1)]
            if len(able):
                same = _ALIKE[y[able] ^ x[i]].sum(1, dtype=np.int64)
                if best:
                    same[np.arange(len(same)) != same.argmax()] = 0
                alike = able[same >= _LEAST_ALIKE]
                other = given["node"].to_numpy()[alike]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(other, node)), pa.array(np.minimum(other, node))], names=["a", "b"])

    for frame in frames:
        rows = frame.to_pandas()
        change = (rows[["key", "one", "other"]] != rows[["key", "one", "other"]].shift()).any(axis=1)
        for _, part in rows.groupby(change.cumsum(), sort=False):
            here = (part["key"].iat[0], part["one"].iat[0], part["other"].iat[0])
            first, given = part[part["side"] == 0], part[part["side"] == 1]
            if here != group:
                group, asked = here, first
            elif len(first):
                asked = pd.concat([asked, first])
            if len(given) and len(asked):
                yield from matched(asked, given)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document; a written table."""
    table = described(docs)
    ids = common.written(table.select("doc_id", "n", "k1", "k2"), "minhash-ids")
    # equal sets: one node, named by its smallest doc_id; their buckets are the same
    sets = table.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"))
    nodes = common.written(sets, "minhash-nodes")
    common.discard(table)
    buckets, names = members(nodes), common.written(nodes.select("k1", "k2", "n", "node"), "minhash-names")
    common.discard(nodes)
    star = buckets.select("node", F.explode(F.array("low", "high")).alias("end")).where("node <> end")
    star = common.written(star.select(F.greatest("node", "end").alias("a"), F.least("node", "end").alias("b")).distinct(), "minhash-stars")
    texts = texts_of(docs, buckets)
    links = confirmed(star, texts)
    # several rows of one doc_id may be in several sets: they are one document
    same = ids.where("n > 0 and doc_id is not null").join(names, ["k1", "k2", "n"]).select("doc_id", "node")
    several = same.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    joined = same.join(several, "doc_id").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = components.components(links.unionByName(joined))
    tested, done, sketch = star, [links, star], None
    for best in (True, False):  # the likeliest pairs first: what they join needs no further comparison
        held = undecided(buckets, found)
        sketch = sketch or sketched(held, texts)  # components only grow: the second pass asks about nodes of the first
        others = likely(held, sketch, best)
        more = confirmed(others.join(tested, ["a", "b"], "left_anti"), texts)
        if not more.isEmpty():
            last, found = found, components.components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
            common.discard(last)
        common.discard(held)
        tested = tested.unionByName(others)
        done += [others, more]
    common.discard(buckets, texts, sketch, *done)
    of_set = names.join(found, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("c"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id")).alias("component_id")
    rows = ids.join(of_set, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component)
    result = common.written(rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "minhash-result")
    common.discard(ids, names, found)
    return result
