"""Removal of passages that repeat across documents, by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words.  A word goes if a window over it also starts in a
document with a smaller doc_id.  All windows of a corpus can't be compared in one automaton, so
content deals them to shards first: every window has an anchor, the smallest hash among its
``GRAM``-word runs, and equal windows have equal anchors.  Neighbouring windows with the same
anchor occurrence form a context.  Anchors of one document only need nothing further.  The others are
reference shards: each distinct context, with the smallest doc_id that has it, is a reference.
References are added to a suffix automaton in order of doc_id, so each state knows the smallest document
that holds its words; contexts are streamed through it, and where the matching statistic reaches
``WINDOW`` the state names the smallest document with that window.

A shard's references are dealt over automata of at most about ``PART`` contexts, and its contexts are streamed
through each of these, so a task holds one automaton of bounded size however large a shard is.  The automata are built where their
part of a shard is; they are not broadcast, because the reference is the corpus itself and has no size bound.

Defined results: words are cut at ASCII white space only; null text has no words; documents of
fewer words than a window keep all; a text of any length is taken whole; rows of one doc_id count as one document, and each
is cleaned; rows with a null doc_id are neither references nor cleaned; of equal windows the smallest doc_id's stays, so ties can't arise;
extra columns of any name stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common
from tessera.llm import words as W

WINDOW, GRAM = 50, 8
#: References of one automaton, which so stays under 60 MB.
PART = 1024
#: Owners are numbered from the smallest doc_id there can be, so that -1 is none.
LEAST_ID = -(2**63)
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_WORD_BASE = np.uint64(0xD1B54A32D192ED03)
_WORD_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 2**64))


class Contexts:
    """The contexts of one text: arrays ``anchor``, ``context`` (hashes), ``first`` and ``last`` (window starts)."""

    def __init__(self, words: np.ndarray):
        n, width = len(words) - WINDOW + 1, WINDOW - GRAM + 1
        gram = W.grams(words, GRAM)
        # the smallest run of each window, leftmost of equals, by doubling
        value, at, size = gram, np.arange(len(gram)), 1
        while 2 * size <= width:
            value, at = _least(value, at, size)
            size *= 2
        if size < width:
            value, at = _least(value, at, width - size)
        start = np.flatnonzero(np.concatenate([[True], at[1:n] != at[: n - 1]]))
        self.first, self.last = start, np.append(start[1:], n) - 1
        place = at[start]
        self.anchor = gram[place]
        up, down = _word_powers(len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        inner = W.mix((sums[self.last + WINDOW] - sums[start]) * down[start])
        shape = (place - start).astype(np.uint64) * np.uint64(64) + (self.last - start).astype(np.uint64)
        self.context = W.mix(inner + W.mix(shape + np.uint64(1)))


def _least(value: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    left = value[: len(value) - shift] <= value[shift:]
    return np.where(left, value[: len(value) - shift], value[shift:]), np.where(left, at[: len(at) - shift], at[shift:])


_powers: dict[str, np.ndarray] = {"up": W.powers(_WORD_BASE, 4096), "down": W.powers(_WORD_INVERSE, 4096)}


def _word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n >= len(_powers["up"]):
        _powers.update(up=W.powers(_WORD_BASE, 2 * n), down=W.powers(_WORD_INVERSE, 2 * n))
    return _powers["up"], _powers["down"]


def texts_with_words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Number and word hashes of each text that has a window."""
    for a, value, _, _, first in W.hashed([(t or "").encode("utf-8", "surrogatepass") for t in texts], lower=False):
        for i in np.flatnonzero(np.diff(first) >= WINDOW).tolist():
            yield a + i, value[first[i] : first[i + 1]]


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, anchor, context of every context; a written table."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in common.slices(frames):
            ids, sizes, rows = np.asarray(frame.column("doc_id")), [], []
            for i, words in texts_with_words(frame.column("text").to_pylist()):
                found = Contexts(words)
                once = np.unique(found.context, return_index=True)[1]  # a text may repeat itself
                rows.append(np.stack([found.anchor[once], found.context[once]], 1))
                sizes.append((ids[i], len(once)))
            if rows:
                every = np.concatenate(rows).view(np.int64)
                owner = np.repeat([d for d, _ in sizes], [n for _, n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(every[:, 0]), pa.array(every[:, 1])], names=["doc_id", "anchor", "context"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs))
    return common.written(rows.mapInArrow(run, "doc_id bigint, anchor bigint, context bigint"), "substring-anchors")


class SuffixAutomaton:
    """Of several word sequences; ``add`` them by owner, ascending, then ``stream`` others."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]

    def add(self, words: list[int], owner: int) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            known = nexts[last].get(w)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                    continue
                last = self._split(last, known, w)
                continue
            own = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            self.owner.append(owner)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = own
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[own] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = own

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of state q for the shorter suffixes that p reaches by w; they first came with q."""
        nexts, link = self.next, self.link
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        self.length.append(self.length[p] + 1)
        self.owner.append(self.owner[q])
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def stream(self, words: list[int], least: int) -> list[int]:
        """For each run of ``least`` words its smallest owner, -1 where no added sequence holds it."""
        nexts, link, length, owner = self.next, self.link, self.length, self.owner
        found, state, matched = [], 0, 0
        for w in words:
            while state > 0 and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                matched += 1
            while state > 0 and length[link[state]] >= least:  # the state of the last ``least`` words themselves
                state = link[state]
                matched = length[state]
            found.append(owner[state] if matched >= least else -1)
        return found[least - 1 :]


MATCHES = "anchor bigint, context bigint, doc_id bigint, reached bigint, windows array<int>"


def _match_shards(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, part, references first, doc_id: what the part's automaton says of each context.

    reached: the largest of its windows' smallest owners, where all windows are matched;
    windows: those that a document before the context's own holds.
    """
    here, automaton, waiting = None, SuffixAutomaton(), []
    out: list[tuple] = []

    def ask(anchor: int, context: int, doc_id: int, words: list[int]) -> None:
        owners = automaton.stream(words, WINDOW)
        earlier = [i for i, d in enumerate(owners) if 0 <= d < doc_id - LEAST_ID]
        reached = max(owners) if min(owners) >= 0 else None
        if earlier or reached is not None:
            out.append((anchor, context, doc_id, None if reached is None else reached + LEAST_ID, earlier))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int32()))], names=["anchor", "context", "doc_id", "reached", "windows"])

    for frame in common.slices(frames):
        for anchor, part, other, doc_id, context, words in zip(*(frame.column(c).to_pylist() for c in ("anchor", "part", "other", "doc_id", "context", "values")), strict=True):
            if (anchor, part) != here or other:
                for row in waiting:
                    ask(*row)
                waiting = []
            if (anchor, part) != here:
                here, automaton = (anchor, part), SuffixAutomaton()
            if other:
                ask(anchor, context, doc_id, words)
            else:
                automaton.add(words, doc_id - LEAST_ID)
                waiting.append((anchor, context, doc_id, words))
        yield batch()
    for row in waiting:
        ask(*row)
    yield batch()


def matched(contexts: DataFrame) -> DataFrame:
    """Of contexts (anchor, doc_id, context, parts, values): anchor, context, doc_id, reached, windows; a row for each automaton that knows some; a written table."""
    own = F.pmod(F.xxhash64("context"), F.col("parts")).cast("int")
    dealt = contexts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("other", F.col("part") != own)
    shards = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "other", "doc_id", "context")
    return common.written(shards.select("anchor", "part", "other", "doc_id", "context", "values").mapInArrow(_match_shards, MATCHES), "substring-matched")


def asked_contexts(rows: DataFrame) -> DataFrame:
    """doc_id, asked: for each document the (anchor, context, parts) of the contexts that no smaller doc_id has; a written table.

    ``rows`` are the contexts of shared anchors.
    """
    contexts = rows.groupBy("anchor", "context").agg(F.min("doc_id").alias("doc_id"))
    contexts = common.written(contexts, "substring-contexts")
    parts = contexts.groupBy("anchor").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    # both sides grow with the corpus: one plan at every size
    asked = contexts.join(parts.hint("merge"), "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "context", "parts")).alias("asked"))
    asked = common.written(asked, "substring-asked")
    common.discard(contexts)
    return asked


def _contexts_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, doc_id, context, parts, values: the words of the contexts asked for."""
    for frame in common.slices(frames):
        ids, asked = frame.column("doc_id").to_pylist(), frame.column("asked").to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, words in texts_with_words(frame.column("text").to_pylist()):
            want = {r["context"]: r for r in asked[i]}
            found = Contexts(words)
            names, words = found.context.view(np.int64), words.view(np.int64)
            for j in np.flatnonzero(np.isin(names, list(want))).tolist():
                row = want.pop(int(names[j]), None)  # a context may come twice in a text
                if row is not None:
                    values = words[found.first[j] : found.last[j] + WINDOW]
                    for column, value in zip(out, (row["anchor"], ids[i], row["context"], row["parts"], values), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int64()))], names=["anchor", "doc_id", "context", "parts", "values"])


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, whole: contexts that go, parts: array of (context, windows) that go; a written table."""
    every = anchors(docs)
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    rows = common.written(every.join(shared.hint("merge"), "anchor"), "substring-shared")
    common.discard(every)
    asked = asked_contexts(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(asked.hint("merge"), "doc_id")
    contexts = common.written(texts.mapInArrow(_contexts_of, "anchor bigint, doc_id bigint, context bigint, parts int, values array<bigint>"), "substring-words")
    common.discard(asked)
    found = matched(contexts)
    common.discard(contexts)
    reached = found.where("reached is not null").groupBy("anchor", "context").agg(F.min("reached").alias("reached"))
    whole = rows.join(reached.hint("merge"), ["anchor", "context"]).where("doc_id > reached").groupBy("doc_id").agg(F.collect_set("context").alias("whole"))
    parts = found.where("size(windows) > 0").groupBy("doc_id").agg(F.collect_list(F.struct("context", "windows")).alias("parts"))
    plans = common.written(whole.join(parts, "doc_id", "full"), "substring-plans")
    common.discard(rows, found)
    return plans


def kept_words(text: str | None, words: np.ndarray | None, whole: list | None, parts: list | None) -> tuple[int, int, str]:
    """Number of words, number removed, and the kept words joined by one space."""
    every = _WORDS.findall(text or "")
    if words is None or not (whole or parts):
        return len(every), 0, " ".join(every)
    found = Contexts(words)
    names = found.context.view(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    for j in np.flatnonzero(np.isin(names, whole)).tolist() if whole else []:
        edge[found.first[j]] += 1
        edge[found.last[j] + WINDOW] -= 1
    windows: dict[int, set[int]] = {}
    for p in parts or []:  # a context may have a row from each of several automata
        windows.setdefault(p["context"], set()).update(p["windows"])
    for j in np.flatnonzero(np.isin(names, list(windows))).tolist() if windows else []:
        starts = found.first[j] + np.array(sorted(windows[int(names[j])]))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(every), int(len(every) - keep.sum()), " ".join([w for w, k in zip(every, keep.tolist(), strict=True) if k])


RESULT = ["n_words", "n_removed", "kept"]


def deduplicated(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns of ``docs``, and n_words, n_removed, kept (the kept words joined by one space) under a prefix; the prefix."""
    plans, own = decisions(docs), common.free_prefix(docs)
    plans = plans.select(F.col("doc_id").alias(own + "id"), F.col("whole").alias(own + "whole"), F.col("parts").alias(own + "parts"))
    keyed = docs.withColumn(own + "key", F.col("doc_id").cast("bigint")).withColumn(own + "text", F.col("text"))
    rows = keyed.join(plans, F.col(own + "key") == F.col(own + "id"), "left").drop(own + "key", own + "id")
    work = [own + c for c in ("text", "whole", "parts")]

    def clean(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in common.slices(frames):
            texts, whole, parts = (frame.column(c).to_pylist() for c in work)
            touched = [i for i in range(len(texts)) if whole[i] or parts[i]]
            words = {touched[j]: w for j, w in texts_with_words([texts[i] for i in touched])}
            done = [kept_words(t, words.get(i), whole[i], parts[i]) for i, t in enumerate(texts)]
            names = [n for n in frame.schema.names if n not in work]
            yield pa.RecordBatch.from_arrays([*(frame.column(n) for n in names), pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done], pa.string())], names=[*names, *(own + c for c in RESULT)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(own + c, kind) for c, kind in zip(RESULT, (T.LongType(), T.LongType(), T.StringType()), strict=True))])
    return rows.mapInArrow(clean, schema), own


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row per document."""
    rows, own = deduplicated(docs.select("doc_id", "text"))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(own + c).alias(c) for c in RESULT))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``; untouched texts stay as they were, as do all other columns."""
    rows, own = deduplicated(docs)
    return rows.withColumn("text", F.when(F.col(own + "n_removed") > 0, F.col(own + "kept")).otherwise(F.col("text"))).select([F.col(f"`{c}`") for c in docs.columns])
