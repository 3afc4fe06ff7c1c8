"""Byte-level BPE by backtracking, and decoding by an offset table.

A text's pretokens are covered left to right with the longest vocabulary entries
that an Aho-Corasick automaton finds at each position.  Two neighbours are kept only
if they are compatible, that is if merging their joint bytes leaves just these two;
otherwise the next shorter entry is tried, and where none fits the border is marked
dead and the matcher goes back by one token.  A border dies once at most, so a
pretoken takes linear time, and its ids are those that the merge rules give.

Decoding looks ids up in one blob of all entries' bytes with an offset for each id.

Defined results: null text is the empty text, with no ids; special tokens' strings
become the special ids; extra columns are ignored; repeated rows are encoded once
each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from tessera.llm import common
from tessera.llm.pieces import LATIN_END, PRETOKENS, SPLIT, PieceEncoder, byte_of_char

#: Remembered verdicts on pairs.
PAIRS = 500_000
NEVER = 1 << 60


class BacktrackingBpe:
    """A vocabulary prepared for exact encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte, vocab = byte_of_char(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        entries = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for chars, i in vocab.items():
            if chars not in self.special:
                entries[i] = bytes(byte[c] for c in chars)
        self._read_merges(spec["model"]["merges"], vocab, len(entries))
        self._index(entries)
        for text, i in self.special.items():
            entries[i] = text.encode()
        self.offsets = np.cumsum([0, *map(len, entries)])
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.as_byte = {c: chr(b) for c, b in byte.items()}
        self.library_split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.split = regex.compile(SPLIT).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _read_merges(self, merges: list, vocab: dict[str, int], size: int) -> None:
        self.joined: dict[tuple[int, int], int] = {}
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[a + b]
            if self.rank[whole] >= 0:
                raise ValueError(f"two rules make {a + b!r}: the pair check needs one rule an entry")
            self.joined[vocab[a], vocab[b]] = rank
            self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]

    def _index(self, entries: list[bytes]) -> None:
        """The automaton, and for each entry the longest entry that is a proper prefix of it."""
        made = [self.rank[i] < 0 for i in range(len(entries))]
        for i in sorted(range(len(entries)), key=self.rank.__getitem__):
            if self.rank[i] >= 0:  # is the entry what merging its own bytes gives?
                a, b = self.left[i], self.right[i]
                made[i] = made[a] and made[b] and self.meet(a, b, self.rank[i])
        ids = {e.decode("latin-1"): i for i, e in enumerate(entries) if e and made[i]}
        self.automaton = ahocorasick.Automaton()
        for text, i in ids.items():  # one character for each byte
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.length = [len(e) for e in entries]
        self.shorter = [-1] * len(entries)
        for text, i in ids.items():
            self.shorter[i] = next((ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in ids), -1)
        self.ids = ids

    def meet(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether no rule ranked below ``limit`` crosses the border while ``a`` and ``b`` are built.

        The newest merge beside the border is undone again and again; a rule that
        joins what then meets there spoils the pair if it fires before that merge:
        with a lower rank or, as merges go left to right, at the same rank on the left.
        """
        joined, rank = self.joined, self.rank
        while joined.get((a, b), limit) >= limit:
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.meet(a, b)
        return known

    def encode_pretoken(self, text: str) -> list[int]:
        """``text`` has one character for each byte."""
        n, length, shorter, compatible = len(text), self.length, self.shorter, self.compatible
        if (whole := self.ids.get(text)) is not None:
            return [whole]
        longest = [-1] * n
        for end, i in self.automaton.iter(text):  # ends ascend, so the longest comes last
            longest[end - length[i] + 1] = i
        alive, ids, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while token >= 0 and not (alive[at + length[token]] and (last < 0 or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                back = ids.pop()
                at -= length[back]
                token = shorter[back]
        return ids

    def pretokens(self, text: str) -> list[str]:
        """Pretokens with one character for each byte.

        Beyond Latin, letter classes differ between Unicode versions: there the library's own splitter is asked.
        """
        if not text.isascii() and max(text) >= LATIN_END:
            return ["".join([self.as_byte[c] for c in t]) for t, _ in self.library_split(text)]
        return [t if t.isascii() else t.encode().decode("latin-1") for t in self.split(text)]

    def encode_text(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.at_special(text) if self.at_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for pretoken in self.pretokens(part):
                    ids += self.encode_pretoken(pretoken)
        return ids

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        found, known = [], self.known
        for text in texts:
            if any(s in text for s in self.special):
                found.append(array("I", self.encode_text(text)).tobytes())
                continue
            found.append(b"".join([known.get(t) or self._remember(t) for t in self.pretokens(text)]))
        return found

    def _remember(self, pretoken: str) -> bytes:
        if len(self.known) >= 2 * PRETOKENS:
            self.known.clear()
        self.known[pretoken] = ids = array("I", self.encode_pretoken(pretoken)).tobytes()
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        where = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.blob[where].tobytes()


@functools.lru_cache(maxsize=2)
def prepared(path: str) -> tuple[BacktrackingBpe, PieceEncoder]:
    """One for each worker and file."""
    bpe = BacktrackingBpe(path)
    return bpe, PieceEncoder(bpe.encode_pieces)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_le (little-endian, 32 bits each), decoded: each text's ids, and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = prepared(tokenizer)
        for batch in common.slices(batches):
            ids = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            decoded = [bpe.decode(np.frombuffer(i, "<u4").astype(np.int64)).decode("utf-8", "replace") for i in ids]
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_le", "decoded"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_le binary, decoded string")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, decoded of rows with doc_id and ids_le; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = prepared(tokenizer)
        for batch in common.slices(batches):
            texts = [None if i is None else bpe.decode(np.frombuffer(i, "<u4").astype(np.int64)).decode("utf-8", "replace") for i in batch.column("ids_le").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids_le").mapInArrow(run, "doc_id bigint, decoded string")
