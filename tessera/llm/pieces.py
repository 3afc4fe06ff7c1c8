"""Token ids of whole texts by way of a bounded memo of space-separated pieces.

A text is cut before every single space between two non-space characters.  The
split patterns of the supported tokenizers never join characters across such a
cut and never look past it, so the ids of the pieces, put together, are the ids
of the text.  A piece's ids are computed once per worker while it stays in the memo.

Where no pretoken holds white space, a whole column of texts is cut at all of it by Arrow, which
also finds the column's distinct words and puts their ids in place: Python sees each distinct word once.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces, and pretokens, of one memo generation; there are two at most.
MEMO, PRETOKENS = 500_000, 250_000
#: Mean characters of a generation's pieces, beyond which it ends earlier; characters of a pretoken that is remembered.
MEAN, LONGEST = 16, 64
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the split pattern of byte-level BPE files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the split pattern of lower-casing files; no match of it holds white space or depends on any.
WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceEncoder:
    """Ids of texts as bytes: little-endian, 32 bits each.

    ``encode_pieces`` maps strings to such bytes, ``encode_words`` pieces without their leading space, none
    of which touches more white space.  The memo is keyed by the latter.
    Old entries are forgotten by generation: a miss costs time and changes nothing.
    ``apart``: white space gives no ids and changes none, so words may be cut at all of it.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], encode_words: Callable[[list[str]], list[bytes]] | None = None, memo: int = MEMO, apart: bool = False):
        self.encode_pieces = encode_pieces
        self.apart = apart
        self.encode_words = encode_words or (lambda words: encode_pieces([" " + w for w in words]))
        self.memo = memo
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0  # of the young generation's pieces

    def _learn(self, pieces: set[str], missing: set[str]) -> None:
        """Afterwards the young generation holds all of ``pieces``, none of which touches white space; ``missing`` are those it lacks."""
        if len(self.young) + len(missing) > self.memo or self.chars > MEAN * self.memo:
            self.old, self.young, missing, self.chars = self.young, {}, pieces, 0
        self.chars += sum(map(len, missing))
        young, old = self.young, self.old
        new = list(missing.difference(old))
        if len(new) < len(missing):
            young.update((p, old[p]) for p in missing.difference(new))
        young.update(zip(new, self.encode_words(new), strict=True))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        distinct = set(rest)
        new = distinct.difference(self.young)
        if "" in new or first[-1:].isspace() or any([p[0].isspace() or p[-1].isspace() for p in new]):
            first, *rest = _CUT.split(text)
            distinct = set(rest)
            new = distinct.difference(self.young)
            beside = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
            self._learn(distinct - beside, new - beside)
            ids = [self.young[p] if p not in beside else self.encode_pieces([" " + p])[0] for p in rest]
        else:
            if new:
                self._learn(distinct, new)
            ids = map(self.young.__getitem__, rest)
        return (self.encode_pieces([first])[0] if first else b"") + b"".join(ids)

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each of ``texts``, none of which is null, as an Arrow list<int32>."""
        if not self.apart:
            return list_of_ids([self.encode(t) for t in texts.to_pylist()])
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = strings(coded.dictionary)
        pieces = set(distinct)
        if missing := pieces.difference(self.young):
            self._learn(pieces, missing)
        placed = list_of_ids(list(map(self.young.__getitem__, distinct))).take(coded.indices)
        return pa.ListArray.from_arrays(placed.offsets.take(words.offsets), placed.values)


#: Characters up to here are split, composed and lower-cased here: their classes and mappings are the same in every Unicode version in use.
LATIN_END = "\u0370"


def split_rule(spec: dict) -> tuple[Callable[[str], list[str]], bool, bool] | None:
    """How a tokenizer file's texts fall into pretokens: all matches of its pattern, whether it lower-cases, and whether white space is in no match.

    Where it lower-cases, the space before a word is in no pretoken; elsewhere it begins the word's first.
    Letters with punctuation behind them are two pretokens under either pattern.
    None for files of another make; their pieces go through the library whole.
    """
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    kinds = [n.get("type") for n in (normal or {}).get("normalizers", [normal] if normal else [])]
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kinds:
        return regex.compile(SPLIT).findall, False, False
    steps = pre.get("pretokenizers", [])
    if [p.get("type") for p in steps] == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"]:
        cut, byte_level = steps
        if cut["behavior"] == "Removed" and cut["invert"] and not byte_level["use_regex"] and not byte_level["add_prefix_space"]:
            pattern = cut["pattern"]["Regex"]
            return regex.compile(pattern).findall, True, pattern == WORD_SPLIT
    return None


@functools.lru_cache(maxsize=4)
def library_encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """An encoder whose ids come from the tokenizers library; one per worker and file.

    Latin words are split by the file's own pattern, and the library's model merges each
    distinct pretoken once; other words, and those with a special token, go through it whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = special_as_text
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    find, lower, apart = split_rule(spec) or (None, False, False)
    special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", [])]
    to_char = {b: c for c, b in byte_of_char().items()}
    space, model = to_char[32], tokenizer.model.tokenize
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def whole(pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def merged(pretoken: str) -> bytes:
        ids = older.get(pretoken)
        if ids is None:
            if pretoken.isascii() and pretoken.isprintable():
                chars = pretoken.replace(" ", space)
            else:
                chars = pretoken.encode().decode("latin-1").translate(to_char)
            ids = array("I", [t.id for t in model(chars)]).tobytes()
        if len(pretoken) <= LONGEST:
            known[pretoken] = ids
        return ids

    def split(words: list[str]) -> list[bytes]:
        nonlocal known, older
        if len(known) > PRETOKENS:
            older, known = known, {}
        text, get, found, before = " ".join(words), known.get, [], "" if lower else " "
        foreign = not text.isascii() and max(text) >= LATIN_END
        marked = [x for x in special if x in text]
        for word in words:
            if foreign and not word.isascii() and max(word) >= LATIN_END or marked and any(x in word for x in marked):
                found += whole([" " + word])
                continue
            if lower:
                word = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
            letters = word.rstrip(string.punctuation)
            if letters.isalpha():
                pretoken = before + letters
                ids = get(pretoken) or merged(pretoken)
                if len(letters) < len(word):
                    rest = word[len(letters) :]
                    ids += get(rest) or merged(rest)
            else:
                ids = b"".join([get(t) or merged(t) for t in find(before + word)])
            found.append(ids)
        return found

    return PieceEncoder(whole, split if find else None, apart=apart)


def forget() -> None:
    """Let go of this worker's encoders and their memos, hundreds of MB, before work that encodes nothing."""
    library_encoder.cache_clear()


def strings(words: pa.Array) -> list[str]:
    """The strings of an array of words without spaces, made by one split of them all."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))[0].as_py().split(" ")


def list_of_ids(ids: list[bytes]) -> pa.ListArray:
    """An Arrow list<int32> of ids given as bytes."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
