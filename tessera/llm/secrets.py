"""Secrets in text: base patterns, and strings that a primed compressor can't shorten.

The base patterns find assignments of credentials, access keys and long hex strings.
The method adds novelty: a long token with a sensitive word shortly before it is
compressed by zstandard, primed with a dictionary of common identifiers and with the
text around it.  Its marginal bytes, per character, tell known or natural strings
(few) from random ones (many); how many are asked for depends on the token's alphabet, and
words without digits are told by their letter pairs.  Novel tokens are reported as spans of kind ``novel``.

Tokens that adjoin (by a dot or the like, or by a line break) are one run, such as a key
block or a signed web token: a sensitive word before the run counts for all of it, and it is
measured and reported whole.  If the whole is not novel, each of its tokens is measured.
The text around a token primes without the token's own other occurrences, so a secret that
is repeated stays novel.

Spans are in code points, ends exclusive.  Defined results: null text is the empty
text, without spans; a null doc_id stays null; repeated rows are scanned once
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

# The base patterns, with the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "novel")

#: A candidate is a run of at least so many characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"pass|secret|token|key|cred|auth|bearer|private|signature|AKIA", re.A | re.I)
# What adjoins: a piece, what joins two of them in a line, and what may stand around a line break (also an escaped one).
PIECE, GLUE, EDGE = r"[A-Za-z0-9+/_=-]", r"[.:~%\\]", r"""(?:[\s.,;"'\\>#*|]|(?<=\\)[nrt]|\+(?=[\s"']))++"""
GLUED = re.compile(rf"(?:{GLUE}+{PIECE}{{1,15}})*{GLUE}+")
BROKEN = re.compile(rf"(?:{GLUE}+{PIECE}{{1,15}})*({EDGE})(?:{PIECE}{{1,15}}{GLUE})*")
BREAK = re.compile(r"""[\r\n]|\\[rn]|["']\s*\+""")
#: The rest of a line that holds nothing more than pieces.
REST = re.compile(rf"""(?:{GLUE}{PIECE}+){{0,8}}(?:[\x20\t.,;:"'\\)\]}}>]|\+(?=\s))*(?:[\r\n]|\\[rn]|\+|\Z)""")
#: The last, short lines of a block: before its end mark, or (if the lines before are of equal length) without one.
TAIL = re.compile(rf"(?:{EDGE}[A-Za-z0-9+/=]{{1,15}}){{1,2}}(?={EDGE}-----END)")
SHORT_LINE = re.compile(rf"({EDGE})({PIECE}{{1,15}})(?!{PIECE})")
#: Short pieces with letters and digits that are glued to a run.
BEFORE, AFTER = re.compile(rf"(?<!{PIECE})({PIECE}{{4,15}}){GLUE}\Z"), re.compile(rf"{GLUE}({PIECE}{{4,15}})(?!{PIECE})")
#: Most characters between two candidates of a run, and before one in which the head of its block is looked for.
GAP, HEAD = 96, 512
#: Characters before a candidate in which a sensitive word counts, and those that prime the compressor on either side.
NEAR, AROUND = 48, 256
#: Least length of a candidate, or of a piece of it, whose other occurrences do not prime.
LEAST_PIECE = 16
#: Least marginal compressed bytes for each character, where there are 64 symbols; fewer symbols need as much less as they hold.
NOVELTY = 0.62
#: Letter pairs that are common in European languages; without digits, a token is natural if at least this share of its pairs is.
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta "
    "la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia "
    "am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke fr oo av ag if ap gr od bo sp rd do uc bu ei ov by rm ep tt".split()
)
NATURAL = 0.55
#: Compressed bytes that do not tell novelty: a run of one symbol takes 7.
FRAME = 8
# Identifiers and words that code commonly holds.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret authorization bearer "
    "username user email config settings environment variable value default example placeholder changeme your_api_key_here "
    "function return import from class self this const static public private protected void string number boolean true false null none "
    "http https localhost request response header content-type application/json session cookie database connection host port "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx "
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base matches by start, then in the order of ``KINDS``."""
    low = text.lower()
    found: list[Span] = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds after the dictionary and its surroundings."""
    prime = zstandard.ZstdCompressionDict((IDENTIFIERS + around).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=6, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = candidate.encode()
    return len(compressor.compress(data)) - len(compressor.compress(b""))


def mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def is_natural(token: str) -> bool:
    """Whether a token without digits reads as words, or is a rule of signs only."""
    if not any(c.isalnum() for c in token):
        return True
    pairs = [a + b for a, b in itertools.pairwise(token.lower()) if a.isalpha() and b.isalpha()]
    return not any(c.isdigit() for c in token) and sum(p in PAIRS for p in pairs) >= NATURAL * max(1, len(pairs))


def least_bytes(token: str, least: float) -> float:
    """``least`` a character for the token's alphabet: digits, hexadecimal digits or letters of each case, and the signs in it."""
    found = set(token)
    signs = {c for c in found if not c.isalnum()}
    rest, size = found - signs, len(signs)
    if rest <= set("0123456789abcdef") or rest <= set("0123456789ABCDEF"):
        size += 16 if any(c.isalpha() for c in rest) else 10
    else:
        size += 10 * any(c.isdigit() for c in rest) + 26 * any(c.islower() for c in rest) + 26 * any(c.isupper() for c in rest)
    return max(FRAME, least * min(1, math.log2(size) / 6) * len(token))


def block_head(text: str, start: int) -> int:
    """Where the block that ``start`` lies in begins, by its mark; -1 if it lies in none."""
    head = text.rfind("-----BEGIN ", max(0, start - HEAD), start)
    return -1 if head < 0 or text.find("-----END", head, start) >= 0 else head


def adjoin(text: str, last: tuple[int, int], start: int, end: int, block: bool) -> bool:
    """Whether the candidate at ``start`` carries on the run that ``last`` ends; ``block``: a marked one, where blanks will do."""
    if start - last[1] > GAP:
        return False
    gap = text[last[1] : start]
    if GLUED.fullmatch(gap) or (block and gap.isspace()):
        return True
    return bool(BROKEN.fullmatch(gap) and BREAK.search(gap) and REST.match(text, end))


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Candidates, those that adjoin together."""
    run, block = [], False
    for m in CANDIDATE.finditer(text):
        if run and adjoin(text, run[-1], *m.span(), block):
            run.append(m.span())
            continue
        if run:
            yield run
        run, block = [m.span()], block_head(text, m.start()) >= 0
    if run:
        yield run


def in_context(text: str, start: int) -> bool:
    """Whether a sensitive word lies shortly before ``start``, or in the head of its block."""
    if SENSITIVE.search(text, max(0, start - NEAR), start):
        return True
    head = block_head(text, start)
    return head >= 0 and bool(SENSITIVE.search(text, head, start))


def widened(text: str, run: list[tuple[int, int]]) -> tuple[int, int]:
    """The span of a run with its last, short lines and the short pieces glued to it."""
    start, end = run[0][0], run[-1][1]
    if tail := TAIL.match(text, end):
        end = tail.end()
    elif len(run) > 1 and run[-1][1] - run[-1][0] == run[-2][1] - run[-2][0] and BREAK.search(text, run[-2][1], run[-1][0]):
        tail = SHORT_LINE.match(text, end)
        if tail and BREAK.search(tail[1]) and not tail[2].startswith("---") and REST.match(text, tail.end()):
            end = tail.end()
    while (m := AFTER.match(text, end)) and mixed(m[1]):
        end = m.end()
    while (m := BEFORE.search(text, max(0, start - 17), start)) and mixed(m[1]):
        start = m.start()
    return start, end


def own_pieces(token: str) -> set[str]:
    """The token, and its long pieces between assignments or slashes: ``auth=S`` and ``//host/S`` repeat S too."""
    return {p for p in (token, token.partition("=")[2], *re.split("[=/]", token)) if len(p) >= LEAST_PIECE}


def surroundings(text: str, run: list[tuple[int, int]]) -> str:
    """The characters on either side of a run, without other occurrences of its candidates, whole or cut by the window's edge."""
    start, end = run[0][0], run[-1][1]
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    inside, near = [text[a:b] for a, b in run], []
    for m in CANDIDATE.finditer(text, max(0, low - AROUND), min(len(text), high + AROUND)):
        if (m.end() <= start or m.start() >= end) and any(m[0] in token for token in inside):
            near.append(m[0])
    pieces = set(near).union(*map(own_pieces, inside))
    around = ""
    for a, b in ((low, start), (end, high)):
        taken = [False] * (b - a)
        for piece in pieces:
            # as far as an occurrence can reach over the window's outer edge
            n = len(piece) - 1
            left, right = (max(0, a - n), b) if b == start else (a, min(len(text), b + n))
            at = text.find(piece, left, right)
            while at >= 0:
                x, y = max(at, a), min(at + len(piece), b)
                if x < y:
                    taken[x - a : y - a] = [True] * (y - x)
                at = text.find(piece, at + 1, right)
        around += "".join(c for c, t in zip(text[a:b], taken, strict=True) if not t)
    return around


def is_novel(text: str, run: list[tuple[int, int]], least: float) -> bool:
    token = "".join(text[a:b] for a, b in run)
    return not is_natural(token) and marginal_bytes(token, surroundings(text, run)) >= least_bytes(token, least)


def novel_spans(text: str, least: float = NOVELTY) -> list[Span]:
    """Incompressible runs of candidates in sensitive contexts, or candidates of a run that is not so as a whole."""
    found = []
    for run in runs(text):
        first = next((i for i, (start, _) in enumerate(run) if in_context(text, start)), len(run))
        run = run[first:]
        if not run:
            continue
        if is_novel(text, run, least):
            found.append(("novel", *widened(text, run)))
        elif len(run) > 1:
            found += [("novel", *part) for part in run if is_novel(text, [part], least)]
    return found


def spans_of(text: str) -> list[Span]:
    return sorted(base_spans(text) + novel_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with the union of its spans replaced."""
    parts, at = [], 0
    for _, start, end in spans_of(text):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, text), by start; one row per document."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
        for frame in common.slices(frames):
            rows = [[{"kind": k, "start": a, "end": b, "text": t[a:b]} for k, a, b in spans_of(t)] for t in frame.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(docs))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,text:string>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the checksum of the base spans, and all spans joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scanned.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(base, text)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; null texts stay null, all other columns as they were."""
    fields = docs.schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in common.slices(frames):
            i = frame.schema.get_field_index("text")
            texts = pa.array([None if t is None else redacted(t) for t in frame.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if j == i else c for j, c in enumerate(frame.columns)], names=frame.schema.names)

    return docs.mapInArrow(run, fields)
