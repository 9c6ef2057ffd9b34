"""Secrets in texts: assignments, access keys, hex strings, and strings of high
entropy.

Base rules find assignments to a secret's name, access keys and long hex
strings. The method adds what they miss: in every candidate (a maximal run of
``CANDIDATE`` characters) a window of ``WINDOW`` characters slides along; counts
of its characters and of its character classes are kept up by the character
that enters and the one that leaves, and with them the window's Shannon entropy.
A window is hot when its entropy reaches the threshold of the smallest class
that holds all its characters (``THRESHOLDS``: a digit string can never be as
mixed as a base64 string). Hot windows that touch make one span.

The allow-list drops spans of known harmless shape (``ALLOWED``: words and short
numbers joined by signs, UUIDs, runs of the alphabet, placeholders), in URLs'
paths, behind a checksum's or an inline data prefix, and any string the caller
names. Spans within a base match are not repeated. Base matches always stay.

Each text is scanned once, on its own: no shuffle, no state beyond one text.
Hex strings and access keys lie within candidates, so plain prose costs one
pattern and a few substring tests.

Edge cases: null text counts as empty; texts without a match get no spans; very
long texts are scanned whole; positions are code points, end exclusive; ties in
start go by kind (assign, access, hex, entropy); repeated rows get equal
results; an empty table gives an empty result; other columns pass untouched in
``find`` and are not read by the query.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WINDOW)

# Bits of each character class's characters; a window's classes are the bits of all it holds.
DIGIT, LOWER_HEX, LOWER, UPPER_HEX, UPPER, SIGN = 1, 2, 4, 8, 16, 32
CLASS = ({c: DIGIT for c in "0123456789"} | {c: LOWER_HEX for c in "abcdef"} | {c: UPPER_HEX for c in "ABCDEF"}
         | {c: LOWER for c in "ghijklmnopqrstuvwxyz"} | {c: UPPER for c in "GHIJKLMNOPQRSTUVWXYZ"}
         | {c: SIGN for c in "+/_=-"})
#: (classes, least bits of entropy of a window of 20), smallest class first. A
#: window of random characters reaches it nearly always once its string is half
#: as long again; words of a language, which repeat letters, stay below.
THRESHOLDS = (
    (DIGIT, 3.0),
    (DIGIT | LOWER_HEX, 3.1), (DIGIT | UPPER_HEX, 3.1),
    (LOWER_HEX | LOWER, 4.0), (UPPER_HEX | UPPER, 4.0),
    (DIGIT | LOWER_HEX | LOWER, 3.7), (DIGIT | UPPER_HEX | UPPER, 3.7),
    (LOWER_HEX | LOWER | UPPER_HEX | UPPER, 4.0),
    (DIGIT | LOWER_HEX | LOWER | UPPER_HEX | UPPER, 3.8),
    (DIGIT | LOWER_HEX | LOWER | UPPER_HEX | UPPER | SIGN, 3.95),
)
LIMIT = [next(t for c, t in THRESHOLDS if not bits & ~c) for bits in range(64)]
_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]

_WORD = r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,4}|\d{1,4})"
#: Whole candidates that are harmless.
ALLOWED = tuple(re.compile(p) for p in (
    rf"[+/_=-]*{_WORD}(?:[+/_=-]+{_WORD})*[+/_=-]*",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i:(?:sha-?\d+|md5)[-_=].*)",
    r"(?i:.*(?:example|sample|placeholder|dummy|changeme|x{6}|0{8}).*)",
))
#: What stands before a candidate that is harmless.
ALLOWED_BEFORE = re.compile(r"(?:://[^\s?=]*|(?i:\b(?:sha-?\d+|md5|crc32)[-:]|;base64,))\Z")
BEFORE = 256     # characters before a candidate in which such a prefix begins


def hot_spans(s: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, greatest entropy) of the merged hot windows of ``s``."""
    if len(s) < WINDOW:
        return
    counts: dict[str, int] = {}
    held = dict.fromkeys((DIGIT, LOWER_HEX, LOWER, UPPER_HEX, UPPER, SIGN), 0)
    total, bits = 0.0, 0          # sum of n*log2(n) over the window's characters; classes it holds
    top, start, end = 0.0, -1, -1
    full = math.log2(WINDOW)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n] if n < WINDOW else 0.0
        counts[c] = n + 1
        k = CLASS[c]
        held[k] += 1
        bits |= k
        if i >= WINDOW:
            c = s[i - WINDOW]
            n = counts[c]
            total -= (_TERM[n] if n <= WINDOW else _TERM[WINDOW]) - _TERM[n - 1]
            counts[c] = n - 1
            k = CLASS[c]
            held[k] -= 1
            if not held[k]:
                bits &= ~k
        if i < WINDOW - 1:
            continue
        entropy = full - total / WINDOW
        if entropy < LIMIT[bits] - 1e-9:
            continue
        first = i - WINDOW + 1
        if start >= 0 and first > end:
            yield start, end, top
            start, top = -1, 0.0
        start = first if start < 0 else start
        end, top = i + 1, max(top, entropy)
    if start >= 0:
        yield start, end, top


def _sequence(s: str) -> bool:
    """Mostly neighbours in code (abc, 987) or repeats."""
    steps = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(s, s[1:]))
    return 2 * steps > len(s)


def harmless(text: str, start: int, end: int, hot: str, allow: frozenset[str] = frozenset()) -> bool:
    """Whether the allow-list covers the candidate text[start:end] or its ``hot`` span."""
    s = text[start:end]
    return (s in allow or hot in allow or any(p.fullmatch(s) for p in ALLOWED) or _sequence(hot)
            or ALLOWED_BEFORE.search(text, max(0, start - BEFORE), start) is not None)


def secrets(text: str, allow: frozenset[str] = frozenset()) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, entropy) of every secret of a text, in order."""
    found: list[tuple[int, int, int, float | None]] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    candidates = [m.span() for m in CANDIDATE.finditer(text)]
    for a, b in candidates:
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            found += [(m.start(), kind, m.end(), None) for m in pattern.finditer(text, a, b)]
    if candidates:
        base = sorted((s, e) for s, _, e, _ in found)
        at = 0
        for a, b in candidates:
            while at < len(base) and base[at][1] <= a:
                at += 1
            for s, e, entropy in hot_spans(text[a:b]):
                s, e = a + s, a + e
                # base matches of one candidate are few: those that begin before its end
                i, inside = at, False
                while i < len(base) and base[i][0] <= s:
                    inside = inside or base[i][1] >= e
                    i += 1
                if not inside and not harmless(text, a, b, text[s:e], allow):
                    found.append((s, 3, e, entropy))
    return sorted(found, key=lambda x: x[:3])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("text", pa.string()), ("entropy", pa.float64())]))


def find(docs: DataFrame, text: str = "text", allow: Iterable[str] = ()) -> DataFrame:
    """``docs`` and a column ``secrets``: the spans (kind, start, end, text,
    entropy) of each text, by start and kind. A column of that name is kept;
    the new one's name then gets underscores."""
    allowed = frozenset(allow)
    name, = fresh(docs, "secrets")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at):
                t = value.as_py() or ""
                out.append([{"kind": KINDS[k], "start": s, "end": e, "text": t[s:e], "entropy": h}
                            for s, k, e, h in secrets(t, allowed)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _SPANS)], names=[*batch.schema.names, name])

    from pyspark.sql.types import ArrayType, StructType

    span = StructType.fromDDL("kind string, start bigint, end bigint, text string, entropy double")
    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, ArrayType(span)))


def listing(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
