"""Secret scans: three exact patterns, and sliding-window entropy over candidate strings.

Null and empty texts have no spans. Repeated rows give repeated, equal rows.
Columns other than doc_id and text are ignored by ``scan`` and kept by
``redact``; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.columns import over_rows, texts

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PIECE = re.compile(r"[A-Za-z0-9]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Characters in a window; bits a character that a window of each class must have.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "base36": 3.4, "base64": 3.6}
#: Fewest digits and letters in a window: words and numbers alone are no secrets.
LEAST_DIGITS, LEAST_LETTERS = 3, 3

#: Strings that look random but are public by their nature.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?i:example|sample|dummy|placeholder|changeme|xxxx)"),
    re.compile(r"\A[0-9_=+/-]+\Z"),
    re.compile(r"\A\d{4}-\d{2}-\d{2}T?[0-9-]*\Z"),
)

_HEX_RUN = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_WORD_RUN = bytes(120 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else 32 for i in range(256))
_KEYWORDS = (b"passw", b"secret", b"token", b"api")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
)


def window_class(lower: int, upper: int, other: int, beyond_f: int) -> str:
    """The narrowest alphabet that a window's letters and signs fit."""
    if upper == 0 and other == 0:
        return "base36" if beyond_f else "hex"
    if lower == 0 and other == 0:
        return "base36"
    return "base64"


def entropy_spans(text: str, window: int = WINDOW, variety: bool = False) -> list[tuple[int, int]]:
    """Spans of a candidate string whose windows exceed their class's threshold; touching ones are joined.

    A window slides by one character; its entropy follows from the counts that
    the entering and leaving characters change: H = log2 w - sum(c log2 c) / w.
    With ``variety`` a digit or letters of both cases do in place of LEAST_DIGITS.
    """
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    found: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total = 0.0
    digits = lower = upper = other = beyond = 0
    for i, ch in enumerate(text):
        for c, step in ((text[i - window] if i >= window else "", -1), (ch, 1)):
            if not c:
                continue
            n = counts.get(c, 0)
            total += clog[n + step] - clog[n]
            counts[c] = n + step
            if c.isdigit():
                digits += step
            elif "a" <= c <= "z":
                lower += step
                beyond += step * (c > "f")
            elif "A" <= c <= "Z":
                upper += step
                beyond += step * (c > "F")
            else:
                other += step
        if i + 1 < window:
            continue
        varied = digits or (lower and upper) if variety else digits >= LEAST_DIGITS
        if not varied or lower + upper < LEAST_LETTERS:
            continue
        bits = math.log2(window) - total / window
        if bits >= THRESHOLDS[window_class(lower, upper, other, beyond)]:
            start = i + 1 - window
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def without(a: int, b: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the cuts leave of the span."""
    out = []
    for s, e in sorted(cuts):
        if s >= b or e <= a:
            continue
        if s > a:
            out.append((a, s))
        a = max(a, e)
    return [*out, (a, b)] if a < b else out


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The candidate strings in which some window passes, less what base spans hold.

    Keyword assignments and allow-listed parts (a placeholder takes the letters
    and digits around it) end a candidate; hex and access spans may lie in one.
    """
    kinds = [[(s, e) for s, k, e in base if k == kind] for kind in range(3)]  # each in order, without overlaps
    ends = [[e for _, e in own] for own in kinds]

    def held(a: int, b: int, some) -> list[tuple[int, int]]:
        cuts = []
        for k in some:
            for s, e in itertools.islice(kinds[k], bisect.bisect_right(ends[k], a), None):
                if s >= b:
                    break
                cuts.append((s, e))
        return cuts

    out = []
    for m in CANDIDATE.finditer(text):
        if any(p.search(m.group()) for p in ALLOWED[2:]):
            continue
        cuts = held(m.start(), m.end(), [0])
        cuts += [(u.start() + m.start(), u.end() + m.start()) for u in ALLOWED[0].finditer(m.group())]
        cuts += [(w.start() + m.start(), w.end() + m.start()) for w in PIECE.finditer(m.group()) if ALLOWED[1].search(w.group())]
        for a, b in without(m.start(), m.end(), cuts):
            if b - a >= WINDOW and entropy_spans(text[a:b], variety=True):
                out += [(s, 3, e) for s, e in without(a, b, held(a, b, range(3)))]
    return out


def spans_of(raw: bytes) -> tuple[list, list]:
    """Base and added spans of one text. The byte tests only rule out texts that can't hold a match."""
    low = raw.lower()
    may = (
        any(k in low for k in _KEYWORDS)
        or b"AKIA" in raw
        or b"x" * 24 in raw.translate(_HEX_RUN)
        or b"x" * WINDOW in raw.translate(_WORD_RUN)
    )
    if not may:
        return [], []
    text = raw.decode("utf-8")
    base = base_spans(text)
    return base, added_spans(text, base)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                base, more = spans_of(raw)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = hashlib.sha256(_join(base).encode()).hexdigest()
                out.append((doc_id, *n, digest, _join(sorted(base + more)), len(more)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, SCHEMA)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by the mark; null texts stay null."""

    def one(raw: bytes) -> str:
        base, more = spans_of(raw)
        text = raw.decode("utf-8")
        out, at = [], 0
        for a, _, b in sorted(base + more):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def change(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        column = batch.column(at)
        masked = [None if null else one(raw) for raw, null in zip(texts(column), column.is_null().to_pylist(), strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(masked, column.type))

    return over_rows(docs, change)
