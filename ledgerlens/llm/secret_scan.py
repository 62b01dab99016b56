"""Secret scan: fixed patterns plus sliding-window entropy.

Patterns (kinds assign, access, hex) are matched over the whole text.  The entropy
part looks at candidate strings, the maximal runs of the base64 and URL alphabet of at
least ``min_length`` characters.  For each character class (hexadecimal, then base64)
a window slides over the stretches of the candidate in that class.  Its counts change
by one character in and one out, and so does its Shannon entropy: with counts c and
window length w it is log2(w) - sum(c * log2 c) / w, and the sum is kept by a table of
c * log2 c.  Overlapping windows at or above the class's threshold join into one span.

A finding is suppressed by the allow-list: known placeholders and test values, UUIDs,
paths and words joined by separators, runs without a digit or without a letter, and
whatever the caller adds.  A placeholder inside a candidate takes away only the piece between
/ and = that holds it; what is left on either side is a candidate of its own.  Findings that overlap a pattern's span are not repeated.
Allow-listing never removes a pattern's span.

Defined results: a null or empty text has no spans; repeated rows give repeated results;
spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import field, map_arrow

# fixed values of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")    # AKIA[A-Z0-9]+ of 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

ALLOWED_INSIDE = (  # a finding that holds one of these is suppressed
    r"(?i)example|sample|placeholder|changeme|change_me|your[_-]|dummy|redacted|xxxx|0000000|1234567|abcdefg",
)
ALLOWED_WHOLE = (   # a finding that is one of these is suppressed
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",   # UUID
    r"[A-Za-z]*(?:[-_/][A-Za-z]+)*[-_/]?\d{0,4}",                           # words and paths, a short number last
    r"(?i)sha(?:1|256|384|512)-.*",                                         # integrity digests
)


@dataclass(frozen=True)
class Scan:
    """Window and threshold (bits a character) for each class, and the allow-list."""

    min_length: int = 20
    window: int = 20
    hex_bits: float = 3.0
    base64_bits: float = 3.7
    allow_inside: Sequence[str] = ALLOWED_INSIDE
    allow_whole: Sequence[str] = ALLOWED_WHOLE


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def window_spans(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``s`` whose entropy is at least ``bits``."""
    if len(s) < window:
        return []
    plog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9   # entropy >= bits  <=>  sum of c log c <= most
    counts: dict[str, int] = {}
    total = 0.0
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += plog[c + 1] - plog[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += plog[c - 1] - plog[c]
        if i >= window - 1 and total <= most:
            begin = i - window + 1
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((begin, i + 1))
    return out


_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
_JOINT = re.compile(r"[/=]")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


class Scanner:
    def __init__(self, scan: Scan):
        self.scan = scan
        self.candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % scan.min_length)
        self.inside = [re.compile(p) for p in scan.allow_inside]
        self.whole = [re.compile(p) for p in scan.allow_whole]

    def plain(self, s: str) -> bool:
        return not _DIGIT.search(s) or not _LETTER.search(s) or any(p.fullmatch(s) for p in self.whole)

    def allowed(self, s: str) -> bool:
        return self.plain(s) or any(p.search(s) for p in self.inside)

    def stretches(self, s: str) -> Iterator[tuple[int, int]]:
        """What is left of the run ``s`` without the pieces between joints that hold allowed text."""
        at = 0
        for a, b in sorted(m.span() for p in self.inside for m in p.finditer(s)):
            if at and b <= at:
                continue
            yield at, max(at, s.rfind("/", at, a) + 1, s.rfind("=", at, a) + 1)
            joint = _JOINT.search(s, b)
            at = joint.start() if joint else len(s)
        yield at, len(s)

    def candidates(self, s: str) -> Iterator[tuple[int, int]]:
        if self.plain(s):
            return
        for a, b in self.stretches(s):
            while 0 < a < b and s[a] in "/=":
                a += 1
            while a < b < len(s) and s[b - 1] in "/=":
                b -= 1
            if b - a >= self.scan.min_length and (b - a == len(s) or not self.plain(s[a:b])):
                yield a, b

    def entropy_spans(self, text: str, taken: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        k = self.scan
        at, reach = 0, 0   # taken is sorted by start: one pass beside the candidates
        for m in self.candidate.finditer(text):
            s = m.group()
            spans = []
            for begin, end in self.candidates(s):
                spans += [(begin + h.start() + a, begin + h.start() + b) for h in _HEX_RUN.finditer(s[begin:end])
                          for a, b in window_spans(h.group(), k.window, k.hex_bits)]
                spans += [(begin + a, begin + b) for a, b in window_spans(s[begin:end], k.window, k.base64_bits)]
            spans.sort()
            joined: list[tuple[int, int]] = []
            for a, b in spans:
                if joined and a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            for a, b in joined:
                if self.allowed(s[a:b]):
                    continue
                a, b = m.start() + a, m.start() + b
                while at < len(taken) and taken[at][0] < b:
                    reach = max(reach, taken[at][2])
                    at += 1
                if reach <= a:
                    yield a, 3, b

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = pattern_spans(text)
        return base, list(self.entropy_spans(text, base))


def spans_text(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_OUT = pa.schema([("row_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                  ("n_entropy", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: Scan = Scan()) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256
    (of the patterns' spans), spans (all of them, by start, then kind)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(scan)
        for part in parts:
            rows: list[list] = [[] for _ in _OUT]
            for id_, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                base, more = scanner(text.as_py() or "")
                counts = [0, 0, 0]
                for _, k, _ in base:
                    counts[k] += 1
                digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
                for col, v in zip(rows, [id_, *counts, len(more), digest, spans_text(sorted(base + more))], strict=True):
                    col.append(v)
            yield pa.record_batch(rows, schema=_OUT)

    narrow = docs.select(field(id_col).cast("bigint").alias("row_id"), field(text_col).alias("text"))
    schema = ("row_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, "
              "base_sha256 string, spans string")
    return map_arrow(narrow, run, schema).withColumnRenamed("row_id", "doc_id")


_FOUND = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                    ("value", pa.string())])


def found_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: Scan = Scan()) -> DataFrame:
    """One row per span: doc_id, kind, start, end, value."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(scan)
        for part in parts:
            out: list[tuple] = []
            for id_, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                t = text.as_py() or ""
                base, more = scanner(t)
                out += [(id_, KINDS[k], a, b, t[a:b]) for a, k, b in sorted(base + more)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    narrow = docs.select(field(id_col).cast("bigint").alias("doc_id"), field(text_col).alias("text"))
    return map_arrow(narrow, run, "doc_id bigint, kind string, start bigint, end bigint, value string")
