"""Token counts of whole texts: batch encoding in Arrow functions, lengths only.

A byte-level BPE with the usual pattern never joins across the start of a white-space
run: a pre-token ends there, whatever follows.  So a text may be cut before a white
space that follows a non-space, and the pieces' counts add up to the whole text's.
Each text is cut at all of these safe boundaries.  Pieces repeat a lot (a piece is a
word with the space before it), so each distinct piece is encoded once for as long as
it stays in the worker's table; new pieces go to the library in batches of at most
``batch_bytes`` bytes.  Only lengths leave the function.

Memory is bounded: about ``batch_bytes`` of text are cut up at a time, long texts are
read in sections that end at a safe boundary, and the table of lengths is emptied when
it holds ``table_size`` pieces.  A text without any safe boundary is one piece.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside
a text count as the library's default has it (one special token); repeated rows give
repeated results.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import field, map_arrow

LIMIT = 1024              # over_limit: more tokens than this
BATCH_BYTES = 1 << 20
TABLE_SIZE = 400_000

# a safe boundary: any non-space (in the widest sense), then an ASCII white space
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")


def sections(text: str, size: int) -> Iterator[str]:
    """The text in sections of about ``size`` characters that end at safe boundaries."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


class Counter:
    """Token counts with one tokenizer; texts are added, then counted together."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, table_size: int = TABLE_SIZE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.batch_bytes, self.table_size = batch_bytes, table_size
        self.lengths: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        run: list[str] = []
        held = 0
        for p in pieces:
            run.append(p)
            held += len(p) + 16
            if held >= self.batch_bytes:
                self._encode(run)
                run, held = [], 0
        self._encode(run)

    def _encode(self, run: list[str]) -> None:
        for p, e in zip(run, self.tokenizer.encode_batch_fast(run, add_special_tokens=False), strict=True):
            self.lengths[p] = len(e)

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of texts of about ``batch_bytes`` in all."""
        cut = [SAFE.split(t) if t else [] for t in texts]
        pieces = set().union(*cut)
        if len(self.lengths) + len(pieces) > self.table_size:
            self.lengths = {}
        self.learn([p for p in pieces if p not in self.lengths])
        size = self.lengths.__getitem__
        return [sum(map(size, part)) for part in cut]


def _balanced(rows: Iterator[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, str]]]:
    """Sections of texts in batches of about ``limit`` characters."""
    run: list[tuple[int, str]] = []
    held = 0
    for i, text in rows:
        for part in sections(text, limit):
            run.append((i, part))
            held += len(part)
            if held >= limit:
                yield run
                run, held = [], 0
    if run:
        yield run


_COUNTERS: dict[tuple, Counter] = {}   # one for each worker process and tokenizer


def _counter(path: str, batch_bytes: int, table_size: int) -> Counter:
    key = (path, batch_bytes, table_size)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(*key)
    return _COUNTERS[key]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.
    ``tokenizer`` is the path of a byte-level BPE tokenizer file that every executor has."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, batch_bytes, table_size)
        for part in parts:
            ids, column = part.column(0).to_pylist(), part.column(1)
            n_bytes, n_tokens = [0] * len(ids), [0] * len(ids)

            def texts():
                for i, v in enumerate(column):
                    t = v.as_py() or ""
                    n_bytes[i] = len(t.encode())
                    yield i, t

            for batch in _balanced(texts(), batch_bytes):
                for (i, _), n in zip(batch, counter.count([t for _, t in batch]), strict=True):
                    n_tokens[i] += n
            yield pa.record_batch([pa.array(ids, pa.int64()), n_bytes, n_tokens, [n > limit for n in n_tokens]], schema=_OUT)

    narrow = docs.select(field(id_col).cast("bigint").alias("doc_id"), field(text_col).alias("text"))
    return map_arrow(narrow, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
