"""SentencePiece encoding and decoding: N best segmentations of whole texts.

A text is a lattice of the model's pieces.  A forward Viterbi pass gives the best score
of every prefix; those scores are exact heuristics for a backward A* search, which
therefore completes segmentations in the order of their scores and expands little more
than the N best paths.  The edges of very long lattices are not kept but looked up again,
so that these need one number for each character.

No piece crosses from a non-space to a space, nor from letters to most marks (in general,
between characters that no chain of pieces joins), so the lattice falls apart there into
chunks, most of them a word with the spaces before it.  Chunks repeat, so each distinct chunk is searched once for as long
as it stays in the worker's table.  The N best of a text combine the N best of its
chunks: only the N - 1 chunks with the smallest loss from best to second can differ
from their best in them.

Scores are the model's.  Models trained by merging (BPE) hold no scores but merge ranks
0, -1, -2, ...; the piece of rank r then scores -log(r + 10), the law of Zipf, so that a
whole word beats its parts.  A character in no piece scores 10 less than the lowest
piece and is encoded as its UTF-8 bytes (byte fallback); the model must have all 256
byte pieces.  Nothing is normalised: a space is put before the text, the pieces' spaces
are the text's, and decoding restores every text exactly, including leading spaces,
line feeds and a literal lower one eighth block.

Defined results: a null or empty text has one segmentation without pieces, score 0.
Equal scores are ordered by the search, alike on every run.  Fewer than N segmentations
exist for short texts.  Repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import insort
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_arrow, whole_row

N_BEST = 2
TABLE_BYTES = 224 << 20          # of the table of searched chunks in each worker
BATCH_CHARS = 1 << 20
UNKNOWN_LOSS = 10.0
EDGES_KEPT = 10_000
_NEVER = -math.inf

Paths = list[tuple[float, bytes]]   # (score, ids as packed int32), best first


def _trie(pieces: dict[str, float]) -> dict:
    """{character: (score of the piece that ends here or None, the same for what follows)}"""
    root: dict = {}
    for piece in sorted(pieces):        # a prefix comes before what it begins
        level = root
        for c in piece[:-1]:
            level = level.setdefault(c, (None, {}))[1]
        kids = level[piece[-1]][1] if piece[-1] in level else {}
        level[piece[-1]] = (pieces[piece], kids)
    return root


def _chunk_pattern(pieces: Iterable[str]) -> str:
    """Spaces, then a run of characters that pieces may join.  Characters that occur in one
    piece belong together, and so on; no piece holds characters of two such groups."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while above.setdefault(c, c) != c:
            above[c] = above[above[c]]
            c = above[c]
        return c

    for p in pieces:
        p = p.lstrip(" ")
        for c in p[1:]:
            above[top(c)] = top(p[0])
    groups: dict[str, list[str]] = {}
    for p in pieces:
        if len(p.lstrip(" ")) > 1:
            groups.setdefault(top(p.lstrip(" ")[0]), [])
    for c in sorted(above):
        if top(c) in groups:
            groups[top(c)].append(c)
    runs = [" *[" + "".join(map(re.escape, g)) + "]+" for g in sorted(groups.values(), key=len, reverse=True)]
    return "(?s:" + "|".join([*runs, " *[^ ]", " +"]) + ")"


_UNKNOWN: tuple = (None, None)


class _Nothing:
    """Takes edges that are not kept."""

    def append(self, edge: tuple[int, float]) -> None:
        pass


class Decoder:
    """What each id of a model decodes to, in one buffer; a few hundred kilobytes."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        out = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                out.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                out.append(b"")
            else:
                out.append(model.id_to_piece(i).replace("▁", " ").encode())
        self.lengths = np.array([len(x) for x in out], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.buffer = np.frombuffer(b"".join(out), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation (without the space put before it)."""
        if not len(ids):
            return ""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.begins[ids] - (ends - n), n)
        return self.buffer[at].tobytes().decode()[1:]


class Lattice:
    """Pieces of one model and the search over them."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                                or model.is_unused(i))]
        score = {i: model.get_score(i) for i in plain}
        if all(s <= 0 and s == int(s) for s in score.values()):      # merge ranks, in the order of the ids
            score = {i: -math.log(rank + 10) for rank, i in enumerate(sorted(plain))}
        self.unknown = min(score.values()) - UNKNOWN_LOSS
        text = {i: model.id_to_piece(i).replace("▁", " ") for i in plain}
        if any(" " in p.lstrip(" ") for p in text.values()):
            raise ValueError("a piece goes on after a space; chunks cannot be searched one by one")
        self.pieces: dict[str, float] = {text[i]: s for i, s in score.items()}
        self.ids: dict[str, bytes] = {text[i]: i.to_bytes(4, "little") for i in plain}
        self.longest = max(map(len, self.pieces))
        self.trie = _trie(self.pieces)
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.bytes = [byte_ids[b].to_bytes(4, "little") for b in range(256)]
        self.chunks = re.compile(_chunk_pattern(self.pieces))

    def forward(self, s: str) -> tuple[Sequence[float], list[list[tuple[int, float]]] | None]:
        """Best score of each prefix, and the edges (from, score) into each position; of
        texts beyond EDGES_KEPT characters the edges are not kept."""
        n, trie, longest, unknown = len(s), self.trie, self.longest, self.unknown
        keep = n <= EDGES_KEPT
        best = [_NEVER] * (n + 1) if keep else array("d", [_NEVER]) * (n + 1)
        into = [[] for _ in range(n + 1)] if keep else [_Nothing()] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b, j = best[i], i + 1
            score, level = trie.get(s[i], _UNKNOWN)
            if score is None:               # the character itself is no piece
                score = unknown
            if b + score > best[j]:
                best[j] = b + score
            into[j].append((i, score))
            if level:
                for c in s[j:i + longest]:
                    node = level.get(c)
                    if node is None:
                        break
                    score, level = node
                    j += 1
                    if score is not None:
                        if b + score > best[j]:
                            best[j] = b + score
                        into[j].append((i, score))
        return best, into if keep else None

    def edges_into(self, s: str, i: int) -> list[tuple[int, float]]:
        """The edges into one position, looked up."""
        found = [(j, self.pieces[s[j:i]]) for j in range(max(0, i - self.longest), i) if s[j:i] in self.pieces]
        return found if found and found[-1][0] == i - 1 else [*found, (i - 1, self.unknown)]

    def search(self, s: str, n_best: int) -> Paths:
        """The ``n_best`` best segmentations of ``s``.  Every open path ends in at least one
        segmentation with exactly its estimate, so no more open paths are kept than
        segmentations are still wanted."""
        best, into = self.forward(s)
        # (-(score so far + best of the rest), order, position, score so far, (piece, what follows))
        queue: list[tuple] = [(-best[len(s)], 0, len(s), 0.0, None)]
        order, out = 0, []
        wanted = n_best
        while queue:
            _, _, i, so_far, path = queue.pop(0)
            if not i:
                ids = []
                while path:
                    piece, path = path
                    ids.append(self.ids.get(piece) or b"".join([self.bytes[b] for b in piece.encode()]))
                out.append((so_far, b"".join(ids)))
                wanted -= 1
                del queue[wanted:]
                continue
            worst = queue[-1][0] if len(queue) >= wanted else math.inf
            for j, score in into[i] if into is not None else self.edges_into(s, i):
                cost = so_far + score
                f = -(cost + best[j])
                if f < worst:
                    order += 1
                    insort(queue, (f, order, j, cost, (s[j:i], path)))
                    if len(queue) >= wanted:
                        del queue[wanted:]
                        worst = queue[-1][0]
        return out


Chunk = tuple[float, bytes, float]   # best score, its ids, what the second best loses


def combine(chunks: Sequence[Chunk], n_best: int, paths_of: Callable[[int], Paths]
            ) -> list[tuple[float, list[tuple[int, bytes]]]]:
    """N best texts from the N best of each chunk: (loss, [(chunk, ids of its choice)]), the
    choices that differ from the best.  Only the chunks that lose least are asked for their
    paths."""
    losses = [c[2] for c in chunks]
    out: list[tuple[float, list[tuple[int, bytes]]]] = [(0.0, [])]
    if n_best == 2:      # the same, found faster
        least = [losses.index(min(losses))]
    else:
        least = heapq.nsmallest(n_best - 1, range(len(chunks)), key=losses.__getitem__)
    for k in least:
        paths = paths_of(k)
        more = [(loss + paths[0][0] - p[0], [*choice, (k, p[1])] if i else choice)
                for loss, choice in out for i, p in enumerate(paths)]
        out = heapq.nsmallest(n_best, more, key=lambda x: x[0])
    return out


class Table(dict):
    """Chunks that were searched; a missing one is searched when it is asked for.  ``held``
    estimates the bytes of the entries, objects included.  The paths themselves are not kept:
    a text needs those of few chunks, which are searched again."""

    def __init__(self, lattice: Lattice, n_best: int):
        super().__init__()
        self.lattice, self.n_best, self.held = lattice, n_best, 0

    def __missing__(self, chunk: str) -> Chunk:
        paths = self.lattice.search(chunk, self.n_best)
        found = (*paths[0], paths[0][0] - paths[1][0] if len(paths) > 1 else math.inf)
        if len(chunk) <= 64:      # longer ones hardly come again
            self[chunk] = found
            self.held += 330 + len(chunk) + len(found[1])
        return found

    def clear(self) -> None:
        super().clear()
        self.held = 0


class Encoder:
    def __init__(self, path: str, n_best: int = N_BEST, table_bytes: int = TABLE_BYTES):
        self.lattice, self.n_best, self.table_bytes = Lattice(path), n_best, table_bytes
        self.table = Table(self.lattice, n_best)

    def encode(self, text: str) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the N best segmentations, best first."""
        if not text:
            return [(0.0, np.zeros(0, dtype=np.int32))]
        if self.table.held > self.table_bytes:
            self.table.clear()
        parts = self.lattice.chunks.findall(" " + text)
        chunks = list(map(self.table.__getitem__, parts))
        ids = [c[1] for c in chunks]
        score = math.fsum([c[0] for c in chunks])
        out = []
        for loss, choice in combine(chunks, self.n_best, lambda k: self.lattice.search(parts[k], self.n_best)):
            for k, other in choice:
                ids[k] = other
            out.append((score - loss, np.frombuffer(b"".join(ids), dtype="<i4")))
            for k, _ in choice:
                ids[k] = chunks[k][1]
        return out


_ENCODERS: dict[tuple, Encoder] = {}   # one for each worker process and model
_DECODERS: dict[str, Decoder] = {}


def _encoder(path: str, n_best: int = N_BEST, table_bytes: int = TABLE_BYTES) -> Encoder:
    key = (path, n_best, table_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _lists(rows: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", n_best: int = N_BEST,
                  table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(row, text, scores, segmentations): all columns of ``docs`` as a struct, the text,
    and the scores and piece ids of its N best segmentations, best first."""
    narrow = docs.select(whole_row(docs.drop(text_col)).alias("row") if len(docs.columns) > 1 else
                         whole_row(docs).alias("row"), field(text_col).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, n_best, table_bytes)
        for part in parts:
            begin = held = 0
            found: list[list[tuple[float, np.ndarray]]] = []
            for i, v in enumerate(part.column(1)):
                text = v.as_py() or ""
                found.append(encoder.encode(text))
                held += len(text)
                if held >= BATCH_CHARS or i == part.num_rows - 1:
                    rows = part.slice(begin, i + 1 - begin)
                    ends = np.cumsum([0, *map(len, found)])
                    flat = [p for f in found for p in f]
                    scores = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([s for s, _ in flat], pa.float64()))
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _lists([x for _, x in flat]))
                    yield pa.record_batch([*rows.columns, scores, ids],
                                          names=["row", "text", "scores", "segmentations"])
                    begin, held, found = i + 1, 0, []

    schema = T.StructType([*narrow.schema.fields,
                           T.StructField("scores", T.ArrayType(T.DoubleType())),
                           T.StructField("segmentations", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return map_arrow(narrow, run, schema)


def decode_pieces(coded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of its array of piece ids (null for null) in ``out_col``; a
    column that has this name already is replaced."""
    if out_col in coded.columns:
        coded = coded.select(*[field(c) if c != out_col else field(c).alias("_replaced") for c in coded.columns])
        ids_col = "_replaced" if ids_col == out_col else ids_col
        return decode_pieces(coded, model, ids_col, out_col).drop("_replaced")
    at = coded.columns.index(ids_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _DECODERS:
            _DECODERS[model] = Decoder(model)
        decoder = _DECODERS[model]
        for part in parts:
            column = part.column(at)
            texts = [decoder.decode(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None for v in column]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return map_arrow(coded, run, T.StructType([*coded.schema.fields, T.StructField(out_col, T.StringType())]))
