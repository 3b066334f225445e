"""Hierarchical multi-length packing of documents into token sequences.

Every input partition is packed for itself, so nothing is shuffled, and buffer by buffer of
`buffer` tokens, so memory is bounded whatever a partition holds.  In a buffer:

1. a document of `top` tokens or more gives whole top windows, its rest is routed on;
2. a piece is routed to the smallest tier (256, 512, 1024, 2048 tokens) that holds it;
3. each tier is packed longest first, a piece into the fullest open window that takes it;
4. gaps are filled from the shorter tiers, longest window first: with the longest piece that
   fits, at last with a cut off a longer one;
5. what no window takes becomes sequences of a power of two, which need no padding;
6. finished sequences are dealt, longest first, to the step group with the fewest tokens.

The packing of a partition depends on its rows and their order alone, so a task that is run
again after a lost executor gives the same sequences.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wordloom.llm.bpe import WORDS, byte_letters

TOP = 2048
TIERS = (256, 512, 1024, 2048)
BUFFER = 1 << 20
STEP = 1 << 16
END = 1
#: Sequence ids of a partition start here times its number.
IDS_OF_PARTITION = 1 << 36

_loaded: dict[str, tiktoken.Encoding] = {}


def load_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a `tokenizer.json` file, read once by each worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in t): i
            for t, i in told["model"]["vocab"].items() if t not in special}
        _loaded[path] = tiktoken.Encoding(
            "public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    return _loaded[path]


class Piece:
    """`length` tokens of document `doc` of the buffer, from `start` on."""

    __slots__ = ("doc", "length", "start")

    def __init__(self, doc: int, start: int, length: int) -> None:
        self.doc, self.start, self.length = doc, start, length

    def key(self) -> tuple[int, int, int]:
        return self.length, self.doc, self.start


class Pool:
    """Pieces by length, smallest first."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = sorted(pieces, key=Piece.key)
        self.lengths = [p.length for p in self.pieces]

    def __len__(self) -> int:
        return len(self.pieces)

    def pop(self, at: int) -> Piece:
        del self.lengths[at]
        return self.pieces.pop(at)

    def longest_up_to(self, length: int) -> int:
        return bisect_right(self.lengths, length) - 1

    def cut(self, length: int) -> Piece:
        """The first `length` tokens of the longest piece, which is longer than that."""
        whole = self.pop(len(self) - 1)
        rest = Piece(whole.doc, whole.start + length, whole.length - length)
        at = bisect_left(self.lengths, rest.length)
        self.pieces.insert(at, rest)
        self.lengths.insert(at, rest.length)
        return Piece(whole.doc, whole.start, length)


def _windows(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Best fit, longest first, into windows of `size` tokens."""
    open_gaps: list[tuple[int, int]] = []
    windows: list[list[Piece]] = []
    for piece in sorted(pieces, key=Piece.key, reverse=True):
        at = bisect_left(open_gaps, (piece.length, -1))
        if at < len(open_gaps):
            gap, window = open_gaps.pop(at)
        else:
            gap, window = size, len(windows)
            windows.append([])
        windows[window].append(piece)
        if gap > piece.length:
            insort(open_gaps, (gap - piece.length, window))
    return windows


def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces, in order, as sequences of a power of two up to the top size."""
    left = sum(p.length for p in pieces)
    queue = [Piece(*(p.doc, p.start, p.length)) for p in pieces]
    at = 0
    while left:
        room = min(TOP, 1 << (left.bit_length() - 1))
        left -= room
        sequence = []
        while room:
            piece = queue[at]
            take = min(room, piece.length)
            sequence.append(Piece(piece.doc, piece.start, take))
            piece.start += take
            piece.length -= take
            room -= take
            at += not piece.length
        yield sequence


def pack(lengths: list[int]) -> list[list[Piece]]:
    """Sequences of a buffer's documents: each of `TOP` tokens or of a power of two."""
    tiers: dict[int, list[Piece]] = {size: [] for size in TIERS}
    sequences: list[list[Piece]] = []
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= TOP:
            sequences.append([Piece(doc, start, TOP)])
            start += TOP
        if length > start:
            tier = next(size for size in TIERS if length - start <= size)
            tiers[tier].append(Piece(doc, start, length - start))
    left: list[Piece] = []
    for at in range(len(TIERS) - 1, -1, -1):
        size = TIERS[at]
        shorter = Pool([p for t in TIERS[:at] for p in tiers[t]])
        for window in _windows(tiers[size], size):
            gap = size - sum(p.length for p in window)
            while gap and len(shorter):
                fit = shorter.longest_up_to(gap)
                window.append(shorter.pop(fit) if fit >= 0 else shorter.cut(gap))
                gap -= window[-1].length
            if gap:
                left += window
            else:
                sequences.append(window)
        for t in TIERS[:at]:
            tiers[t] = []
        for piece in shorter.pieces:
            tiers[next(t for t in TIERS if piece.length <= t)].append(piece)
    left.sort(key=lambda p: (p.doc, p.start))
    sequences.extend(_powers(left))
    return sequences


def steps(sizes: list[int], step: int = STEP) -> list[int]:
    """The step group of each sequence; groups get nearly equal numbers of tokens."""
    groups = max(1, -(-sum(sizes) // step))
    loads = [(0, g) for g in range(groups)]
    chosen = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, group = loads.pop(0)
        chosen[at] = group
        insort(loads, (load + sizes[at], group))
    return chosen


_FIELDS = (
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("tier", pa.int32()), ("step_id", pa.int64()), ("ids", pa.list_(pa.int32())),
)


def packed(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    buffer: int = BUFFER, with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier, step_id` and, if asked for, the piece's `ids`.

    A document's ids are those of its whole text and an end token; a null or empty text has
    the end token alone.  `start` counts the document's tokens before the piece, `offset`
    the sequence's.  `tier` is the sequence's length: 2048 or a smaller power of two, so no
    sequence is padded.  Repeated rows are packed each for itself; ids may be null; an empty
    table gives no rows; other columns are not looked at.
    """
    fields = _FIELDS if with_ids else _FIELDS[:-1]

    def flush(names, bodies, ids_type, state) -> Iterator[pa.RecordBatch]:
        sequences = pack([len(b) for b in bodies])
        groups = steps([sum(p.length for p in s) for s in sequences])
        columns: list[list] = [[] for _ in range(len(fields) + 1)]
        for number, (sequence, group) in enumerate(zip(sequences, groups)):
            offset, size = 0, sum(p.length for p in sequence)
            for p in sequence:
                ids = bodies[p.doc][p.start:p.start + p.length]
                row = (names[p.doc], p.start, p.length, zlib.crc32(ids), len(bodies[p.doc]),
                       state["sequence"] + number, offset, size, state["step"] + group, ids)
                for column, value in zip(columns, row):
                    column.append(value)
                offset += p.length
        state["sequence"] += len(sequences)
        state["step"] += max(groups, default=-1) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], ids_type),
             *(pa.array(c, kind) for c, (_, kind) in zip(columns[1:], fields))],
            names=[id_col, *(name for name, _ in fields)])

    def run(batches):
        encoding = load_encoding(vocabulary)
        first = TaskContext.get().partitionId() * IDS_OF_PARTITION
        state = {"sequence": first, "step": first}
        names: list = []
        bodies: list[np.ndarray] = []
        held, ids_type = 0, None
        for batch in batches:
            ids_type = batch.column(0).type
            for name, text in zip(batch.column(0), batch.column(1)):
                ids = encoding.encode_to_numpy(text.as_py() or "", allowed_special="all")
                bodies.append(np.append(ids, END).astype("<u4"))
                names.append(name.as_py())
                held += len(bodies[-1])
                if held >= buffer:
                    yield from flush(names, bodies, ids_type, state)
                    names, bodies, held = [], [], 0
        if bodies:
            yield from flush(names, bodies, ids_type, state)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int32()): "array<int>"}
    kind = docs.schema[id_col].dataType.simpleString()
    told = ", ".join(f"{name} {kinds[arrow]}" for name, arrow in fields)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {told}")
