"""Byte-level BPE: encoding and decoding with a public vocabulary.

A word's part boundaries and the merge ranks of adjacent parts lie in two short arrays;
the smallest rank is found by a scan, its boundary deleted and the two neighbouring ranks
looked up anew.  A word of more than `LONG` bytes keeps its ranks in a heap instead, as
scans would be quadratic.  Texts are cut where a single space parts two words: no word
of the vocabulary's pattern crosses that point, so each piece is encoded once and kept.
The caches are bounded and live as long as a Python worker.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

# Fixed value: the pattern that the public byte-level vocabulary is used with.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 40
SHIFT = 32
LONG = 256
PIECES, WORD_IDS = 400_000, 200_000
# From here on Unicode versions differ in what a letter is; the public library decides.
NEWER = "\u0500"

NO_IDS = np.array([], np.int32)
_RUN_OF_SPACE = re.compile(r"\s\s")
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, Vocabulary] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by its public rule:
    printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bounded(dict):
    """A cache of two generations: when the young one is full, it replaces the old one."""

    def __init__(self, make, size: int) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) > LONG:
            return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Vocabulary:
    """The merges, ids and special tokens of a `tokenizer.json` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, letters = told["model"], byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.ids = {
            raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.single = [self.ids.get(bytes([b])) for b in range(256)]
        # The rank of a merge by the ids of its two parts, and the id it makes by its rank.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.ranks.setdefault(
                self.ids[left] << SHIFT | self.ids[right], len(self.made))
            self.made.append(self.ids[left + right])
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.words = regex.compile(WORDS)
        self.specials = re.compile("(%s)" % "|".join(
            map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.library_words = pre_tokenizers.ByteLevel(add_prefix_space=False)
        # Tokens that the merges of their own bytes lead to.
        self.whole = {
            t: _packed([i]) for t, i in self.ids.items()
            if len(t) <= LONG and len(self._scan(t)) == 1}
        self.word_ids = Bounded(self.merge, WORD_IDS)
        self.after_space = Bounded(self._after_space, PIECES)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """The vocabulary of a file, read once by each Python worker."""
        if path not in _loaded:
            _loaded[path] = Vocabulary(path)
        return _loaded[path]

    def merge(self, letters: str) -> bytes:
        """Ids of one word, packed."""
        word = letters.encode()
        whole = self.whole.get(word)
        if whole is not None:
            return whole
        return _packed(self._scan(word) if len(word) <= LONG else self._heap(word))

    def _scan(self, word: bytes) -> list[int]:
        """Ids of a short word: `parts` are those between its boundaries, `ranks` the merge
        ranks of adjacent parts; a merge deletes a boundary and renews two ranks at most."""
        known, made = self.ranks.get, self.made
        parts = [self.single[b] for b in word]
        ranks = [known(a << SHIFT | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = whole = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = known(whole << SHIFT | parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = known(parts[i - 1] << SHIFT | whole, NEVER)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        """Ids of a long word: the same merges, the least rank taken from a heap."""
        size = len(word)
        parts = [self.single[b] for b in word]
        ends = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and ends[a] and ends[a] < size:
                b = ends[a]
                found = self.ranks.get(parts[a] << SHIFT | parts[b])
                if found is not None:
                    heapq.heappush(heap, (found, a, b, ends[b]))

        for a in range(size - 1):
            offer(a)
        while heap:
            rank, a, b, end = heapq.heappop(heap)
            if ends[a] != b or ends[b] != end:
                continue
            parts[a], ends[a], ends[b] = self.made[rank], end, 0
            if end < size:
                before[end] = a
            offer(before[a])
            offer(a)
        ids, a = [], 0
        while a < size:
            ids.append(parts[a])
            a = ends[a]
        return ids

    def _piece(self, piece: str, lead: str = "") -> bytes:
        """Ids of a piece after `lead`, which is empty or a space."""
        if piece.isascii() or max(piece) < NEWER:
            if piece.isalpha():
                return self.word_ids[lead + piece]
            if piece[-1] in ",." and piece[:-1].isalpha():
                return self.word_ids[lead + piece[:-1]] + self.word_ids[piece[-1]]
            words = self.words.findall(lead + piece)
        else:
            whole = lead + piece
            words = [whole[a:b] for _, (a, b) in self.library_words.pre_tokenize_str(whole)]
        return b"".join(map(self.word_ids.__getitem__, words))

    def _after_space(self, piece: str) -> bytes:
        return self._piece(piece, " ") if piece else self.word_ids[" "]

    def _plain(self, text: str) -> bytes:
        if _RUN_OF_SPACE.search(text):
            pieces = _BETWEEN_WORDS.split(text)
        else:
            pieces = text.split(" ")
        first = self._piece(pieces[0]) if pieces[0] else b""
        return first + b"".join(map(self.after_space.__getitem__, islice(pieces, 1, None)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the string of a special token gives that token."""
        found = [
            _packed([self.special[part]]) if part in self.special else self._plain(part)
            for part in (self.specials.split(text) if self.specials else [text]) if part]
        return np.frombuffer(b"".join(found), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that the ids of a few texts are held at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def encoded(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`(doc_id, ids)` for every row: the ids of the whole text; none for a null text.

    `vocabulary` is the path of a `tokenizer.json` file that every executor has.
    """
    def run(batches):
        known = Vocabulary.load(vocabulary)
        for batch in batches:
            for some in _batches(batch):
                ids = [known.encode(t.as_py() or "") for t in some.column(1)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate([NO_IDS, *ids])))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The rows of `tokens` with a column `text`: their ids as text, null for null ids."""
    names, at = [*tokens.columns, "text"], tokens.columns.index(ids_col)

    def run(batches):
        known = Vocabulary.load(vocabulary)
        for batch in batches:
            for some in _batches(batch):
                texts = [
                    known.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None
                    for ids in some.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(texts, pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{fields}, text string")


def round_trip(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256)` for every row of `docs`.

    A null or empty text has no tokens.  Repeated rows are encoded each for itself; an empty
    table gives no rows; other columns are not looked at.
    """
    rows = decoded(encoded(docs, vocabulary, id_col, text_col), vocabulary)
    return rows.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
