"""Language-model scores by a hidden Markov model over all training documents.

The model emits symbols: the end of a text, each of the `TOP` most frequent training words,
and `BUCKETS` classes that the other words are hashed into.  A word of a class has its share
of the class by smoothed counts, so the words' probabilities need the counts of all words,
which stay a distributed table; the model itself has a fixed size and is what is broadcast.

Baum-Welch: every task runs the scaled forward and backward recursions over its training
texts and adds up expected counts by symbol; Spark sums them across tasks, in each of
`ROUNDS` rounds over all training texts.  Scores come from the scaled forward recursion over
whole texts, in double precision, many texts side by side.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.scratch import stored

STATES, ROUNDS, TOP, BUCKETS, SEED = 8, 4, 32_768, 4_096, 42
#: Steps whose forward states are held at once; before them only one state for each such stretch.
STRETCH = 1024
#: Tokens whose recursions run side by side, and weight of the prior on emissions.
TOGETHER, PRIOR = 1_000_000, 20.0
STICKY = 0.95
#: The end of a text as a 16-bit symbol.
END = b"\0\0"


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def word_counts(rows: DataFrame) -> DataFrame:
    """`(word, n)` over the texts, words in UTF-8, A-Z lower-cased, between ASCII white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for body in batch.column(0):
                found.update(body.as_py().lower().split())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["word", "n"])

    return rows.select("body").mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


class Vocabulary:
    """Symbols of fixed number: 0 the end, then the top words, then the classes."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int, tokens: int,
                 distinct: int, class_mass: np.ndarray) -> None:
        self.words = words
        self.tokens = tokens
        self.total = tokens + 0.5 * (distinct + 1)
        self.first_class = 1 + len(words)
        self.classes = len(class_mass)
        self.counts = np.array([ends, *counts], np.float64)
        mass = np.concatenate([self.counts + 0.5, class_mass + 0.5])
        self.log_mass = np.log10(mass / self.total)
        self.share = mass / mass.sum()


def learn_vocabulary(rows: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The symbols, and the table `(word, n)` of all training words."""
    training = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(training), "word-counts")
    ends = training.count()
    total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # TOP rows at most.
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).toArrow()
    words, ns = top.column("word").to_pylist(), top.column("n").to_pylist()
    last = (ns[-1], words[-1]) if words else (0, b"")
    rare = counts.filter(
        (F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > F.lit(last[1]))))
    mass = rare.groupBy((F.crc32("word") % BUCKETS).alias("class")).agg(
        F.sum(F.col("n") + 0.5).alias("mass")).collect()
    class_mass = np.zeros(BUCKETS)
    for row in mass:
        class_mass[row["class"]] = row["mass"]
    vocabulary = Vocabulary(
        words, ns, ends, total[1] + ends, total[0] + (ends > 0), class_mass)
    return vocabulary, counts


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row for each text: `key, id, held_out, symbols, rare, times`.

    `symbols` are 16-bit numbers, the end included; `rare` are the text's words outside the
    top words and `times` how often each occurs.  `key` tells the rows apart.
    """
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary.words)
    first, classes = vocabulary.first_class, vocabulary.classes

    def run(batches):
        symbol = {w: n + 1 for n, w in enumerate(sent.value)}
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                symbols, rare, times = [], [], []
                for body in some.column(2):
                    words = body.as_py().lower().split()
                    found = np.fromiter(
                        map(symbol.get, words, repeat(0)), "<u2", len(words))
                    at = np.flatnonzero(found == 0)
                    others = [words[i] for i in at.tolist()]
                    found[at] = [first + zlib.crc32(word) % classes for word in others]
                    unknown = Counter(others)
                    symbols.append(found.tobytes() + END)
                    rare.append(list(unknown))
                    times.append(list(unknown.values()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + some.num_rows)), some.column(0),
                     some.column(1), pa.array(symbols, pa.binary()),
                     pa.array(rare, pa.list_(pa.binary())),
                     pa.array(times, pa.list_(pa.int64()))],
                    names=["key", "id", "held_out", "symbols", "rare", "times"])
                key += some.num_rows

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "body").mapInArrow(
        run, f"key long, id {kind}, held_out boolean, symbols binary, rare array<binary>, "
             "times array<long>")


class Abreast:
    """Sequences side by side, longest first: what is at one place in each lies together."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        ranks = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.symbols = np.empty(sizes.sum(), np.int64)
        if len(sequences):
            self.symbols[self.starts[places] + ranks] = np.concatenate(
                [sequences[i] for i in self.order])
        self.longest = longest


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(share: np.ndarray, states: int = STATES) -> Hmm:
        """States that stay, each with its own disturbance of the symbols' shares."""
        noise = np.random.default_rng(SEED).gamma(2.0, 0.5, (len(share), states))
        emit = share[:, None] * (0.1 + noise)
        move = np.full((states, states), (1 - STICKY) / max(1, states - 1))
        np.fill_diagonal(move, STICKY if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probabilities, by the scaled forward recursion."""
        side = Abreast(sequences)
        total = np.zeros(len(sequences))
        alpha = None
        for t in range(side.longest):
            n = side.active[t]
            here = self.emit[side.symbols[side.starts[t]:side.starts[t] + n]]
            alpha = here * (self.start if alpha is None else alpha[:n] @ self.move)
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        answer = np.empty(len(sequences))
        answer[side.order] = total
        return answer

    def expected(self, sequences: list[np.ndarray], emitted: np.ndarray, moved: np.ndarray,
                 started: np.ndarray) -> None:
        """Adds the expected counts of the whole sequences, by forward and backward recursion.

        The forward states are held for one stretch at a time: a first pass keeps those with
        which a sequence enters each stretch, and the way back computes the others again.
        """
        side = Abreast(sequences)
        if not side.longest:
            return
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        start = self.start.astype(np.float32)

        def forward(first, last, before, most):
            for t in range(first, last):
                n = min(most, side.active[t])
                begin = side.starts[t]
                now = emit[side.symbols[begin:begin + n]] * (
                    start if before is None else before[:n] @ move)
                scale = now.sum(axis=1)
                now /= scale[:, None]
                before = now
                yield t, now, scale

        edges = [*range(0, side.longest, STRETCH), side.longest]
        entering = [None]
        for first, last in zip(edges, edges[1:-1]):
            state = entering[-1]
            for _, state, _ in forward(first, last, state, side.active[last]):
                pass
            entering.append(state)
        back = None
        for first, last, before in reversed(list(zip(edges, edges[1:], entering))):
            base = side.starts[first]
            symbols = side.symbols[base:side.starts[last]]
            here = emit[symbols]
            alpha, scale = np.empty_like(here), np.empty(len(here), np.float32)
            for t, now, total in forward(first, last, before, side.active[first]):
                at = slice(side.starts[t] - base, side.starts[t + 1] - base)
                alpha[at], scale[at] = now, total
            gamma = alpha.copy()
            for t in range(last - 1, first - 1, -1):
                at = slice(side.starts[t] - base, side.starts[t + 1] - base)
                beta = np.ones((side.active[t], move.shape[0]), np.float32)
                if back is not None:
                    beta[:len(back)] = back @ move.T
                    moved += (alpha[at][:len(back)].T @ back) * move
                gamma[at] *= beta
                back = here[at] * beta / scale[at][:, None]
            for state in range(move.shape[0]):
                emitted[:, state] += np.bincount(
                    symbols, weights=gamma[:, state], minlength=len(emit))
        started += gamma[:side.active[0]].sum(axis=0)


def _groups(
    batches: Iterator[pa.RecordBatch], column: str,
) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, about TOGETHER tokens each, with their symbol sequences."""
    for batch in batches:
        bodies = batch.column(batch.schema.get_field_index(column))
        first, sequences, held = 0, [], 0
        for at, body in enumerate(bodies, 1):
            symbols = np.frombuffer(body.as_buffer(), "<u2")
            sequences.append(symbols)
            held += len(symbols)
            if held >= TOGETHER or at == len(bodies):
                yield batch.slice(first, at - first), sequences
                first, sequences, held = at, [], 0


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The symbol sequences of all batches, about TOGETHER tokens each; those longer than a
    stretch lie with their like, so that few recursions are long."""
    pools: tuple[list, list] = ([], [])
    held = [0, 0]
    for batch in batches:
        for body in batch.column(0):
            symbols = np.frombuffer(body.as_buffer(), "<u2").copy()
            kind = int(len(symbols) > STRETCH)
            pools[kind].append(symbols)
            held[kind] += len(symbols)
            if held[kind] >= TOGETHER:
                yield pools[kind]
                pools[kind].clear()
                held[kind] = 0
    yield from pools


def baum_welch(texts: DataFrame, share: np.ndarray, rounds: int = ROUNDS,
               states: int = STATES) -> Hmm:
    """The model after `rounds` rounds over the training texts of `encoded`."""
    training = texts.filter(~F.col("held_out")).select("symbols")
    context = texts.sparkSession.sparkContext
    columns = [f"s{k}" for k in range(states)]
    size = len(share)
    model = Hmm.first(share, states)

    for _ in range(rounds):
        sent = context.broadcast(model)

        def count(batches, sent=sent):
            emitted = np.zeros((size, states))
            moved, started = np.zeros((states, states)), np.zeros(states)
            for sequences in _pools(batches):
                sent.value.expected(sequences, emitted, moved, started)
            seen = np.flatnonzero(emitted.sum(axis=1))
            numbers = np.concatenate([seen, np.arange(size, size + states + 1)])
            values = np.vstack([emitted[seen], moved, started[None, :]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers.astype(np.int32)), *map(pa.array, values.T.copy())],
                names=["at", *columns])

        told = training.mapInArrow(
            count, "at int, " + ", ".join(f"{c} double" for c in columns),
        ).groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        sums = np.zeros((size + states + 1, states))
        sums[told.column("at").to_numpy()] = np.stack(
            [told.column(c).to_numpy() for c in columns], axis=1) if told.num_rows else 0
        emitted, moved, started = sums[:size], sums[size:size + states], sums[-1]
        emit = emitted + PRIOR * share[:, None]
        move = moved + 1e-3
        start = started + 1e-3
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True),
                    emit / emit.sum(axis=0))
        sent.unpersist()
    return model


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)` for every row.

    Training texts are those whose crc32(id) mod 5 is not 1, null ids included.  A null or
    empty text is its end token.  `base_score` is the smoothed unigram log10 probability,
    `score` the model's.  Repeated rows train and are scored each for itself; an empty table
    gives no rows; other columns are not looked at.  Without training texts every token has
    base probability 1 and the model is uniform.
    """
    rows = _rows(docs, id_col, text_col)
    vocabulary, counts = learn_vocabulary(rows)
    texts = stored(encoded(rows, vocabulary), "symbol-texts")
    model = baum_welch(texts, vocabulary.share, rounds, states)
    sent = texts.sparkSession.sparkContext.broadcast(
        (model, vocabulary.log_mass, vocabulary.counts > 0, vocabulary.first_class))

    def score(batches):
        model, log_mass, seen, first = sent.value
        for some, sequences in _groups(batches, "symbols"):
            found = model.log10_likelihood(sequences)
            top = [s < first for s in sequences]
            columns = [
                np.array([len(s) for s in sequences], np.int64),
                np.array([int(seen[s[t]].sum()) for s, t in zip(sequences, top)], np.int64),
                np.array([log_mass[s[t]].sum() for s, t in zip(sequences, top)]),
                np.array([log_mass[s[~t]].sum() for s, t in zip(sequences, top)]),
                found,
            ]
            yield pa.RecordBatch.from_arrays(
                [*some.columns[:3], *map(pa.array, columns)],
                names=["key", "id", "held_out", "n_tokens", "top_known", "top_base",
                       "class_base", "hmm"])

    kind = rows.schema["id"].dataType.simpleString()
    by_text = texts.select("key", "id", "held_out", "symbols").mapInArrow(
        score, f"key long, id {kind}, held_out boolean, n_tokens long, top_known long, "
               "top_base double, class_base double, hmm double")
    rare = (
        texts.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r"))
        .select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
        .join(counts, "word", "left")
        .groupBy("key").agg(
            F.sum(F.col("times") * F.log10(
                (F.coalesce("n", F.lit(0)) + 0.5) / vocabulary.total)).alias("rare_base"),
            F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"))
    )
    zero = F.lit(0)
    return by_text.join(rare, "key", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("top_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("top_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("hmm") + F.coalesce("rare_base", F.lit(0.0)) - F.col("class_base"))
        .alias("score"))
