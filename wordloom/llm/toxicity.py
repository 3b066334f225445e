"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read a clause's words one after the other:

* insult and threat lexicons (learned stems, a short fixed list) write hits,
* the target transducer marks hits near a word that addresses or names someone,
* the negation transducer marks hits up to three words after a negation,
* the reported-speech transducer marks hits after a verb of saying.

They are composed into one machine whose table is built by following the product of their
states.  A clause that the machine matches counts for one pattern, such as "targeted insult"
or "reported threat"; a document's score is a logistic function of the logarithms of its
counts, with weights learned from labelled rows.  A word outside a matched clause counts
nothing.

The classifier is fitted on at most `SAMPLE` toxic and `SAMPLE` other labelled documents,
chosen by a hash of their ids; all documents are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.columns import fresh
from wordloom.scratch import stored

SAMPLE = 20_000
#: A stem is learned from at least so many toxic documents (or this share of them), of which
#: so many must hold it between different words, as copies of one document prove little; of
#: all documents that hold it, the share PURE must be toxic.  All such terms are taken: by the
#: share, at most 500 for each distinct term that a toxic text of the sample has on average.
LEAST_SUPPORT, LEAST_SHARE, LEAST_CONTEXTS, PURE = 5, 0.002, 5, 0.95
SHORTEST, LONGEST = 4, 12
#: The constant of a model without labelled rows of both kinds: nothing counts as toxic.
UNTAUGHT = -3.0
SCOPE = 3

# Fixed lists of words.
THREATS = frozenset(
    "kill murder destroy hurt hang burn töten umbringen vernichten tuer brûler détruire "
    "matar quemar destruir".split())
TARGETS = frozenset(
    "you your yours he she they them him her du dich dir ihr euch sie er tu toi te vous il "
    "elle ils usted ustedes tú ti él ella ellos".split())
NEGATIONS = frozenset(
    "not no never nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás "
    "ningún tampoco".split())
REPORTS = frozenset(
    "said says wrote called reported quoted sagte sagt schrieb nannte berichtete dit écrit "
    "appelé cité dijo dice escribió llamó".split())

CLAUSE_END = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"\w+")
SYMBOLS = ("other", "target", "negation", "report", "insult", "threat")
PATTERNS = tuple(product(("insult", "threat"), ("bare", "targeted"), ("", "negated"),
                         ("", "reported")))


@dataclass(frozen=True)
class Transducer:
    """A start state, and for each state and symbol the next state and the mark written."""

    start: int
    table: dict[tuple[int, str], tuple[int, str]]


def target_transducer() -> Transducer:
    """Marks hits after a target; the machine also turns a hit back when a target follows."""
    return Transducer(0, {
        (state, symbol): (1 if symbol == "target" else state, "targeted" if state else "bare")
        for state in (0, 1) for symbol in SYMBOLS})


def negation_transducer(scope: int = SCOPE) -> Transducer:
    """Marks hits up to `scope` words after a negation."""
    return Transducer(0, {
        (state, symbol): (
            scope if symbol == "negation" else max(0, state - 1), "negated" if state else "")
        for state in range(scope + 1) for symbol in SYMBOLS})


def report_transducer() -> Transducer:
    """Marks hits after a verb of saying."""
    return Transducer(0, {
        (state, symbol): (1 if symbol == "report" else state, "reported" if state else "")
        for state in (0, 1) for symbol in SYMBOLS})


def compose(parts: list[Transducer]) -> tuple[list[list[int]], list[list[tuple[str, ...]]]]:
    """The product machine: next states and marks by state and symbol, from state 0 on."""
    start = tuple(p.start for p in parts)
    number, queue = {start: 0}, [start]
    following, marks = [], []
    for states in queue:
        following.append([])
        marks.append([])
        for symbol in SYMBOLS:
            steps = [p.table[s, symbol] for p, s in zip(parts, states)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(queue)
                queue.append(after)
            following[-1].append(number[after])
            marks[-1].append(tuple(mark for _, mark in steps))
    return following, marks


class Grammar:
    """The composed machine with its lexicon; counts the patterns of a text's clauses."""

    def __init__(self, stems: list[str]) -> None:
        self.stems = [s for s in stems if s.endswith("*")]
        self.words = {s for s in stems if not s.endswith("*")}
        self.starts = {s[:-1] for s in self.stems}
        self.sizes = sorted({len(s) for s in self.starts})
        self.following, self.marks = compose(
            [target_transducer(), negation_transducer(), report_transducer()])
        self.number = {pattern: n for n, pattern in enumerate(PATTERNS)}
        self.finder = ahocorasick.Automaton()
        for term in self.words | self.starts | THREATS:
            self.finder.add_word(term, term)
        self.finder.make_automaton()

    def symbol(self, word: str) -> int:
        if word in self.words or any(word[:n] in self.starts for n in self.sizes):
            return 4
        if word in THREATS:
            return 5
        if word in NEGATIONS:
            return 2
        if word in REPORTS:
            return 3
        return 1 if word in TARGETS else 0

    def clause(self, text: str) -> int | None:
        """The number of the pattern that the clause matches; a threat goes before an insult."""
        state, hits, addressed = 0, [], False
        for word in WORD.findall(text):
            symbol = self.symbol(word)
            addressed |= symbol == 1
            if symbol >= 4:
                hits.append((symbol, self.marks[state][symbol]))
            state = self.following[state][symbol]
        if not hits:
            return None
        symbol, (_, negated, reported) = max(
            hits, key=lambda hit: (hit[0], hit[1][1] == "", hit[1][2] == ""))
        return self.number[
            SYMBOLS[symbol], "targeted" if addressed else "bare", negated, reported]

    def counts(self, text: str) -> np.ndarray:
        """How many clauses match each pattern; clauses without a lexicon string are not read."""
        found = np.zeros(len(PATTERNS))
        low = text.lower()
        done = 0
        for end, term in self.finder.iter(low) if len(self.finder) else ():
            start = end + 1 - len(term)
            if start < done or start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            opened = max(done, 1 + max(low.rfind(c, done, start) for c in ".!?;:\n"))
            closing = CLAUSE_END.search(low, end + 1)
            done = closing.end() if closing else len(low)
            pattern = self.clause(low[opened:done])
            if pattern is not None:
                found[pattern] += 1
        return found


@dataclass(frozen=True)
class Model:
    stems: tuple[str, ...]
    weights: tuple[float, ...]


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
           label_col: str, most: int = SAMPLE) -> DataFrame:
    """`(text, toxic)` of labelled documents that are not held out, at most `most` a label."""
    from pyspark.sql import Window

    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    # At most 2 * most rows of an id and a label.
    chosen = F.broadcast(stored(chosen.drop("n"), "labelled"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        chosen, "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def _between_different_words(rows: DataFrame, terms: set[str]) -> list[str]:
    """The terms that stand between enough different pairs of words."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = sent.value
        for batch in batches:
            held, contexts = [], []
            for text in batch.column(0):
                words = ["", *WORD.findall(text.as_py().lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    for n in range(SHORTEST, min(len(word), LONGEST + 1)):
                        if word[:n] + "*" in terms:
                            held.append(word[:n] + "*")
                            contexts.append(f"{before} {after}")
                    if word in terms:
                        held.append(word)
                        contexts.append(f"{before} {after}")
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), pa.array(contexts, pa.string())],
                names=["term", "context"])

    found = (
        rows.filter("toxic = 1").select("text").mapInArrow(run, "term string, context string")
        .distinct().groupBy("term").count().filter(F.col("count") >= LEAST_CONTEXTS)
    )
    return sorted(r["term"] for r in found.select("term").collect())


def learn_stems(rows: DataFrame) -> list[str]:
    """Words and word beginnings (ending in `*`) that nearly only toxic documents have.

    A beginning stands for all words below it, so only the shortest pure ones are kept, and
    of beginnings with the same documents the longest.
    """
    totals = dict(rows.groupBy("toxic").count().collect())
    if not totals.get(1) or not totals.get(0):
        return []
    least = max(LEAST_SUPPORT, LEAST_SHARE * totals[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, toxic = [], []
            for text, label in zip(batch.column(0), batch.column(1)):
                words = set(WORD.findall(text.as_py().lower()))
                some = {w for w in words if len(w) >= SHORTEST}
                some |= {w[:n] + "*" for w in words
                         for n in range(SHORTEST, min(len(w), LONGEST + 1))}
                terms += some
                toxic += [label.as_py()] * len(some)
            together = pa.table({"term": pa.array(terms, pa.string()),
                                 "toxic": pa.array(toxic, pa.int64())}).group_by("term").aggregate(
                [("toxic", "sum"), ("toxic", "count")])
            yield from together.select(["term", "toxic_sum", "toxic_count"]).rename_columns(
                ["term", "toxic", "n"]).to_batches()

    found = (
        rows.select("text", F.col("toxic").cast("int")).mapInArrow(
            run, "term string, toxic long, n long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .filter((F.col("toxic") >= least) & (F.col("toxic") >= PURE * F.col("n")))
        .collect()
    )
    support = {r["term"]: r["toxic"] for r in found}
    return shortest_pure({t: support[t] for t in _between_different_words(rows, set(support))})


def _beginnings(term: str) -> list[str]:
    body = term.rstrip("*")
    return [body[:n] + "*" for n in range(SHORTEST, min(len(body), LONGEST) + 1)
            if body[:n] + "*" != term]


def shortest_pure(support: dict[str, int]) -> list[str]:
    """Of pure terms and their documents, those that no shorter beginning stands for.

    A beginning with no more documents than one of its longer terms gives way to that.
    """
    longer: dict[str, int] = {}
    for term, documents in support.items():
        for beginning in _beginnings(term):
            longer[beginning] = max(longer.get(beginning, 0), documents)
    own = {t for t, n in support.items() if not t.endswith("*") or longer.get(t, 0) < n}
    return sorted((t for t in own if own.isdisjoint(_beginnings(t))),
                  key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t))


def features(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def fit(rows: DataFrame, stems: list[str], rounds: int = 30, ridge: float = 0.05) -> list[float]:
    """Weights of the patterns and a constant, by Newton's method on the sample's counts.

    Equal feature rows are counted by Spark first; no more than the sample can come back.
    """
    grammar = Grammar(stems)

    def run(batches):
        for batch in batches:
            found = [np.asarray(grammar.counts(t.as_py()), np.int32).tobytes()
                     for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), batch.column(1)], names=["counts", "toxic"])

    told = rows.select("text", F.col("toxic").cast("int")).mapInArrow(
        run, "counts binary, toxic int").groupBy("counts", "toxic").count().collect()
    size = len(PATTERNS) + 1
    if {r["toxic"] for r in told} != {0, 1}:
        return [0.0] * (size - 1) + [UNTAUGHT]
    told.sort(key=lambda r: (bytes(r["counts"]), r["toxic"]))
    x = features(np.array([np.frombuffer(r["counts"], np.int32) for r in told], float))
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([r["toxic"] for r in told], float)
    n = np.array([r["count"] for r in told], float)
    weights, penalty = np.zeros(size), ridge * np.eye(size)
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (y - p)) - penalty @ weights
        curve = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, gradient)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return [float(w) for w in weights]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", most: int = SAMPLE) -> Model:
    """The lexicon and the weights, learned from labelled rows that are not held out."""
    rows = stored(sample(docs, labels, id_col, text_col, label_col, most), "toxicity-sample")
    stems = learn_stems(rows)
    return Model(tuple(stems), tuple(fit(rows, stems)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text",
               score_col: str = "score") -> DataFrame:
    """`docs` with the model's probability that the whole text is toxic; of the text alone."""
    weights = np.array(model.weights)
    names, at = [*docs.columns, score_col], docs.columns.index(text_col)

    def run(batches):
        grammar = Grammar(list(model.stems))
        for batch in batches:
            found = np.array([
                features(grammar.counts(t.as_py() or "")) @ weights[:-1] + weights[-1]
                for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(found, -700, 700))))],
                names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{score_col}` double")


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
           text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """`(doc_id, held_out, score, predicted)` for every row of `docs`.

    A null or empty text scores like one without any pattern.  Labels other than 0 and 1 and
    labels of null ids teach nothing; of several labels of an id the largest counts.  Without
    labelled rows of both kinds the lexicon is empty and no text counts as toxic.  An empty table gives no rows; other
    columns are not looked at.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    return with_score(docs.select(id_col, text_col), model, text_col, "score").select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs` that score below one half, with all their columns."""
    model = train(docs, labels, id_col, text_col, label_col)
    [score] = fresh(docs, "toxic_score")
    return with_score(docs, model, text_col, score).filter(F.col(score) < 0.5).drop(score)
