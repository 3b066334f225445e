"""Language of a text by a bidirectional gated recurrent network over its bytes.

A text is cut into windows of `WINDOW` bytes.  In each, one network of `HIDDEN` units reads forwards and
one backwards; both together label every byte with a probability of each language, and the
geometric mean over all bytes of all windows is the document's.  Gates are hard sigmoids and candidates
x / (1 + |x|), which cost a fraction of exponentials and train as well.

The weights are learned here, in numpy, by backpropagation through time over a bounded sample of windows:
about `SAMPLE` for each language, chosen by a hash of their bytes from all windows of all training
texts, so copies count once and long texts are not cut.  The sample is all that the driver gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, HIDDEN, SEED = 64, 8, 42
#: Windows to learn from, for each language, and the passes of training over batches of them.
SAMPLE, STEPS, BATCH, RATE = 2500, 300, 256, 0.02
#: Windows labelled at a time.
LANES = 2048
SYMBOLS = 256


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 1, out=x)


@dataclass
class Reader:
    """One direction: `table` has each byte's inputs to the update, reset and candidate units."""

    table: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    out: np.ndarray

    @classmethod
    def first(cls, pick: np.random.Generator, hidden: int, classes: int) -> "Reader":
        table = pick.normal(0, 0.3, (3 * hidden, SYMBOLS))
        table[:2 * hidden] += 0.5
        return cls(table, pick.normal(0, 0.4, (3 * hidden, hidden)), np.zeros((hidden, 1)),
                   pick.normal(0, 0.4, (classes, hidden)))

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out]

    def states(self, codes: np.ndarray) -> tuple[list, list]:
        """States after each of the bytes `codes[t]`, and what going back needs."""
        h = len(self.bias)
        state, states, kept = np.zeros((h, codes.shape[1])), [], []
        for row in codes:
            inner = self.inner @ state
            gates = self.table[:2 * h, row] + inner[:2 * h]
            open_ = (gates > 0) & (gates < 1)
            gates = _gate(gates)
            update, reset = gates[:h], gates[h:]
            turned = inner[2 * h:] + self.bias
            raw = self.table[2 * h:, row] + reset * turned
            candidate = raw / (1 + np.abs(raw))
            kept.append((state, open_, update, reset, turned, raw, candidate))
            state = candidate + update * (state - candidate)
            states.append(state)
        return states, kept

    def gradients(self, codes: np.ndarray, states: list, kept: list, errors: np.ndarray
                  ) -> list[np.ndarray]:
        """Of the loss by each of `arrays()`, given its gradient `errors[t]` by the logits."""
        h = len(self.bias)
        _, inner, bias, out = map(np.zeros_like, self.arrays())
        flow = np.zeros_like(states[0])
        by_table = np.empty((3 * h, *codes.shape))
        for t in range(len(codes) - 1, -1, -1):
            before, open_, update, reset, turned, raw, candidate = kept[t]
            out += errors[t] @ states[t].T
            flow += self.out.T @ errors[t]
            by_raw = flow * (1 - update) / (1 + np.abs(raw)) ** 2
            by_turned = by_raw * reset
            by_gates = np.concatenate([flow * (before - candidate), by_raw * turned]) * open_
            by_inner = np.concatenate([by_gates, by_turned])
            by_table[:2 * h, t], by_table[2 * h:, t] = by_gates, by_raw
            inner += by_inner @ before.T
            bias += by_turned.sum(axis=1, keepdims=True)
            flow = flow * update + self.inner.T @ by_inner
        table = np.stack([
            np.bincount(codes.ravel(), unit.ravel(), SYMBOLS) for unit in by_table])
        return [table, inner, bias, out]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """`[t, class, lane]`, in single precision with buffers used again."""
        h, lanes = len(self.bias), codes.shape[1]
        table, inner, bias, out = (np.ascontiguousarray(a, np.float32) for a in self.arrays())
        state = np.zeros((h, lanes), np.float32)
        fed, turned = (np.empty((3 * h, lanes), np.float32) for _ in range(2))
        spare = np.empty((h, lanes), np.float32)
        found = np.empty((len(codes), len(out), lanes), np.float32)
        gates, raw = fed[:2 * h], fed[2 * h:]
        for t, row in enumerate(codes):
            np.take(table, row, axis=1, out=fed, mode="clip")
            np.matmul(inner, state, out=turned)
            gates += turned[:2 * h]
            np.clip(gates, 0, 1, out=gates)
            last = turned[2 * h:]
            last += bias
            last *= gates[h:]
            raw += last
            np.abs(raw, out=spare)
            spare += 1
            np.divide(raw, spare, out=raw)
            state -= raw
            state *= gates[:h]
            state += raw
            np.matmul(out, state, out=found[t])
        return found


@dataclass
class Network:
    languages: list[str]
    forwards: Reader
    backwards: Reader
    bias: np.ndarray

    @classmethod
    def first(cls, languages: list[str], hidden: int = HIDDEN) -> "Network":
        pick = np.random.default_rng(SEED)
        classes = len(languages)
        return cls(languages, Reader.first(pick, hidden, classes),
                   Reader.first(pick, hidden, classes), np.zeros((classes, 1)))

    def arrays(self) -> list[np.ndarray]:
        return [*self.forwards.arrays(), *self.backwards.arrays(), self.bias]

    def learn_from(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all bytes of windows `codes[t, lane]`, and its gradients."""
        states, kept = self.forwards.states(codes)
        back_states, back_kept = self.backwards.states(codes[::-1])
        logits = (np.stack([self.forwards.out @ s for s in states])
                  + np.stack([self.backwards.out @ s for s in back_states[::-1]]) + self.bias)
        logits -= logits.max(axis=1, keepdims=True)
        shares = np.exp(logits)
        shares /= shares.sum(axis=1, keepdims=True)
        lanes = np.arange(codes.shape[1])
        loss = -np.log(np.maximum(shares[:, labels, lanes], 1e-30)).mean()
        errors = shares
        errors[:, labels, lanes] -= 1
        errors /= codes.size
        return loss, [
            *self.forwards.gradients(codes, states, kept, errors),
            *self.backwards.gradients(codes[::-1], back_states, back_kept, errors[::-1]),
            errors.sum(axis=(0, 2))[:, None]]

    def label_sums(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """`[window, language]`: log probabilities of the labels of a window's bytes, summed.

        Row by row, `windows` hold `lengths` bytes and zeros behind them, the longest first.
        """
        span = int(lengths[0])
        codes = np.ascontiguousarray(windows[:, :span].T, np.intp)
        ragged = int(lengths[-1]) < span
        if ragged:
            places = lengths[None, :] - 1 - np.arange(span)[:, None]
            back = np.take_along_axis(codes, np.maximum(places, 0), axis=0)
        else:
            back = codes[::-1]
        logits = self.forwards.logits(codes)
        other = self.backwards.logits(back)
        if ragged:
            other = np.take_along_axis(other, np.maximum(places, 0)[:, None, :], axis=0)
        else:
            other = other[::-1]
        logits += other
        logits += self.bias.astype(np.float32)
        total = np.exp(logits).sum(axis=1, keepdims=True)
        logits -= np.log(total)
        if ragged:
            logits *= (np.arange(span)[:, None] < lengths[None, :])[:, None, :]
        return logits.sum(axis=0, dtype=np.float64).T


def windows_of(body: bytes) -> tuple[np.ndarray, int]:
    """The windows of a text as rows, and the length of the last."""
    codes = np.frombuffer(body, np.uint8)
    whole, rest = divmod(len(codes), WINDOW)
    if not rest:
        return codes.reshape(whole, WINDOW), WINDOW
    last = np.zeros(WINDOW, np.uint8)
    last[:rest] = codes[whole * WINDOW:]
    return np.vstack([codes[:whole * WINDOW].reshape(whole, WINDOW), last]), rest


def trained(windows: np.ndarray, labels: np.ndarray, languages: list[str],
            steps: int = STEPS, hidden: int = HIDDEN) -> Network:
    """A network after `steps` steps of Adam over random batches, each language as often."""
    network, pick = Network.first(languages, hidden), np.random.default_rng(SEED + 1)
    arrays = network.arrays()
    mean, square = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    members = [np.flatnonzero(labels == k) for k in range(len(languages))]
    each = -(-BATCH // len(languages))
    for step in range(1, steps + 1):
        chosen = np.concatenate([pick.choice(m, each) for m in members])
        _, slopes = network.learn_from(
            np.ascontiguousarray(windows[chosen].T, np.intp), labels[chosen])
        norm = np.sqrt(sum((s * s).sum() for s in slopes))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for a, s, m, v in zip(arrays, slopes, mean, square):
            s = s / max(1.0, norm)
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def is_training(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def sampled_windows(training: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`(lang, window)`, distinct whole windows of `(lang, body)`, about `sample` for each language.

    A window is taken if the hash of its bytes is below a share of the hashes that its language's
    bytes make `sample` windows; of a language with fewer, all are.  A language whose texts
    are all shorter than a window gives its texts, filled up with spaces.
    """
    sizes = training.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("body") / WINDOW)).alias("n"))
    shares = {r["lang"]: sample / max(1, r["n"]) for r in sizes.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                below = shares[lang] * 2**64
                body = body.as_py()
                ends = range(WINDOW, max(len(body), WINDOW) + 1, WINDOW)
                for end in ends:
                    window = body[end - WINDOW:end].ljust(WINDOW)
                    if xxhash.xxh64_intdigest(window, SEED) < below:
                        langs.append(lang)
                        found.append(window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(found, pa.binary())],
                names=["lang", "window"])

    return training.select("lang", "body").mapInArrow(
        run, "lang string, window binary").distinct()


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> Network | None:
    """The network of the training rows with a language and a text; None without any."""
    training = docs.filter(is_training(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("binary").alias("body")).filter(F.octet_length("body") > 0)
    rows = sampled_windows(training, sample).toArrow().sort_by(
        [("lang", "ascending"), ("window", "ascending")])
    if not rows.num_rows:
        return None
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    windows = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8)
    labels = np.array([languages.index(n) for n in names])
    return trained(windows.reshape(-1, WINDOW), labels, languages, steps)


def _pooled(network: Network, bodies: list[bytes]) -> np.ndarray:
    """`[text, language]`: sums of the log probabilities of all bytes' labels."""
    sums = np.zeros((len(bodies), len(network.languages)))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    short: list[tuple[np.ndarray, int, int]] = []
    count = 0

    def label(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        windows = np.vstack([w for w, _ in parts])
        owners = np.concatenate([o for _, o in parts])
        for at in range(0, len(windows), LANES):
            part = windows[at:at + LANES]
            found = network.label_sums(part, np.full(len(part), WINDOW))
            np.add.at(sums, owners[at:at + LANES], found)

    for owner, body in enumerate(bodies):
        if not body:
            continue
        windows, last = windows_of(body)
        if last < WINDOW:
            short.append((windows[-1], last, owner))
            windows = windows[:-1]
        if len(windows):
            held.append((windows, np.full(len(windows), owner)))
            count += len(windows)
        if count >= 4 * LANES:
            label(held)
            held, count = [], 0
    if held:
        label(held)
    short.sort(key=lambda s: -s[1])
    for at in range(0, len(short), LANES // 4):
        part = short[at:at + LANES // 4]
        found = network.label_sums(
            np.stack([w for w, _, _ in part]), np.array([n for _, n, _ in part]))
        np.add.at(sums, np.array([o for _, _, o in part]), found)
    return sums


def predicted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, steps: int = STEPS,
) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)` for every row.

    Rows whose crc32(id) mod 4 is 2 are held out; the others, null ids included, train with their
    text and language where both are there.  A null text, one without a letter, and every text
    when nothing could be learned is `und`, with score 0.  `score` is the share of the
    predicted language in the geometric means of its bytes' labels; ties go to the smaller
    name.  Repeated rows are predicted alike; an empty table gives no rows; other columns are
    not looked at.
    """
    network = learned(docs, id_col, text_col, lang_col, sample, steps)
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        for batch in batches:
            bodies = [b.as_py() or b"" for b in batch.column(2)]
            names, scores = [None] * len(bodies), np.zeros(len(bodies))
            if network is not None:
                sums = _pooled(network, bodies)
                means = sums / np.maximum([[len(b)] for b in bodies], 1)
                shares = np.exp(means - means.max(axis=1, keepdims=True))
                best = shares.argmax(axis=1)
                scores = shares[np.arange(len(best)), best] / shares.sum(axis=1)
                names = [network.languages[k] if b else None for k, b in zip(best, bodies)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores)],
                names=["id", "held_out", "lang", "score"])

    text = F.col(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col(id_col).alias("id"), (~is_training(F.col(id_col))).alias("held_out"),
        F.when(lettered, text.cast("binary")).alias("body"))
    return rows.mapInArrow(
        run, f"id {kind}, held_out boolean, lang string, score double",
    ).select(
        F.col("id").alias(id_col), "held_out",
        F.coalesce("lang", F.lit("und")).alias("lang_pred"),
        F.when(F.col("lang").isNull(), 0.0).otherwise(F.col("score")).alias("score"))
