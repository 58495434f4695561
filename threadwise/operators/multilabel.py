"""Several labels of a text at once: one linear model per label, all fitted in the same passes over the texts."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

TERM = re.compile(r"\w\w+")
#: Terms of the vocabulary at most, and texts that a term must stand in.
MAX_TERMS, MIN_TEXTS = 1 << 18, 2
#: Weight decay, the largest slope at which the fit is done, and passes over the texts at most.
DECAY, TOLERANCE, PASSES = 1e-3, 1e-6, 100
#: Steps that the curvature is estimated from.
MEMORY = 8
#: Numbers of a gradient that one task adds up.
CHUNK = 1 << 14
#: Texts that a task takes into its matrices at once.
ROWS = 2048


def terms_of(text: str | None) -> list[str]:
    """Terms of a whole text in lower case; null has none."""
    return TERM.findall((text or "").lower())


def term_counts(texts: DataFrame, text: str, least: int, most: int) -> list[str]:
    """The terms that stand in at least `least` texts, the `most` most frequent of them, in alphabetical order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(t for value in batch.column("text").to_pylist() for t in set(terms_of(value)))
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counts = texts.select(F.col(text).alias("text")).mapInArrow(run, "term string, n long")
    known = counts.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return sorted(r["term"] for r in known.orderBy(F.desc("n"), "term").limit(most).collect())


class Features:
    """Known terms of texts, weighed by 1 + ln(count) and scaled to length one; the last place is a constant."""

    def __init__(self, vocabulary: list[str]):
        self.place = {t: i for i, t in enumerate(vocabulary)}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = Counter(at for at in map(self.place.get, terms_of(text)) if at is not None)
        at = np.fromiter(found, np.int32, len(found))
        value = 1 + np.log(np.fromiter(found.values(), np.float64, len(found)))
        value /= np.sqrt((value ** 2).sum()) or 1
        return np.append(at, np.int32(len(self.place))), np.append(value, 1.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class LabelScorer:
    """Weights (terms and a constant, labels) over a vocabulary."""

    labels: list[str]
    vocabulary: list[str]
    weights: np.ndarray

    def maker(self):
        """What `learning.apply_scorer` takes: run once per task, it gives a function from texts to score maps."""
        def make():
            features = Features(self.vocabulary)

            def one(text: str | None) -> dict[str, float]:
                at, value = features.of(text)
                return dict(zip(self.labels, sigmoid(value @ self.weights[at]).tolist()))

            return lambda texts: texts.map(one)

        return make


def _rows(texts: DataFrame, text: str, labels: list[str], vocabulary: list[str]) -> DataFrame:
    """(at, value, y) of each text as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(vocabulary)
        for batch in batches:
            found = [features.of(t) for t in batch["__text"]]
            y = batch[labels].to_numpy(np.float64)
            yield pd.DataFrame({"at": [a.tobytes() for a, _ in found], "value": [v.tobytes() for _, v in found],
                                "y": [r.tobytes() for r in y]})

    chosen = texts.select(F.col(text).alias("__text"), *[F.col(c).cast("double").alias(c) for c in labels])
    return chosen.mapInPandas(run, "at binary, value binary, y binary")


def _losses(rows: DataFrame, weights: np.ndarray, decay: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss and gradient of every label at its own weights, in one pass: each task adds up its rows, the sums of the
    tasks meet in chunks of places."""
    k, sent = weights.shape[1], rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value.shape[1]
        total = np.zeros(sent.value.size + k)
        for part in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            at, value, y = (part.column(c).to_pylist() for c in ("at", "value", "y"))
            sizes = np.array([len(a) // 4 for a in at])
            at = np.frombuffer(b"".join(at), np.int32)
            value = np.frombuffer(b"".join(value), np.float64)
            y = np.frombuffer(b"".join(y), np.float64).reshape(-1, k)
            starts = np.cumsum(sizes) - sizes
            for j, own in enumerate(sent.value):  # label by label: numbers that lie side by side are added faster
                z = np.add.reduceat(own[at] * value, starts)
                total[j] += (np.logaddexp(0, z) - y[:, j] * z).sum()
                slope = np.repeat(sigmoid(z) - y[:, j], sizes) * value
                total[k + j * places:k + (j + 1) * places] += np.bincount(at, slope, places)
        parts = [total[i:i + CHUNK] for i in range(0, len(total), CHUNK)]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(len(parts)), pa.int64()), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(s, np.float64) for s in parts["sums"])
        return pd.DataFrame({"part": parts["part"].iloc[:1], "sums": [whole.tobytes()]})

    schema = "part long, sums binary"
    found = rows.mapInArrow(run, schema).groupBy("part").applyInPandas(add, schema).collect()
    found.sort(key=lambda r: r["part"])  # here, as a sort in Spark would add everything up twice
    total = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in found]) / count
    penalty = weights.copy()
    penalty[-1] = 0  # the constant is free
    return total[:k] + decay / 2 * (penalty ** 2).sum(0), total[k:].reshape(k, -1).T + decay * penalty


class _Descent:
    """Limited-memory BFGS of one label; the caller measures loss and gradient wherever `trial` says."""

    def __init__(self, size: int):
        self.at = self.trial = np.zeros(size)
        self.loss, self.slope, self.step, self.direction, self.pairs = np.inf, None, 1.0, None, []
        self.done = False

    def take(self, loss: float, slope: np.ndarray, tolerance: float) -> None:
        if self.direction is not None and loss > self.loss + 1e-4 * self.step * (self.slope @ self.direction):
            self.step /= 2
            if self.step < 1e-10:
                self.done = True
            self.trial = self.at + self.step * self.direction
            return
        if self.direction is not None:
            moved, turned = self.trial - self.at, slope - self.slope
            if moved @ turned > 1e-12:
                self.pairs = [*self.pairs, (moved, turned)][-MEMORY:]
        self.at, self.loss, self.slope = self.trial, loss, slope
        self.done = bool(np.abs(slope).max() < tolerance)
        back, q = [], slope.copy()
        for s, y in reversed(self.pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            back.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(back)):
            q += s * (a - (y @ q) / (y @ s))
        self.direction, self.step = -q, 1.0
        self.trial = self.at + self.direction


def train_labels(texts: DataFrame, labels: list[str], text: str = "text", least: int = MIN_TEXTS, most: int = MAX_TERMS,
                 decay: float = DECAY, tolerance: float = TOLERANCE, passes: int = PASSES) -> LabelScorer | None:
    """A scorer for all label columns (true or false) from whole texts; None without a text.

    The vocabulary is counted, not hashed. Every pass measures the loss and gradient of all labels at once, each at the
    weights of its own descent, so a label's weights are those that it would get alone. What goes to the driver is the
    vocabulary and one gradient of terms times labels, both bounded by `most`. Texts with a null label are left out.
    """
    known = texts.dropna(subset=labels)
    vocabulary = term_counts(known, text, least, most)
    rows = _rows(known, text, labels, vocabulary).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        count = rows.count()
        if not count:
            return None
        # Each task sends a whole gradient: no more tasks than run at once, however many parts the texts have.
        spread = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
        descents = [_Descent(len(vocabulary) + 1) for _ in labels]
        for _ in range(passes):
            losses, slopes = _losses(spread, np.stack([d.trial for d in descents], 1), decay, count)
            for j, descent in enumerate(descents):
                if not descent.done:
                    descent.take(losses[j], slopes[:, j], tolerance)
            if all(d.done for d in descents):
                break
        return LabelScorer(list(labels), vocabulary, np.stack([d.at for d in descents], 1))
    finally:
        rows.unpersist()
