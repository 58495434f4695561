"""Toxicity scores from a factorization machine over hashed terms."""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadwise.llm.shared import fresh, in_small_batches, stored

TERM = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    #: Labelled documents that the machine is fitted on, at most: those of least hash.
    sample: int = 10_000
    #: Buckets that the terms are hashed into.
    buckets: int = 1 << 20
    #: Columns of the interaction matrix.
    factors: int = 4
    #: A bucket takes part if its documents hold so many standard deviations more or fewer toxic ones than chance, or
    #: if those that it shares with another bucket do so beside the share of the stronger of the two.
    deviations: float = 4.0
    steps: int = 400
    rate: float = 0.1
    #: Weight decay of single terms and of the factors: pairs are to explain what single terms cannot.
    decay: float = 1e-5
    pair_decay: float = 2e-3


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors)."""

    buckets: int
    bias: float
    terms: np.ndarray  # kept buckets, ascending
    weights: np.ndarray
    factors: np.ndarray

    def score(self, text: str | None) -> float:
        found = term_buckets(text, self.buckets)
        at = np.searchsorted(self.terms, found)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == found] if len(self.terms) else at[:0]
        rows = self.factors[at]
        pairs = 0.5 * float((rows.sum(0) ** 2 - (rows ** 2).sum(0)).sum())
        return float(sigmoid(self.bias + float(self.weights[at].sum()) + pairs))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def term_buckets(text: str | None, buckets: int) -> np.ndarray:
    """Sorted hash buckets of the different terms of a text, lower case; the text is read whole."""
    chunks = set((text or "").lower().split())
    terms = set(TERM.findall(" ".join(chunks)))
    return np.unique(np.fromiter((crc32(t.encode()) % buckets for t in terms), np.int64, len(terms)))


def held_out(id_col):
    """True for the quarter of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_terms(docs: DataFrame, labels: DataFrame, settings: Settings) -> list:
    """(toxic, buckets) of at most settings.sample labelled documents, the only rows that go to the driver."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(settings.sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [term_buckets(t, settings.buckets).astype("<i4").tobytes() for t in rows["text"]]
            yield pd.DataFrame({"id": rows["id"], "toxic": rows["toxic"], "found": found})

    terms = texts.mapInPandas(run, "id long, toxic int, found binary").groupBy("id", "toxic").agg(
        F.min("found").alias("found"))
    return stored(terms, "labelled").orderBy("id").limit(settings.sample).collect()


#: Entries (a term of a document) that the driver works on at once.
PART = 1 << 18


def picked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at], a part at a time: numpy copies 32-bit indices to 64 bits."""
    out = np.empty(len(at), table.dtype)
    for i in range(0, len(at), PART):
        out[i:i + PART] = table[at[i:i + PART]]
    return out


def entry_sums(at: np.ndarray, size: int, doc: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
    """Number of the entries of each term, or the sum of their documents' labels, a part at a time."""
    out = np.zeros(size)
    for i in range(0, len(at), PART):
        out += np.bincount(at[i:i + PART], None if y is None else y[doc[i:i + PART]], size)
    return out


def shared_counts(left: tuple, right: tuple, y: np.ndarray, shape: tuple, most: int = PART) -> np.ndarray:
    """How many documents, and how many toxic ones, hold both a term of the left and one of the right.

    Each side is (document, term) in the order of the documents. Only terms that stand in one document are brought
    together, about `most` of them at a time.
    """
    (doc, a), (right_doc, b) = left, right
    first = np.searchsorted(right_doc, np.arange(len(y) + 1, dtype=right_doc.dtype))
    room = np.diff(first)[doc]
    ends = np.cumsum(room)
    both = np.zeros((2, shape[0] * shape[1]))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)), [len(doc)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        n, at = room[lo:hi], ends[lo:hi] - room[lo:hi]
        to = np.arange(n.sum()) + np.repeat(first[doc[lo:hi]] - (at - at[0]), n)
        cell = np.repeat(a[lo:hi].astype(np.int64), n) * shape[1] + b[to]
        both[0] += np.bincount(cell, minlength=both.shape[1])
        both[1] += np.bincount(cell[np.repeat(y[doc[lo:hi]] > 0, n)], minlength=both.shape[1])
    return both.reshape(2, *shape)


def in_pairs(doc: np.ndarray, at: np.ndarray, y: np.ndarray, terms: int, deviations: float,
             cells: int = 1 << 18) -> np.ndarray:
    """For each term: is it in a pair that tells of the label what neither of its terms tells?

    The documents of a pair are held against the share of toxic ones among those of its stronger term, the one further
    from chance. A pair counts if it is further off than a limit which rises with the number of pairs, as there are
    many pairs: either way beside a term that is kept by itself (a word that takes the harm out of an insult), and
    beyond chance too for two terms that say little alone. Copies of a document must be left out before, as they would
    make pairs of any of their words. Terms in too few documents to pass in any pair are left out,
    and `cells` pairs are counted at a time, so memory is bounded.
    """
    n, toxic, p = entry_sums(at, terms), entry_sums(at, terms, doc, y), y.mean()
    z = np.abs(toxic - n * p) / np.sqrt(n * p * (1 - p) + 1)
    limit = float(np.sqrt(deviations ** 2 + 4 * np.log(max(2, (n > 1).sum()))))
    reach = lambda count, q: count * (1 - q) / np.sqrt(count * p * (1 - p) + 1) >= limit
    strong = np.flatnonzero(z >= deviations)
    silent = np.flatnonzero((z < deviations) & (reach(toxic, p) | reach(n, 1 - p)))
    many = np.flatnonzero(n >= limit)
    found = np.zeros(len(n), bool)

    def side(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column, among = np.zeros(len(n), np.int32), np.zeros(len(n), bool)
        column[chosen], among[chosen] = np.arange(len(chosen)), True
        here = picked(among, at)
        return doc[here], picked(column, at[here])

    def pairs(left: np.ndarray, right: np.ndarray, either_way: bool) -> None:
        rights, block = side(right), max(1, cells // max(1, len(right)))
        for i in range(0, len(left), block):
            a = left[i:i + block]
            both, both_toxic = shared_counts(side(a), rights, y, (len(a), len(right)))
            share = np.where(z[a][:, None] >= z[right], (toxic[a] / n[a])[:, None], toxic[right] / n[right])
            most, least = (share, share) if either_way else (np.maximum(share, p), np.minimum(share, p))
            over = (both_toxic - both * most) / np.sqrt(both * most * (1 - most) + 1)
            under = (both * least - both_toxic) / np.sqrt(both * least * (1 - least) + 1)
            hit = (np.maximum(over, under) >= limit) & (a[:, None] != right)
            found[a[hit.any(1)]] = True
            found[right[hit.any(0)]] = True

    pairs(strong, many, True)
    pairs(silent, silent, False)
    return found


def slopes(theta: np.ndarray, doc: np.ndarray, at: np.ndarray, y: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """Gradient of the mean logistic loss plus half the decayed squares; theta has a row (weight, factors) per term
    and the bias in a last one."""
    by_doc = lambda x: np.stack([np.bincount(doc, x[:, j], len(y)) for j in range(x.shape[1])], 1)
    by_term = lambda x: np.stack([np.bincount(at, x[:, j], len(theta) - 1) for j in range(x.shape[1])], 1)
    x = theta[at]
    sums = by_doc(x)
    squares = by_doc(x[:, 1:] ** 2)
    z = theta[-1, 0] + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1)
    slope = (sigmoid(z) - y) / len(y)
    grad = np.zeros_like(theta)
    grad[:-1] = by_term(np.concatenate(
        [slope[doc, None], slope[doc, None] * (sums[doc, 1:] - x[:, 1:])], 1)) + decay * theta[:-1]
    grad[-1, 0] = slope.sum()
    return grad


def fit(rows: list, settings: Settings = Settings()) -> Machine:
    """Machine from (toxic, buckets) rows by full-batch Adam on the logistic loss; with one class only, its bias."""
    y = np.array([r["toxic"] for r in rows], float)
    empty = np.zeros(0, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Machine(settings.buckets, min(bias, -1.0) if not y.any() else bias, empty, empty * 1.0, np.zeros((0, 1)))
    found = [np.frombuffer(r["found"], "<i4") for r in rows]
    terms, at = np.unique(np.concatenate(found)), np.concatenate(found)
    ends = np.cumsum([len(f) for f in found])
    for lo, hi in zip(ends - [len(f) for f in found], ends):
        at[lo:hi] = np.searchsorted(terms, at[lo:hi])  # the term's number in the bucket's place
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in found])
    n, toxic, p = entry_sums(at, len(terms)), entry_sums(at, len(terms), doc, y), y.mean()
    keep = np.abs(toxic - n * p) / np.sqrt(n * p * (1 - p) + 1) >= settings.deviations
    seen: dict = {}
    once = np.array([seen.setdefault((bytes(r["found"]), t), i) == i for i, (r, t) in enumerate(zip(rows, y))])
    number, first = np.cumsum(once, dtype=np.int32) - 1, picked(once, doc)
    keep |= in_pairs(picked(number, doc[first]), at[first], y[once], len(terms), settings.deviations)
    kept = picked(keep, at)
    doc, at, terms = doc[kept].astype(np.int64), (np.cumsum(keep) - 1)[at[kept]], terms[keep].astype(np.int64)
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]

    rng, k = np.random.default_rng(7), settings.factors
    decay = np.array([settings.decay] + [settings.pair_decay] * k)
    theta = np.zeros((len(terms) + 1, 1 + k))
    theta[:-1, 1:] = rng.normal(0, 0.01, (len(terms), k))
    theta[-1, 0] = bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        grad = slopes(theta, doc, at, y, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta - settings.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Machine(settings.buckets, float(theta[-1, 0]), terms, theta[:-1, 0], theta[:-1, 1:])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    return fit(labelled_terms(docs, labels, settings), settings)


def scored(docs: DataFrame, machine: Machine, score_col: str = "score") -> DataFrame:
    """The rows with the machine's score of their text: 0 to 1, null and empty texts get the bias alone.

    Only the text enters. All rows and columns stay; a column of the score's name is replaced. The machine holds the
    kept buckets only, so it is small whatever the number of terms.
    """
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([machine.score(t) for t in batch], dtype=float)

    return in_small_batches(docs).withColumn(score_col, F.pandas_udf(run, "double")(F.col("text")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                  settings: Settings = Settings()) -> DataFrame:
    """The documents that score below the threshold, columns as they were."""
    score = fresh(docs, "score")
    return scored(docs, train(docs, labels, settings), score).where(F.col(score) < threshold).select(*docs.columns)
