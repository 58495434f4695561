"""Masked pseudo-likelihood: a window network predicts every word from the words on both of its sides."""

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadwise.llm.shared import JOINED_ID, in_small_batches, split_id, stored


@dataclass(frozen=True)
class Settings:
    #: A word is one of base ** digits symbols, by its hash; the network predicts the digits one after the other.
    base: int = 16
    digits: int = 3
    #: Words on each side, and the size of a word's vector.
    window: int = 3
    size: int = 16
    batch: int = 4096
    rate: float = 0.15
    seed: int = 5
    #: Models that are averaged at once.
    fan_in: int = 32

    @property
    def symbols(self) -> int:
        return self.base ** self.digits


@dataclass
class Network:
    """log P(word | both sides) = sum over digits of log softmax(tanh(context + earlier digits) out + bias)."""

    settings: Settings
    words: np.ndarray  # (symbols, size)
    places: np.ndarray  # (2 * window, size): weight of each place in the window
    earlier: np.ndarray  # (digits - 1, base, size)
    out: np.ndarray  # (digits, size, base)
    bias: np.ndarray  # (digits, base)
    squares: dict = field(default_factory=dict)

    NAMES = ("words", "places", "earlier", "out", "bias")

    @classmethod
    def new(cls, s: Settings) -> "Network":
        rng = np.random.default_rng(s.seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(s, draw(s.symbols, s.size), np.ones((2 * s.window, s.size), np.float32) + draw(2 * s.window, s.size),
                   draw(s.digits - 1, s.base, s.size), draw(s.digits, s.size, s.base),
                   np.zeros((s.digits, s.base), np.float32))

    def offsets(self) -> list[int]:
        w = self.settings.window
        return [*range(-w, 0), *range(1, w + 1)]

    def digit(self, ids: np.ndarray) -> list[np.ndarray]:
        b = self.settings.base
        return [ids // b ** k % b for k in range(self.settings.digits)]

    def context(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the padded ids (-1: none) and the sum of the places around each inner id."""
        w = self.settings.window
        vectors = self.words[padded]
        vectors[padded < 0] = 0
        n = len(padded) - 2 * w
        total = np.zeros((n, self.settings.size), np.float32)
        for j, o in enumerate(self.offsets()):
            total += vectors[w + o:w + o + n] * self.places[j]
        return vectors, total

    def forward(self, padded: np.ndarray):
        """For each inner id: its log-probability (0 for none), and what the gradient needs."""
        w = self.settings.window
        ids = padded[w:len(padded) - w]
        real = ids >= 0
        digits = self.digit(np.where(real, ids, 0))
        vectors, reach = self.context(padded)
        logp, steps, at = np.zeros(len(ids), np.float32), [], np.arange(len(ids))
        for k, d in enumerate(digits):
            if k:
                reach = reach + self.earlier[k - 1][digits[k - 1]]
            hidden = np.tanh(reach)
            z = hidden @ self.out[k] + self.bias[k]
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            total = p.sum(1)
            logp += z[at, d] - np.log(total)
            p /= total[:, None]
            steps.append((hidden, p, d))
        return np.where(real, logp, 0), (vectors, steps, real)

    def gradients(self, padded: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the summed negative log-probability, by parameter."""
        s, w = self.settings, self.settings.window
        _, (vectors, steps, real) = self.forward(padded)
        n, at = len(real), np.arange(len(real))
        g = {m: np.zeros_like(getattr(self, m)) for m in self.NAMES}
        back = np.zeros((n, s.size), np.float32)
        for k in reversed(range(s.digits)):
            hidden, p, d = steps[k]
            dz = p.copy()
            dz[at, d] -= 1
            dz[~real] = 0
            g["out"][k], g["bias"][k] = hidden.T @ dz, dz.sum(0)
            back += (dz @ self.out[k].T) * (1 - hidden * hidden)
            if k:
                g["earlier"][k - 1] = self.summed(steps[k - 1][2], back, s.base)
        dv = np.zeros_like(vectors)
        for j, o in enumerate(self.offsets()):
            part = vectors[w + o:w + o + n]
            g["places"][j] = (back * part).sum(0)
            dv[w + o:w + o + n] += back * self.places[j]
        known = padded >= 0
        g["words"] = self.summed(padded[known], dv[known], s.symbols)
        return g

    @staticmethod
    def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], 1).astype(np.float32)

    def learn(self, padded: np.ndarray) -> None:
        """One step of Adagrad."""
        for name, g in self.gradients(padded).items():
            held = self.squares.setdefault(name, np.full_like(g, 1e-2))
            g /= max(1, self.settings.batch) ** 0.5
            held += g * g
            setattr(self, name, getattr(self, name) - self.settings.rate * g / np.sqrt(held))


def symbols(text: str | None, n: int, known: dict[bytes, int]) -> np.ndarray:
    """Symbol of each word of the whole text, A-Z in lower case."""
    ids = []
    for word in (text or "").encode().lower().split():
        found = known.get(word)
        if found is None:
            if len(known) > 300_000:
                known.clear()
            found = known[word] = crc32(word) % n
        ids.append(found)
    return np.array(ids, np.int64)


def padded_blocks(texts: Iterator[str | None], s: Settings, known: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, id) of all words in blocks of about the batch size, each with its window on both sides.

    Texts are set apart by a window of nothing, so no word sees another text.
    """
    gap, w = np.full(s.window, -1, np.int64), s.window
    ids, owner, held = [gap], [gap], w
    for number, text in enumerate(texts):
        found = symbols(text, s.symbols, known)
        if not len(found):
            continue
        ids += [found, gap]
        owner += [np.full(len(found), number), gap]
        held += len(found) + w
        if held >= s.batch + 2 * w:
            all_ids, all_owner = np.concatenate(ids), np.concatenate(owner)
            at = 0
            while len(all_ids) - at >= s.batch + 2 * w:
                yield all_owner[at + w:at + w + s.batch], all_ids[at:at + s.batch + 2 * w]
                at += s.batch
            ids, owner, held = [all_ids[at:]], [all_owner[at:]], len(all_ids) - at
    all_ids, all_owner = np.concatenate(ids), np.concatenate(owner)
    if len(all_ids) > 2 * w:
        yield all_owner[w:-w], all_ids


CHUNK = 4096


def _averaged(models: DataFrame, fan_in: int) -> DataFrame:
    """Weighted means of the models' parts, `fan_in` models at a time until one is left."""
    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("model")
        weight = np.stack([np.frombuffer(b, np.float32) for b in rows["weight"]]).astype(np.float64)
        value = np.stack([np.frombuffer(b, np.float32) for b in rows["value"]]).astype(np.float64)
        total = weight.sum(0)
        plain = value.mean(0)
        out = np.where(total > 0, (weight * value).sum(0) / np.where(total > 0, total, 1), plain)
        return pd.DataFrame({"model": [int(rows["model"].iloc[0]) // fan_in], "name": [rows["name"].iloc[0]],
                             "part": [int(rows["part"].iloc[0])], "weight": [total.astype(np.float32).tobytes()],
                             "value": [out.astype(np.float32).tobytes()]})

    schema = "model long, name string, part int, weight binary, value binary"
    while models.select(F.max("model")).first()[0]:
        models = stored(
            models.groupBy(F.floor(F.col("model") / fan_in).alias("up"), "name", "part").applyInPandas(mean, schema),
            "models")
    return models


def train(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Network:
    """The network after one pass over every word of the table: each task learns on the rows it reads, and the tasks'
    parameters are averaged by the number of words behind them, in a tree of small groups.

    What is gathered grows with the number of tasks; only the one averaged network goes to the driver, whose size the
    settings fix. No words at all leave the network as it is drawn.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, net, known = None, Network.new(settings), {}
        seen, n = np.zeros(settings.symbols), 0
        for batch in batches:
            for _, ids in padded_blocks(batch["text"], settings, known):
                net.learn(ids)
                seen += np.bincount(ids[ids >= 0], minlength=settings.symbols)
                n += len(ids)
            model = int(batch["task"].iloc[0]) if len(batch) else model
        if not n:
            return
        for name in Network.NAMES:
            value = getattr(net, name).astype(np.float32)
            weight = np.broadcast_to(seen[:, None], value.shape) if name == "words" else np.full(value.shape, n)
            value, weight = value.ravel(), np.ascontiguousarray(weight, np.float32).ravel()
            for part, at in enumerate(range(0, len(value), CHUNK)):
                yield pd.DataFrame({"model": [model], "name": [name], "part": [part], "weight": [
                    weight[at:at + CHUNK].tobytes()], "value": [value[at:at + CHUNK].tobytes()]})

    schema = "model long, name string, part int, weight binary, value binary"
    texts = in_small_batches(docs).select(F.col(text_col).alias("text"), F.spark_partition_id().alias("task"))
    models = _averaged(stored(texts.mapInPandas(run, schema), "models"), settings.fan_in)
    net = Network.new(settings)
    parts = sorted(models.collect(), key=lambda r: r["part"])  # one network
    for name in Network.NAMES if parts else ():
        flat = np.concatenate([np.frombuffer(r["value"], np.float32) for r in parts if r["name"] == name])
        setattr(net, name, flat.reshape(getattr(net, name).shape).copy())
    return replace(net, squares={})


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) per row: the summed log-probabilities of all words, each
    given its sides. Null and empty texts have 0 words, 0 and a null mean. Rows come as often as they are there."""
    s = net.settings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sums, words = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for owner, ids in padded_blocks(batch["text"], s, known):
                logp, (_, _, real) = net.forward(ids)
                sums += np.bincount(owner[real], logp[real], len(batch))
                words += np.bincount(owner[real], minlength=len(batch))
            yield batch[["none", "key"]].assign(n_words=words, log_likelihood=sums)

    rows = docs.select(*split_id(F.col(id_col)), F.col(text_col).alias("text"))
    found = rows.mapInPandas(run, "none boolean, key long, n_words long, log_likelihood double")
    return found.select(F.expr(JOINED_ID).alias("doc_id"), "n_words", "log_likelihood", F.try_divide(
        "log_likelihood", "n_words").alias("mean_log_likelihood"))
