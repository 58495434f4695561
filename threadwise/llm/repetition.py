"""Quality rules on repetition: characters inside repeated n-grams and lines, found by rolling hashes."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadwise.llm.shared import fresh, in_small_batches

#: Bytes of text that a worker takes apart at once, unless a single text is longer.
SLICE_BYTES = 1 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Odd factors of the rolling hashes over bytes and over words, and a value for each byte.
BYTE_FACTOR, WORD_FACTOR = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BYTE_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Rules:
    """Percent limits; a document over one of them is not kept."""

    #: Fixed values (published with the MassiveText corpus, Rae et al. 2021): characters in words of n-grams that stood
    #: earlier in the text, by n, and characters in repeated lines. A share of lines is no rule: of a text of three lines,
    #: one short line too many would be a third.
    ngrams: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    line_chars: int = 20
    #: Base rule: fewest words, and most words in three-word windows found twice or more.
    least_words: int = 50
    window: int = 3
    repeat_words: int = 50


class Powers:
    """Powers of an odd factor modulo 2^64 and of its inverse, as many as were asked for."""

    def __init__(self, factor: int):
        self.factors = np.array([factor, pow(factor, -1, 1 << 64)], np.uint64)
        self.held = np.ones((2, 1), np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.held.shape[1]:
            steps = np.repeat(self.factors[:, None], (n | 0xFFFF) + 1, 1)
            steps[:, 0] = 1
            self.held = np.cumprod(steps, 1, dtype=np.uint64)
        return self.held[0, :n], self.held[1, :n]


class Rolling:
    """Hashes of all stretches of a sequence out of one running sum: sum of value * factor^place, moved to the front."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return values ^ (values >> np.uint64(29))


def equals(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs more than once, and of these the ones that are not the first, both ascending."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = order[1:][same]
    return np.unique(np.concatenate((order[:-1][same], later))), np.sort(later)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for each of size words inside one of the n-grams at the starts."""
    edges = np.zeros(size + 1, np.int64)
    edges[:-1] += np.bincount(starts, minlength=size)
    np.subtract.at(edges, np.minimum(starts + n, size), 1)
    return np.cumsum(edges[:-1]) > 0


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after another, and where each text ends; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return held, ends[1:] - ends[0]


IS_SPACE, IS_SYMBOL = (np.isin(np.arange(256), list(c)) for c in (SPACES, SYMBOLS))


def word_bounds(data: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the texts starts and ends; no word crosses from one text into the next."""
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[text_ends] = True
    blank = np.concatenate((IS_SPACE[data], [True]))
    before = np.concatenate(([True], blank[:-1]))
    return np.flatnonzero(~blank & (before | first)), np.flatnonzero(~before & (blank | first))


class Measurer:
    """Counts of whole texts, many at a time, without a loop over texts or words."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.by_byte, self.by_word = Powers(BYTE_FACTOR), Powers(WORD_FACTOR)

    def names(self) -> list[str]:
        return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars",
                *[f"covered_{n}" for n in self.rules.ngrams]]

    def counts(self, data: np.ndarray, text_ends: np.ndarray) -> dict[str, np.ndarray]:
        """The counts, by name, of each text."""
        n, size = len(text_ends), len(data)
        text_starts = np.concatenate(([0], text_ends[:-1])).astype(np.int64)
        by_bytes = Rolling(BYTE_VALUES[data], self.by_byte)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
        owner = lambda at: np.searchsorted(text_ends, at, "right")  # noqa: E731  empty texts own nothing

        starts, ends = word_bounds(data, text_ends)
        doc = owner(starts)
        word_chars = chars[ends] - chars[starts]
        sums = lambda of, values: np.bincount(of, values, n).astype(np.int64)  # noqa: E731  exact below 2^53
        words = np.bincount(doc, minlength=n)
        out = {"n_words": words, "word_chars": sums(doc, word_chars),
               "n_symbols": np.bincount(owner(np.flatnonzero(IS_SYMBOL[data])), minlength=n)}

        breaks = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate((text_starts[text_ends > text_starts], breaks + 1)))
        line_starts = line_starts[line_starts < size]
        line_ends = np.concatenate((line_starts, [size])).astype(np.int64)[1:]
        line_ends -= data[line_ends - 1] == 10
        in_line = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[in_line > 0], line_ends[in_line > 0]
        line_doc = owner(line_starts)
        _, again = equals(by_bytes.of(line_starts, line_ends) ^ mixed(line_doc.astype(np.uint64)))
        line_chars = chars[line_ends] - chars[line_starts]
        out |= {"n_dup_lines": np.bincount(line_doc[again], minlength=n), "line_chars": sums(line_doc, line_chars),
                "dup_line_chars": sums(line_doc[again], line_chars[again])}

        salt = mixed(doc.astype(np.uint64) + np.uint64(1 << 40))
        by_words = Rolling(by_bytes.of(starts, ends), self.by_word)
        last = np.cumsum(words)[doc]  # where the words of a word's text end

        def repeats(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
            at = at[at + k <= last[at]]
            some, later = equals(by_words.of(at, at + k) ^ salt[at])
            return at[some], at[later]

        every = np.arange(len(starts))
        some, _ = repeats(every, self.rules.window)
        out["n_repeat_words"] = np.bincount(doc[covered(some, self.rules.window, len(doc))], minlength=n)
        held, shortest = some, self.rules.window
        for k in sorted(self.rules.ngrams):
            # A repeated n-gram begins with a repeated shorter one.
            held, later = repeats(held if k >= shortest else every, k)
            shortest = k
            inside = covered(later, k, len(doc))
            out[f"covered_{k}"] = sums(doc[inside], word_chars[inside])
        return out

    def verdict(self, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r = self.rules
        failed = (c["n_words"] < r.least_words) | (100 * c["n_repeat_words"] > r.repeat_words * c["n_words"])
        over = 100 * c["dup_line_chars"] > r.line_chars * c["line_chars"]
        for k, most in r.ngrams.items():
            over |= 100 * c[f"covered_{k}"] > most * c["word_chars"]
        return {"base_failed": failed, "kept": ~failed & ~over}


def repetition(text: Column, rules: Rules = Rules()) -> Column:
    """Struct of a text's counts (long) and verdicts (boolean).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier one),
    n_repeat_words (words in windows of three found twice or more), line_chars (of lines with a
    word), dup_line_chars, covered_<n> (characters of the words inside n-grams that stood earlier in the text; each word counts
    once), base_failed and kept. Words are runs without ASCII white space. Null and empty texts have counts of 0, fail the
    base rule and are not kept. Equal texts have equal counts.
    """
    names = Measurer(rules).names()
    schema = ", ".join([*[f"{c} long" for c in names], "base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        measurer = Measurer(rules)
        for texts in batches:
            data, ends = text_bytes(texts)
            parts, at = [], 0
            while at < len(ends):
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
                found = measurer.counts(data[base:int(ends[to - 1])], ends[at:to] - base)
                parts.append(found | measurer.verdict(found))
                at = to
            whole = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in (*names, "base_failed", "kept")]
            kinds = [pa.int64()] * len(names) + [pa.bool_()] * 2
            yield pa.StructArray.from_arrays(
                [pa.array(v, k) for v, k in zip(whole, kinds)], [*names, "base_failed", "kept"])

    return F.arrow_udf(run, schema)(text)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, counts and verdicts) of every row; null ids, repeated and equal rows stay, no rows give no rows."""
    rows = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), repetition(F.col(text_col), rules).alias("found"))
    return rows.select("doc_id", "found.*")


def without_repetition(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, columns and texts as they were."""
    name = fresh(docs, "found")
    rows = in_small_batches(docs).withColumn(name, repetition(F.col(text_col), rules))
    return rows.where(F.col(name)["kept"]).select(*docs.columns)
