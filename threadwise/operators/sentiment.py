"""Lexicon sentiment after Hutto and Gilbert (2014): valences with boosters, negation, capitals, 'but' and marks.

The lexicon is a table (word, valence). With phrases, idioms, two-word modifiers, "never so" and "least" count as well.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadwise.functions import patterns as P

# Words that strengthen or weaken the next sentiment word.
BOOSTERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously",
    "entirely", "especially", "exceptionally", "extremely", "fabulously", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably", "unusually",
    "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely",
    "slightly", "somewhat", "sorta",
]
# Negations.
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
    "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt",
    "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't",
    "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh",
    "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont",
    "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]
MODIFIERS = BOOSTERS + DAMPENERS + NEGATIONS
# Modifiers of two words, and idioms with their valence.
DAMPENING_PHRASES = ["kind of", "sort of", "just enough"]
IDIOMS = {
    "the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0,
    "cut the mustard": 2.0, "hand to mouth": -2.0, "back handed": -2.0, "blow smoke": -2.0, "upper hand": 1.0,
    "break a leg": 2.0, "cooking with gas": 2.0, "in the black": 2.0, "in the red": -2.0, "on the ball": 2.0,
    "under the weather": -2.0,
}
# Words that turn a negation around, and those that keep "least" from being one.
EMPHATIC, SURE, NOT_LEAST, EMPHASIS = ["so", "this"], "doubt", ["at", "very"], 1.25
# Published weights.
BOOST, CAPITALS, NEGATE = 0.293, 0.733, -0.74
DISTANCE_FACTORS = [1.0, 0.95, 0.9]
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
NORMAL = 15.0
#: Bits of a marked word's place, the largest place, and modifiers that one number has bits for.
BITS, PLACES, HALF = 15, (1 << 15) - 1, 60
#: Texts described at once, and different words that a task remembers.
TEXTS, REMEMBERED = 256, 500_000


def _words(text: Column) -> Column:
    """Words without edge punctuation; two-character remains (emoticons) keep theirs."""
    def clean(word: Column) -> Column:
        bare = F.btrim(word, F.lit(P.ASCII_PUNCTUATION))
        return F.when(F.length(bare) <= 2, word).otherwise(bare)

    parts = F.filter(F.split(text, P.SPACES), lambda w: F.length(w) > 1)
    return F.transform(parts, clean)


@dataclass(frozen=True)
class Phrases:
    """Phrases of two or three words in lower case: idioms give their valence to the words in and beside them, dampening
    ones weaken the next words. They are part of the plan, so their number is that of a list made by hand."""

    idioms: dict[str, float] = field(default_factory=lambda: dict(IDIOMS))
    dampening: list[str] = field(default_factory=lambda: list(DAMPENING_PHRASES))

    def words(self) -> list[str]:
        own = {w for phrase in [*self.idioms, *self.dampening] for w in phrase.split(" ")}
        return sorted(own | {*EMPHATIC, SURE, *NOT_LEAST, "least"})

    def __post_init__(self):
        if any(len(p.split(" ")) not in (2, 3) for p in [*self.idioms, *self.dampening]):
            raise ValueError("a phrase has two or three words")


def _marked(phrases: Phrases | None) -> list[str]:
    """All words that change others: boosters, dampeners, negations and then the other words of phrases. A word's place in
    this list, from 1, stands for it; other words have the place 0."""
    marked = list(dict.fromkeys(MODIFIERS + (phrases.words() if phrases else [])))
    if len(marked) > PLACES:
        raise ValueError(f"{len(marked)} words in phrases and modifiers, at most {PLACES}")
    return marked


def _marks(text: Column) -> Column:
    """Emphasis of exclamation and question marks."""
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    questions = count("?")
    asked = F.when(questions <= 1, 0.0).when(questions <= 3, questions * QUESTION).otherwise(MANY_QUESTIONS)
    return F.least(count("!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION + asked


def _placed_words(listed: DataFrame, key: str, marked: list[str]) -> DataFrame:
    """One row (key, marks, word, behind, beside) per word of (key, marks, text), and one without a word where there is none.

    behind: the places of the word and of the three before it, 15 bits each. beside: the places of the two after it, then
    a bit each for capitals of the word and the three before it in a text of mixed case, then 1 for a word ahead of `but`
    and 2 for one after it.
    """
    places = {w: i for i, w in enumerate(marked, 1)}

    def described(raw: str) -> tuple[str, bool, int]:
        bare = raw.strip(P.ASCII_PUNCTUATION)
        word = bare if len(bare) > 2 else raw
        low = word.lower()
        return low, word == word.upper() and word != low, places.get(low, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        words: list[tuple[str, bool, int]] = []
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
            if len(known) > REMEMBERED:
                known, words = {}, []
            found = []
            for text in batch.column("text").to_pylist():
                parts = [w for w in (text or "").split() if len(w) > 1]
                for w in parts:
                    if w not in known:
                        known[w] = len(words)
                        words.append(described(w))
                found.append([known[w] for w in parts])
            sizes = np.array([len(f) for f in found])
            flat = np.array([w for f in found for w in f], np.int64)
            distinct, at = np.unique(flat, return_inverse=True)
            own = [words[i] for i in distinct]
            low = pa.array([w[0] for w in own], pa.string())
            caps, mark = (np.array([w[k] for w in own], np.int64)[at] for k in (1, 2))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            upper = np.bincount(doc, caps, len(sizes))
            caps = caps * ((upper > 0) & (upper < sizes))[doc]
            place = np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]
            is_but = np.array([w[0] == "but" for w in own], bool)[at] if own else np.zeros(0, bool)
            but = np.full(len(sizes), -1)
            but[doc[is_but][::-1]] = place[is_but][::-1]  # the first one is written last
            ahead, after = (but[doc] >= 0) & (place < but[doc]), (but[doc] >= 0) & (place > but[doc])
            behind, beside = mark.copy(), caps << 2 * BITS
            for d in (1, 2, 3):
                same = place[d:] >= d
                behind[d:] |= np.where(same, mark[:-d], 0) << d * BITS
                beside[d:] |= np.where(same, caps[:-d], 0) << 2 * BITS + d
            for d in (1, 2):
                beside[:-d] |= np.where(place[d:] >= d, mark[d:], 0) << (d - 1) * BITS
            beside |= (ahead + 2 * after) << 2 * BITS + 4
            none = np.flatnonzero(sizes == 0)
            rows = pa.array(np.r_[doc, none])
            zeros = np.zeros(len(none), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(rows), batch.column("marks").take(rows),
                pa.concat_arrays([low.take(pa.array(at)), pa.nulls(len(none), pa.string())]),
                pa.array(np.r_[behind, zeros]), pa.array(np.r_[beside, zeros])], names=[key, "marks", "word", "behind", "beside"])

    kind = listed.schema[key].dataType.simpleString()
    return listed.mapInArrow(run, f"`{key}` {kind}, marks double, word string, behind long, beside long")


def _valued(phrases: Phrases | None, marked: list[str]):
    """The value of words from their valences, contexts and the bits of the modifiers that are lexicon words themselves
    (these do not modify others): capitals, then boosters and negations among the three words before, nearest first, then
    phrases, then `but`. Words outside the lexicon have the value zero."""
    boosters, modifiers, base = len(BOOSTERS), len(MODIFIERS), len(marked) + 1
    dampeners = boosters + len(DAMPENERS)
    weights = np.repeat([0.0, BOOST, -BOOST, 0.0], [1, boosters, len(DAMPENERS), base - 1 - dampeners])
    place = {w: i for i, w in enumerate(marked, 1)}

    def one_of(mark: np.ndarray, words: list[str]) -> np.ndarray:
        return np.isin(mark, [place[w] for w in words if w in place])

    def joined(*marks):
        # A phrase is a number, its words' places being the digits; the first is none of them where it is 0.
        return np.where(marks[0] > 0, reduce(lambda a, b: a * base + b, marks), -1)

    def number(phrase: str) -> int:
        return int(joined(*[np.int64(place[w]) for w in phrase.split(" ")]))

    idioms = {number(p): v for p, v in phrases.idioms.items()} if phrases else {}
    keys = np.array(sorted(idioms), np.int64)
    valences = np.array([idioms[k] for k in sorted(idioms)])
    dampening = np.array([number(p) for p in phrases.dampening] if phrases else [], np.int64)

    def with_phrases(value: np.ndarray, own: np.ndarray, before: list[np.ndarray], after: list[np.ndarray]) -> np.ndarray:
        (b1, b2, b3), (a1, a2) = before, after
        longest = [joined(b2, b1, own), joined(own, a1, a2), joined(b3, b2, b1), joined(b1, own), joined(own, a1),
                   joined(b2, b1), joined(b3, b2)]
        if len(keys):
            for phrase in reversed(longest):  # the first one is written last
                at = np.minimum(np.searchsorted(keys, phrase), len(keys) - 1)
                value = np.where((keys[at] == phrase) & ~np.isnan(value), valences[at], value)
        weaker = sum(np.isin(p, dampening).astype(int) for p in (longest[2], longest[6], longest[5]))
        least = one_of(b1, ["least"]) & ~one_of(b2, NOT_LEAST)
        return (value - BOOST * weaker) * np.where(least, NEGATE, 1.0)

    def run(valence: pa.Array, behind: pa.Array, beside: pa.Array, *known: pa.Array) -> pa.Array:
        if not len(valence):
            return pa.array([], pa.float64())
        free = np.zeros(base, bool)
        free[1:modifiers + 1] = [not known[i // HALF][0].as_py() >> i % HALF & 1 for i in range(modifiers)]
        value, behind, beside = (c.to_numpy(zero_copy_only=False) for c in (valence, behind, beside))
        marks = [behind >> d * BITS & PLACES for d in range(4)]
        caps = [beside >> 2 * BITS + d & 1 for d in range(4)]
        value = value + caps[0] * np.sign(value) * CAPITALS
        for distance, factor in enumerate(DISTANCE_FACTORS, 1):
            mark = marks[distance]
            rows = np.flatnonzero(free[mark])
            mark, old = mark[rows], value[rows]
            step = np.where(mark <= dampeners, (weights[mark] + caps[distance][rows] * CAPITALS) * factor, 0.0)
            boosted = old + np.where(old < 0, -step, step)
            changed = np.where(mark > dampeners, boosted * NEGATE, boosted)
            if phrases and distance > 1:
                nearer = [marks[d][rows] for d in range(1, distance)]
                some = lambda words: reduce(np.logical_or, [one_of(b, words) for b in nearer])
                changed = np.where(one_of(mark, ["without"]) & some([SURE]), boosted, changed)
                changed = np.where(one_of(mark, ["never"]) & some(EMPHATIC), boosted * EMPHASIS, changed)
            value[rows] = changed
        if phrases:
            value = with_phrases(value, marks[0], marks[1:], [beside >> d * BITS & PLACES for d in (0, 1)])
        return pa.array(np.nan_to_num(value * np.array([1.0, BEFORE_BUT, AFTER_BUT])[beside >> 2 * BITS + 4]))

    return F.arrow_udf(run, "double")


def lexicon_sentiment(comments: DataFrame, lexicon: DataFrame, key: str = "comment_id", text: str = "text",
                      phrases: Phrases | None = None) -> DataFrame:
    """Rows (key, neg, neu, pos, compound).

    Each word carries its three predecessors and its two successors as numbers, so the words of a comment need not be
    brought together in order; they are summed up where they are read, and one partial row per comment is shuffled.
    """
    marked = _marked(phrases)
    listed = comments.select(key, _marks(F.col(text)).cast("double").alias("marks"), F.col(text).alias("text"))
    placed = _placed_words(listed, key, marked)
    at = F.array_position(F.array(*map(F.lit, MODIFIERS)), F.col("word")).cast("int") - 1
    bits = lexicon.filter(F.col("word").isin(MODIFIERS)).select(at.alias("at"))
    known = [
        F.coalesce(bits.filter((F.col("at") / HALF).cast("int") == i).agg(
            F.bit_or(F.expr(f"shiftleft(1L, at % {HALF})"))).scalar(), F.lit(0).cast("long"))
        for i in range(ceil(len(MODIFIERS) / HALF))]
    own = lexicon.filter(~F.col("word").isin(BOOSTERS + DAMPENERS)).select("word", "valence")
    valued = placed.join(own, "word", "left").select(
        key, "marks", "word", _valued(phrases, marked)("valence", "behind", "beside", *known).alias("value"))
    value = F.col("value")
    sums = valued.groupBy(key).agg(
        F.max("marks").alias("marks"), F.sum(value).alias("total"),
        F.sum(F.when(value > 0, value + 1).otherwise(0.0)).alias("up"),
        F.sum(F.when(value < 0, 1 - value).otherwise(0.0)).alias("down"),
        F.count_if((value == 0) & F.col("word").isNotNull()).alias("flat"),
    )
    marks, up, down, total = F.col("marks"), F.col("up"), F.col("down"), F.col("total")
    stressed = total + F.when(total > 0, marks).when(total < 0, -marks).otherwise(0.0)
    summed = sums.select(
        key, "flat", stressed.alias("total"),
        (up + F.when(up > down, marks).otherwise(0.0)).alias("up"),
        (down + F.when(down > up, marks).otherwise(0.0)).alias("down"),
    )
    parts = up + down + F.col("flat")

    def share(part: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(part, parts), 3), F.lit(0.0))

    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.sqrt(total * total + NORMAL)))
    return summed.select(
        key, share(down).alias("neg"), share(F.col("flat")).alias("neu"), share(up).alias("pos"),
        F.round(compound, 4).alias("compound"),
    )


def label_lexicon(documents: DataFrame, positive: str, text: str = "text") -> DataFrame:
    """A lexicon of every word of the labelled documents: valence in [-4, 4] by the balance of good and bad ones."""
    distinct = F.array_distinct(F.transform(_words(F.col(text)), F.lower))
    seen = documents.select(F.explode(distinct).alias("word"), positive)
    counts = seen.groupBy("word").agg(F.count_if(positive).alias("good"), F.count_if(~F.col(positive)).alias("bad"))
    total = F.col("good") + F.col("bad")
    return counts.select("word", F.round((F.col("good") - F.col("bad")) * 4 / total, 3).alias("valence"))
