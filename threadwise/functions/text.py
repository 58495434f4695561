"""Text expressions: spam features, lexicon hits, whitelist and rule indicators.

The operators materialise `lower(text)` and the word list once per row in their own projection. Higher-order
functions are not covered by Spark's common-subexpression elimination, and Spark keeps a projection apart
when its costly columns are used more than once.
"""

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C
from threadwise.functions import patterns as P

FEATURES = [
    "length", "word_count", "avg_word_length", "capitals_ratio", "digits_ratio", "punctuation_ratio",
    "exclamation_count", "question_count", "url_count", "has_email", "spam_word_ratio",
]
INDICATORS = [
    "has_url", "has_price", "has_crypto", "has_promotion", "has_contact", "excessive_punctuation", "all_caps_ratio",
]
_LOW, _WORDS = "__low", "__words"


def words(low: Column) -> Column:
    """Space-separated words of a text."""
    return F.array_remove(F.split(low, P.SPACES), "")


def tokens(low: Column) -> Column:
    """Runs of word characters."""
    return F.array_remove(F.split(low, P.NOT_WORD), "")


def long_tokens(low: Column) -> Column:
    """Runs of at least three word characters."""
    return F.regexp_extract_all(low, F.lit(P.LONG_WORD), F.lit(0))


def char_length(text: Column) -> Column:
    return F.length(text).cast("bigint")


def char_count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("bigint")


def _per_char(count: Column, text: Column) -> Column:
    return count / F.greatest(F.length(text), F.lit(1))


def capitals_ratio(text: Column) -> Column:
    return _per_char(F.length(F.regexp_replace(text, P.NOT_UPPER, "")), text)


def digits_ratio(text: Column) -> Column:
    return _per_char(F.length(F.regexp_replace(text, P.NOT_DIGIT, "")), text)


def punctuation_ratio(text: Column) -> Column:
    kept = F.translate(text, P.ASCII_PUNCTUATION, "")
    return _per_char(F.length(text) - F.length(kept), text)


def contains_any(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def lexicon_pattern(lexicon: list[str]) -> str:
    """Pattern that captures, at every place of a text, the longest lexicon entry starting there.

    The look-ahead takes no characters, so overlapping entries are all found. Entries are grouped by first
    character, which rules out most places at once.
    """
    groups: dict[str, list[str]] = {}
    for entry in sorted(lexicon, key=len, reverse=True):
        groups.setdefault(entry[0], []).append(re.escape(entry[1:]))
    firsts = "".join(re.escape(first) for first in groups)
    branches = "|".join(f"{re.escape(first)}(?:{'|'.join(rests)})" for first, rests in groups.items())
    return f"(?=[{firsts}])(?=({branches}))"


def lexicon_hits(low: Column, lexicon: list[str]) -> Column:
    """Number of lexicon entries found anywhere in the text, in one pass over it.

    An entry hidden behind a longer one with the same beginning is counted with that one.
    """
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(lexicon_pattern(lexicon)), F.lit(1)))
    longer = {e: [x for x in lexicon if x != e and x.startswith(e)] for e in lexicon}
    hidden = [
        F.when(F.arrays_overlap(found, F.array(*[F.lit(x) for x in others])), F.array(F.lit(entry)))
        .otherwise(F.array().cast("array<string>"))
        for entry, others in longer.items() if others
    ]
    return F.size(F.array_distinct(F.concat(found, *hidden))).cast("bigint")


def exact_hits(word_list: Column, lexicon: list[str]) -> Column:
    """Number of words that are lexicon entries, with multiplicity."""
    return F.size(F.filter(word_list, lambda w: w.isin(lexicon))).cast("bigint")


def whitelist_match(text: Column, low: Column | None = None) -> Column:
    """A short text holding a friendly phrase."""
    low = F.lower(text) if low is None else low
    return (F.length(text) < C.WHITELIST_MAX_CHARS) & contains_any(low, C.WHITELIST_PHRASES)


def _prepared(df: DataFrame, text: str) -> DataFrame:
    with_low = df.withColumn(_LOW, F.lower(F.col(text)))
    return with_low.withColumn(_WORDS, words(F.col(_LOW)))


def _spam_word_ratio(lexicon: list[str]) -> tuple[Column, Column, Column]:
    exact = exact_hits(F.col(_WORDS), lexicon)
    entries = lexicon_hits(F.col(_LOW), lexicon)
    ratio = F.least((exact + entries) / (F.size(_WORDS) + 1), F.lit(1.0))
    return exact, entries, ratio


def text_features(df: DataFrame, text: str = "text", lexicon: list[str] | None = None) -> DataFrame:
    """Add the eleven feature columns of a text."""
    t, word_list = F.col(text), F.col(_WORDS)
    count = F.size(word_list)
    columns = {
        "length": char_length(t),
        "word_count": count.cast("bigint"),
        "avg_word_length": F.length(F.array_join(word_list, "")) / F.greatest(count, F.lit(1)),
        "capitals_ratio": capitals_ratio(t),
        "digits_ratio": digits_ratio(t),
        "punctuation_ratio": punctuation_ratio(t),
        "exclamation_count": char_count(t, "!"),
        "question_count": char_count(t, "?"),
        "url_count": F.size(F.filter(word_list, lambda w: w.contains("http") | w.contains("www."))).cast("bigint"),
        "has_email": t.rlike(P.EMAIL).cast("bigint"),
        "spam_word_ratio": _spam_word_ratio(lexicon or C.SPAM_WORDS)[2],
    }
    return _prepared(df, text).withColumns(columns).drop(_LOW, _WORDS)


def spam_word_ratio(df: DataFrame, text: str = "text", lexicon: list[str] | None = None) -> DataFrame:
    """Add exact_hits, lexicon_hits and their capped share of the words."""
    exact, entries, ratio = _spam_word_ratio(lexicon or C.SPAM_WORDS)
    columns = {"exact_hits": exact, "lexicon_hits": entries, "spam_word_ratio": ratio}
    return _prepared(df, text).withColumns(columns).drop(_LOW, _WORDS)


def indicator_columns(text: Column, low: Column) -> dict[str, Column]:
    def flag(condition: Column) -> Column:
        return condition.cast("bigint")

    return {
        "has_url": flag(contains_any(low, ["http", "www."])),
        "has_price": flag(contains_any(text, ["$", "€"]) | low.contains("price")),
        "has_crypto": flag(contains_any(low, ["crypto", "bitcoin", "eth"])),
        "has_promotion": flag(contains_any(low, ["discount", "offer", "free"])),
        "has_contact": flag(contains_any(low, ["contact", "email", "call"])),
        "excessive_punctuation": flag((char_count(text, "!") > 3) | (char_count(text, "?") > 3)),
        "all_caps_ratio": capitals_ratio(text),
    }


def spam_indicators(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the seven rule indicators."""
    prepared = df.withColumn(_LOW, F.lower(F.col(text)))
    return prepared.withColumns(indicator_columns(F.col(text), F.col(_LOW))).drop(_LOW)


def spam_verdict(df: DataFrame, probability: str = "p", text: str = "text") -> DataFrame:
    """Add is_spam, confidence, spam_score and whitelist_match from a spam probability and the text.

    A NULL probability means that no model is trained yet. Rules apply in order: whitelist, untrained,
    short text, high probability, several indicators with a fairly high probability.
    """
    t, p = F.col(text), F.col(probability).cast("double")
    low, word_list = F.col(_LOW), F.col(_WORDS)
    indicator_sum = reduce(add, indicator_columns(t, low).values())
    short = (F.length(t) < C.SHORT_TEXT_CHARS) | (F.size(word_list) < C.SHORT_TEXT_WORDS)
    flagged = (p > C.SPAM_FLAG_ABOVE) | ((indicator_sum >= C.RULE_MIN_INDICATORS) & (p > C.RULE_FLAG_ABOVE))
    friendly = F.col("whitelist_match")
    prepared = _prepared(df, text).withColumn("whitelist_match", whitelist_match(t, low))
    return prepared.withColumns({
        "is_spam": F.when(friendly | p.isNull() | short, F.lit(False)).otherwise(flagged),
        "confidence": F.when(friendly, F.lit(C.WHITELIST_CONFIDENCE))
        .when(p.isNull(), F.lit(C.UNTRAINED_SCORE)).otherwise(F.greatest(p, 1.0 - p)),
        "spam_score": F.when(friendly, F.lit(C.WHITELIST_SCORE))
        .when(p.isNull(), F.lit(C.UNTRAINED_SCORE)).otherwise(p),
    }).drop(_LOW, _WORDS)
