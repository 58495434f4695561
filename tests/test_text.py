import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from threadwise.functions import text as X

NAMES = ["length", "word_count", "avg_word_length", "capitals_ratio", "digits_ratio", "punctuation_ratio",
         "exclamation_count", "question_count", "url_count", "has_email", "spam_word_ratio"]
#: Features worked out by hand, in the order of NAMES.
BY_HAND = {
    "": (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    "   ": (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    "Hi THERE": (8, 2, 7 / 2, 6 / 8, 0, 0, 0, 0, 0, 0, 0),
    "so far, so fun?!": (16, 4, 13 / 4, 0, 0, 3 / 16, 1, 1, 0, 0, 0),
    "look at www.site.org or http://b": (32, 5, 28 / 5, 0, 0, 5 / 32, 0, 0, 2, 0, 0),
    "mail me x@y.z": (13, 3, 11 / 3, 0, 0, 2 / 13, 0, 0, 0, 1, 0),
    "x@y": (3, 1, 3, 0, 0, 1 / 3, 0, 0, 0, 0, 0),
    "@y.z": (4, 1, 4, 0, 0, 2 / 4, 0, 0, 0, 0, 0),
    "x@y\nz.": (6, 2, 5 / 2, 0, 0, 2 / 6, 0, 0, 0, 0, 0),
    "x@y\nz.w": (7, 2, 6 / 2, 0, 0, 2 / 7, 0, 0, 0, 1, 0),
    # Upper case and digits beyond ASCII, a numeral among them.
    "ÄÖ ①² Ⅷ": (7, 3, 5 / 3, 3 / 7, 2 / 7, 0, 0, 0, 0, 0, 0),
    # Each word of the lexicon counts once as a word and once as a part of the text, hidden parts too.
    "win cash 50": (11, 3, 3, 0, 2 / 11, 0, 0, 0, 0, 0, 1),
    "know something": (14, 2, 13 / 2, 0, 0, 0, 0, 0, 0, 0, 2 / 3),
    "tab\there\nnow": (12, 3, 10 / 3, 0, 0, 0, 0, 0, 0, 0, 2 / 4),
}


def test_text_features_by_hand(spark):
    df = spark.createDataFrame([(t,) for t in BY_HAND], "text STRING")
    got = {r["text"]: tuple(r[n] for n in NAMES) for r in X.text_features(df).collect()}
    for text, want in BY_HAND.items():
        assert got[text] == pytest.approx(want, abs=1e-12), text


def test_character_shares_are_those_the_text_is_made_of(spark):
    """Texts put together from known numbers of characters of each kind."""
    rng, made = random.Random(7), []
    kinds = ["ABÉßΣ".replace("ß", "Ü"), "07²١", ".,;#@", "!", "?", "abéß中", " \t\n"]
    for i in range(60):
        numbers = [rng.randrange(9) for _ in kinds]
        letters = [rng.choice(kind) for kind, n in zip(kinds, numbers) for _ in range(n)]
        rng.shuffle(letters)
        made.append((i, "".join(letters), *numbers))
    df = spark.createDataFrame(made, "id INT, text STRING, a INT, b INT, c INT, d INT, e INT, f INT, g INT")
    for r in X.text_features(df).collect():
        size = max(1, sum(r[c] for c in "abcdefg"))
        want = (r["a"] / size, r["b"] / size, (r["c"] + r["d"] + r["e"]) / size, r["d"], r["e"])
        got = tuple(r[n] for n in NAMES[3:8])
        assert got == pytest.approx(want, abs=1e-12), r["text"]


def test_unicode_classes_cover_every_character(spark):
    """Upper case, digits, white space and word characters of the whole basic plane."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "text STRING")
    found = df.select("text", (X.capitals_ratio(F.col("text")) > 0).alias("upper"), (X.digits_ratio(F.col("text")) > 0).alias("digit"),
                      (F.size(X.words(F.col("text"))) == 0).alias("space"), (F.size(X.tokens(F.col("text"))) == 1).alias("word"))
    # Characters added by the newest Unicode version may be known to one side only.
    wrong = [r["text"] for r in found.collect()
             if (r["upper"], r["digit"], r["space"], r["word"])
             != (r["text"].isupper(), r["text"].isdigit(), r["text"].isspace(), bool(re.match(r"\w", r["text"])))]
    import unicodedata
    assert [c for c in wrong if unicodedata.ucd_3_2_0.category(c) != "Cn"] == []


def test_long_text_without_at_sign_is_linear(spark):
    df = spark.createDataFrame([("x. " * 200_000,)], "text STRING")
    assert X.text_features(df).first()["has_email"] == 0


def test_spam_word_ratio_counts_words_and_substrings(spark):
    df = spark.createDataFrame([("free Free now know",), ("",)], "text STRING")
    got = rows(X.spam_word_ratio(df), "text", "exact_hits", "lexicon_hits", "spam_word_ratio")
    assert got == [("", 0, 0, 0.0), ("free Free now know", 3, 2, 1.0)]


def test_indicators(spark):
    texts = ["$5 www.x.com free call bitcoin!!!!", "really? yes? no? why?", "PRICE €5 email me", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = {r["text"]: tuple(r[c] for c in X.INDICATORS[:6]) for r in X.spam_indicators(df).collect()}
    assert got["$5 www.x.com free call bitcoin!!!!"] == (1, 1, 1, 1, 1, 1)
    assert got["really? yes? no? why?"] == (0, 0, 0, 0, 0, 1)
    assert got["PRICE €5 email me"] == (0, 1, 0, 0, 1, 0)
    assert got[""] == (0, 0, 0, 0, 0, 0)


def verdict(spark, text, p):
    df = spark.createDataFrame([(text, p)], "text STRING, p DOUBLE")
    r = X.spam_verdict(df).first()
    return r["is_spam"], r["confidence"], r["spam_score"]


def test_verdict_rules_in_order(spark):
    long_text = "this comment has more than five plain words"
    pushy = "$5 www.x.com free call bitcoin offer!!!!"
    assert verdict(spark, "Great video!", 0.99) == (False, 0.9, 0.1)
    assert verdict(spark, "Great video! " + "x " * 60, 0.99) == (True, 0.99, 0.99)
    assert verdict(spark, long_text, None) == (False, 0.5, 0.5)
    assert verdict(spark, long_text, 0.85) == (False, 0.85, 0.85)
    assert verdict(spark, long_text, 0.86) == (True, 0.86, 0.86)
    assert verdict(spark, long_text, 0.2) == (False, 0.8, 0.2)
    assert verdict(spark, pushy, 0.76)[0] is True
    assert verdict(spark, pushy, 0.75)[0] is False
    assert verdict(spark, "one two three four", 0.99) == (False, 0.99, 0.99)
    assert verdict(spark, "a b c d e f", 0.99) == (False, 0.99, 0.99)
