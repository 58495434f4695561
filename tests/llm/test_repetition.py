"""Repetition coverage beside a count word by word."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadwise.llm import repetition
from threadwise.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = repetition.Rules()


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = lambda n: [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    often = Counter(grams(3))
    inside = {i + j for i, g in enumerate(grams(3)) if often[g] > 1 for j in range(3)}
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
           "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(inside),
           "line_chars": sum(map(len, lines)),
           "dup_line_chars": sum(len(x) for i, x in enumerate(lines) if x in lines[:i])}
    for n in RULES.ngrams:
        seen, held = set(), set()
        for i, g in enumerate(grams(n)):
            held |= {i + j for j in range(n)} if g in seen else set()
            seen.add(g)
        out[f"covered_{n}"] = sum(len(words[i]) for i in held)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    over = 100 * out["dup_line_chars"] > 20 * out["line_chars"] or any(
        100 * out[f"covered_{n}"] > most * out["word_chars"] for n, most in RULES.ngrams.items())
    return out | {"base_failed": failed, "kept": not failed and not over}


def some_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abéß漢😀#|<") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a b a b", "x\n", "\nx", "x\n\nx\nx \n x", "#*$%&|<> # \n#",
             "a " * 200, "a b c " * 80, "q w e r t\n" * 30, "é\n" * 10 + "ab\r\nab\r\n"]
    for n in (1, 2, 3, 4, 9, 10, 60, 300):
        few, plain = [word() for _ in range(max(2, n // 3))], [word() + str(i) for i in range(n)]
        joined = lambda ws: "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in ws)
        texts += [joined(rng.choices(few, k=n)), joined(plain), joined(plain) + joined(plain[:n // 4]), joined(plain[:n // 2] * 2)]
    return texts + texts[9:12]


def found_by(texts, measurer):
    data, ends = repetition.text_bytes(pa.array(texts, pa.string()))
    c = measurer.counts(data, ends)
    c |= measurer.verdict(c)
    return [{k: v[i].item() for k, v in c.items()} for i in range(len(texts))]


def test_counts_are_those_of_brute_force():
    texts, measurer = some_texts(), repetition.Measurer(RULES)
    want = [slow_counts(t) for t in texts]
    assert found_by(texts, measurer) == want
    # The neighbours in a batch make no difference, nor does a slice of an Arrow array.
    assert [found_by([t], measurer)[0] for t in texts] == want
    sliced = pa.array(["zz"] + texts, pa.string()).slice(1)
    data, ends = repetition.text_bytes(sliced)
    assert measurer.counts(data, ends)["n_words"].tolist() == [w["n_words"] for w in want]
    assert any(w["kept"] for w in want) and any(not w["kept"] and not w["base_failed"] for w in want)


def test_rolling_hash_is_that_of_the_stretch_alone():
    rng = np.random.default_rng(1)
    values, powers = rng.integers(0, 1 << 63, 500, dtype=np.uint64), repetition.Powers(repetition.WORD_FACTOR)
    rolling = repetition.Rolling(values, powers)
    for start, end in ((0, 0), (0, 500), (7, 12), (488, 500)):
        alone = repetition.Rolling(values[start:end], powers)
        assert rolling.of(np.array([start]), np.array([end])) == alone.of(np.array([0]), np.array([end - start]))
    assert len(set(rolling.of(np.arange(490), np.arange(10, 500)).tolist())) == 490


def test_very_long_text_and_slices(spark, monkeypatch):
    monkeypatch.setattr(repetition, "SLICE_BYTES", 64)
    long = " ".join(f"w{i * i % 9973}" for i in range(40_000))
    rows = [(1, long, "x"), (None, long, "x"), (2 ** 53 + 1, None, None), (5, "", "x"), (5, "", "x"), (6, "é b c " * 30, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string").withColumn("kept", F.lit(1))
    got = repetition.measured(df).collect()
    want = [(i, *slow_counts(t).values()) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = repetition.without_repetition(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {
        i for i, t, _ in rows if slow_counts(t)["kept"]}
    assert repetition.measured(df.limit(0)).count() == 0 and repetition.without_repetition(df.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{4: 1}, {3: 4, 12: 1}])
def test_other_lengths(spark, limits):
    rules = repetition.Rules(ngrams=limits)
    text = "a b c d e f g h " * 2 + " ".join(map(str, range(90)))
    c = found_by([text], repetition.Measurer(rules))[0]
    assert c[f"covered_{min(limits)}"] == 8 and not c["kept"] and not c["base_failed"]


def test_query_is_registered():
    assert "op11_repetition_coverage" in QUERIES and "op11_repetition_coverage" in ORACLES
