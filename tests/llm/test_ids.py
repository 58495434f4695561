"""Null ids beside ids above 2^53 in one batch: no row is lost or renamed."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from threadwise.llm import lm, mixing, orderhash, packing, repetition, simhash, substring, tokens, toxicity
from threadwise.session import scratch_dir

BIG = 2 ** 53 + 1
IDS = [None, BIG, 5, -BIG, 2 ** 62 + 3]


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join(f"{chr(97 + n)}w{n}x{k}" for k in range(30 + n)), "en", "s", 0) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=str)


WANT = sorted(IDS, key=str)


def test_language_model(docs):
    assert ids(lm.scored(docs, lm.Network.new(lm.Settings(base=4, digits=3, window=2, size=6, batch=32)))) == WANT


def test_tokens(spark, docs):
    path = scratch_dir(spark, "tokens")
    tokens.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    got = tokens.read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -BIG, 5, BIG, 2 ** 62 + 3]


def test_groups_and_dedup(docs):
    groups = simhash.simhash_groups(docs)
    assert ids(groups) == WANT and ids(groups, "component_id") == WANT
    assert ids(simhash.near_dedup(docs)) == WANT


def test_mixing(docs):
    assert ids(mixing.mixed(docs)) == WANT
    # One source alone is taken once.
    assert ids(mixing.mixed_documents(docs)) == WANT


def test_the_others(docs):
    assert ids(substring.without_repeats(docs)) == WANT
    assert ids(packing.packed(docs.select("doc_id", "source", F.lit(1).alias("cluster"), F.lit(7).alias("length")))) == WANT
    assert ids(orderhash.edited_fingerprints(docs)) == WANT
    assert ids(repetition.measured(docs)) == WANT
    assert ids(toxicity.scored(docs, toxicity.fit([]))) == WANT
