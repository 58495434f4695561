"""Language model, packing, mixing, toxicity, pipeline and the registered queries."""

import re
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadwise.llm import lm, mixing, packing, queries, toxicity
from threadwise.llm.shared import fresh

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = lm.Settings(base=4, digits=3, window=2, size=6, batch=32)


def docs_of(spark, rows):
    """Documents from (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


# Language model

def slow_score(net, ids):
    """Summed log-probability of the ids, one word and one digit at a time."""
    s, total = net.settings, 0.0
    for t, x in enumerate(ids):
        reach = np.zeros(s.size)
        for j, o in enumerate(net.offsets()):
            if 0 <= t + o < len(ids):
                reach = reach + net.words[ids[t + o]] * net.places[j]
        digits = [x // s.base ** k % s.base for k in range(s.digits)]
        for k, d in enumerate(digits):
            if k:
                reach = reach + net.earlier[k - 1][digits[k - 1]]
            z = np.tanh(reach) @ net.out[k] + net.bias[k]
            total += z[d] - np.log(np.exp(z).sum())
    return total


def test_probabilities_of_all_words_sum_to_one():
    net = lm.Network.new(SMALL)
    ids = [3, 17, 40, 8]
    others = [slow_score(net, ids[:2] + [x] + ids[3:]) for x in range(SMALL.symbols)]
    padded = [np.concatenate([[-1, -1], ids[:2], [x], ids[3:], [-1, -1]]) for x in range(SMALL.symbols)]
    assert np.isclose(sum(np.exp(net.forward(p)[0][2]) for p in padded), 1, atol=1e-5)
    assert np.allclose(others, [net.forward(p)[0].sum() for p in padded], atol=1e-4)


def test_gradient_is_that_of_the_loss():
    net = lm.Network.new(SMALL)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    padded = np.array([-1, -1, 5, 9, 33, -1, -1, 60, 5, -1, -1])
    grads, rng = net.gradients(padded), np.random.default_rng(1)
    for name in net.NAMES:
        value = getattr(net, name)
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            if name == "words":
                at = (int(rng.choice([5, 9, 33, 60])), at[1])
            loss = []
            for step in (1e-4, -1e-4):
                value[at] += step
                loss.append(-np.float64(net.forward(padded)[0]).sum())
                value[at] -= step
            assert np.isclose(grads[name][at], (loss[0] - loss[1]) / 2e-4, atol=2e-2, rtol=5e-2)


def test_blocks_hold_every_word_once_with_its_window():
    texts = ["a b c", None, "", "d " * 100, "e", "f g " * 40]
    net, want = lm.Network.new(SMALL), []
    for t in texts:
        want.append(slow_score(net, lm.symbols(t, SMALL.symbols, {}).tolist()))
    got = np.zeros(len(texts))
    for owner, ids in lm.padded_blocks(texts, SMALL, {}):
        logp, (_, _, real) = net.forward(ids)
        got += np.bincount(owner[real], logp[real], len(texts))
    assert np.allclose(got, want, atol=1e-2)


def test_training_on_all_documents_beats_word_counts_on_others(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(  # noqa: E731  every word is told by its neighbours
        f"{x} n{x} {x}" for x in rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], n))
    rows = [(i, text(150), "s") for i in range(60)] + [(60, None, None), (None, "", "s"), (60, "aa", "s")]
    df = docs_of(spark, rows).repartition(3).withColumn("task", F.lit(1))
    settings = lm.Settings(batch=256)
    net = lm.train(df, settings)
    other = docs_of(spark, [(0, text(200), "s"), (1, " ".join(rng.permutation(text(200).split())), "s"), (2, None, "s")])
    got = {r["doc_id"]: r for r in lm.scored(other, net).collect()}
    entropy = -np.log(12) + np.log(2) * 0  # twelve words, close to uniform over the six that stand twice
    assert got[0]["mean_log_likelihood"] > entropy / 2 > got[1]["mean_log_likelihood"]
    assert (got[2]["n_words"], got[2]["log_likelihood"], got[2]["mean_log_likelihood"]) == (0, 0.0, None)
    assert lm.scored(df, net).count() == len(rows)
    assert lm.scored(df.limit(0), lm.train(df.limit(0), settings)).count() == 0


def test_models_are_averaged_by_their_words(spark):
    values = [(m, np.full(3, m, np.float32), np.array([m, 0, 1], np.float32)) for m in range(1, 8)]
    df = spark.createDataFrame(
        [(m, "words", 0, bytearray(w.tobytes()), bytearray(v.tobytes())) for m, v, w in values],
        "model long, name string, part int, weight binary, value binary")
    row = lm._averaged(df, 2).collect()
    assert len(row) == 1
    got = np.frombuffer(row[0]["value"], np.float32)
    assert np.isclose(got[0], sum(m * m for m in range(1, 8)) / 28) and np.isclose(got[2], 4)


# Packing

def slow_best_fit(lengths, marks, capacity):
    bins, places = [], []
    for n, m in zip(lengths, marks):
        fits = [(room, b) for b, (room, held) in enumerate(bins) if room >= n and not held & m]
        if fits:
            room, b = min(fits)
        else:
            room, b = capacity, len(bins)
            bins.append((capacity, 0))
        places.append((b, capacity - room))
        bins[b] = (room - n, bins[b][1] | m)
    return places


def test_best_fit_is_the_tightest_compatible_bin():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 40, 80).tolist()
        marks = [1 << int(rng.integers(4)) | (1 << 4 + int(rng.integers(10))) for _ in lengths]
        assert packing.best_fit(lengths, marks, 40) == slow_best_fit(lengths, marks, 40)


@pytest.mark.parametrize("group", [4096, 7])
def test_packed_keeps_every_word_and_every_rule(spark, group):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{i % 3}" if i % 2 else None, int(i % 7), int(rng.integers(0, 60))) for i in range(120)]
    rows += [(200, "s1", None, 250), (201, "s1", 1, None), (202, "s1", 1, -3), (203, None, None, 10), (203, None, None, 10),
             (None, "s2", 5, 12), (7, "s1", 0, 50), (7, "s1", 0, 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, cluster long, length long, bin_id string")
    got = packing.packed(df, 50, group).collect()
    total = Counter()
    bins = defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]].append(r)
    want = Counter()
    for i, _, _, n in rows:
        if n and n > 0:
            want[i] += n
    assert total == want
    for held in bins.values():
        held.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in held:
            assert r["bin_offset"] == at and r["n_words"] > 0
            at += r["n_words"]
        assert at <= 50
        assert len({r["source"] for r in held}) == len(held) == len({r["cluster"] for r in held})
    assert [r["start"] for r in sorted((r for r in got if r["doc_id"] == 200), key=lambda r: r["piece"])] == [0, 50, 100, 150, 200]
    assert packing.packed(df.limit(0)).count() == 0


def test_bins_are_the_same_whatever_the_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"s{i % 5}", i, int(rng.integers(1, 60))) for i in range(900)]
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (1, 4, 50):
        df = spark.createDataFrame(rows, "doc_id long, source string, cluster long, length long").repartition(partitions)
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            bins = defaultdict(set)
            for r in packing.packed(df, 60, 200).collect():
                bins[r["bin_id"]].add((r["doc_id"], r["piece"]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        found.append(sorted(map(sorted, bins.values())))
    assert found[0] == found[1] == found[2]
    # Five groups of about 200: best fit leaves little room in them.
    assert len(found[0]) <= 1.15 * sum(r[3] for r in rows) / 60


# Mixing

def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        share = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix_meets_each_target(spark):
    rng = np.random.default_rng(6)
    sizes = {"a": 40, "b": 3, "": 25, "é": 60, "Z": 1, None: 20}
    rows = [(i, "w " * int(rng.integers(0, 30)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(900, None, "a"), (901, "", "empty"), (None, "x y", "a"), (None, "x y", "a"), (5, "x\x0by\x1cz", "b"), (902, "long " * 5000, "c")]
    df = docs_of(spark, rows).withColumn("size", F.lit("x")).repartition(4)
    got = mixing.mixed(df).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    real = Counter()
    for _, t, s in rows:
        real[s] += count(t)
    want = slow_targets(dict(real))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), count(t)) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["source_size"], round(r["target"], 6)].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert Counter((real[s], round(want[s], 6)) for s in real) == Counter(list(by))
    for (_, target), held in by.items():
        assert abs(sum(r["taken"] for r in held) - target) <= 0.51
        epochs = sorted({r["taken"] / r["size"] for r in held if r["size"]})
        assert len([e for e in epochs if e != int(e)]) <= 1 and (not epochs or epochs[-1] - epochs[0] <= 1)
    again = mixing.mixed(df).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = Counter(r["doc_id"] for r in mixing.mixed_documents(df).collect())
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            assert mixed[r["doc_id"]] == (-(-r["taken"] // r["size"]) if r["size"] else 0)
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


# Toxicity

def test_pairs_of_terms_are_learned():
    rng, rows = np.random.default_rng(7), []
    for _ in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        terms = ["idiot"] * insult + ["zebras"] * group + [f"w{x}" for x in rng.integers(0, 50, 8)]
        rows.append({"toxic": int(insult and group), "found": toxicity.term_buckets(" ".join(terms), 1 << 20).astype("<i4").tobytes()})
    machine = toxicity.fit(rows)
    scores = [machine.score(t) for t in ("idiot w1", "zebras w2", "idiot zebras w3", "", None)]
    assert scores[2] > 0.8 and max(scores[0], scores[1], *scores[3:]) < 0.3
    weights = dict(zip(machine.terms.tolist(), range(len(machine.terms))))
    a, b = (weights[int(toxicity.term_buckets(t, 1 << 20)[0])] for t in ("idiot", "zebras"))
    assert machine.factors[a] @ machine.factors[b] > 0.5  # the pair adds what the two terms do not


def labelled(rng, n, label, terms=60, extra=6):
    """Rows of `fit` out of label(insult, group), with n documents of two telling words and some others."""
    rows = []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["idiot"] * a + ["zebras"] * b + [f"w{x}" for x in rng.integers(0, terms, extra)]
        rows.append({"toxic": int(label(a, b)),
                     "found": toxicity.term_buckets(" ".join(words), 1 << 20).astype("<i4").tobytes()})
    return rows


def test_pair_whose_members_are_neutral_alone():
    machine = toxicity.fit(labelled(np.random.default_rng(11), 1200, lambda a, b: a != b))
    two = [int(toxicity.term_buckets(t, 1 << 20)[0]) for t in ("idiot", "zebras")]
    assert set(two) <= set(machine.terms.tolist())
    alone, both, none = (machine.score(t) for t in ("idiot w1", "idiot zebras w2", "w3 w4"))
    assert alone > 0.8 and machine.score("zebras w5") > 0.8 and both < 0.2 and none < 0.2


def test_fit_holds_few_copies_of_the_entries():
    rng, rows = np.random.default_rng(17), []
    for i in range(2500):
        found = np.unique(np.append(rng.integers(0, 3000, 600), [5000] * (i % 2)))
        rows.append({"toxic": i % 2, "found": found.astype("<i4").tobytes()})
    tracemalloc.start()
    try:
        machine = toxicity.fit(rows, toxicity.Settings(steps=2))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert machine.terms.tolist() == [5000]
    assert peak < 12 * sum(len(r["found"]) for r in rows) + (16 << 20)  # the entries' bytes, and the blocks worked on at once


@pytest.mark.parametrize("label", [lambda a, b: a != b, lambda a, b: a == b])
def test_pairs_are_those_of_a_double_loop(label):
    rows = labelled(np.random.default_rng(13), 300, label, terms=30)
    found = [set(np.frombuffer(r["found"], "<i4").tolist()) for r in rows]
    y = [r["toxic"] for r in rows]
    terms = sorted(set().union(*found))
    at = np.concatenate([np.searchsorted(terms, sorted(f)) for f in found])
    doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
    p = sum(y) / len(y)

    def off(n, t, share):
        return (t - n * share) / (n * share * (1 - share) + 1) ** 0.5

    def counts(*of):
        held = [i for i, f in enumerate(found) if set(of) <= f]
        return len(held), sum(y[i] for i in held)

    single = {t: counts(t) for t in terms}
    z = {t: abs(off(*single[t], p)) for t in terms}
    limit = (16 + 4 * np.log(sum(n > 1 for n, _ in single.values()))) ** 0.5
    want = set()
    for i, a in enumerate(terms):
        for b in terms[i + 1:]:
            n, t = counts(a, b)
            stronger = a if z[a] >= z[b] else b
            share = single[stronger][1] / single[stronger][0]
            kept = max(z[a], z[b]) >= 4
            most, least = (share, share) if kept else (max(share, p), min(share, p))
            if off(n, t, most) >= limit or -off(n, t, least) >= limit:
                want |= {a, b}
    for cells in (7, 1 << 20):
        got = toxicity.in_pairs(doc, at, np.array(y, float), len(terms), 4.0, cells)
        assert {terms[i] for i in np.flatnonzero(got)} == want and want
    by_chance = np.random.default_rng(1).permutation(np.array(y, float))
    assert not toxicity.in_pairs(doc, at, by_chance, len(terms), 4.0).any()


def test_machine_against_double_loop_and_its_gradient_against_differences():
    rng = np.random.default_rng(14)
    words = ["alpha", "beta", "gamma", "delta"]
    order = sorted(words, key=lambda w: int(toxicity.term_buckets(w, 1 << 20)[0]))
    weights, factors = rng.normal(size=4), rng.normal(size=(4, 3))
    machine = toxicity.Machine(1 << 20, 0.3, np.concatenate([toxicity.term_buckets(w, 1 << 20) for w in order]), weights, factors)
    for text in ("alpha", "beta delta", "alpha BETA gamma delta alpha other", "", None):
        here = [order.index(w) for w in dict.fromkeys((text or "").lower().split()) if w in order]
        z = 0.3 + sum(weights[i] for i in here) + sum(
            float(np.dot(factors[i], factors[j])) for i in here for j in here if i < j)
        assert np.isclose(machine.score(text), 1 / (1 + np.exp(-z)))

    theta, doc, at = rng.normal(size=(5, 4)), np.array([0, 0, 1, 1, 1, 3]), np.array([0, 2, 0, 1, 3, 2])
    y, decay = np.array([1.0, 0, 1, 0]), np.array([0.1, 0.2, 0.2, 0.2])

    def loss(theta):
        total = 0.0
        for d, label in enumerate(y):
            here = at[doc == d]
            z = theta[-1, 0] + theta[here, 0].sum() + sum(
                theta[i, 1:] @ theta[j, 1:] for i in here for j in here if i < j)
            total -= label * np.log(toxicity.sigmoid(z)) + (1 - label) * np.log(1 - toxicity.sigmoid(z))
        return total / len(y) + 0.5 * (decay * theta[:-1] ** 2).sum()

    grad = toxicity.slopes(theta, doc, at, y, decay)
    for i, j in np.ndindex(theta.shape):
        if i == 4 and j:
            continue
        step = np.zeros_like(theta)
        step[i, j] = 1e-5
        assert np.isclose(grad[i, j], (loss(theta + step) - loss(theta - step)) / 2e-5, atol=1e-6)


INSULTS = "moron idiot stupid trash scum pathetic disgusting worthless clown loser".split()


def test_scores_of_held_out_documents(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(df, labels)
    held = toxicity.scored(df, machine).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select(
        "score", "toxic", F.size(F.array_intersect(F.split(F.lower("text"), r"\W+"), F.array(*map(F.lit, INSULTS)))).alias(
            "insults")).collect()
    hits = [r for r in held if r["insults"] > 1]
    assert len(hits) > 50 and all(r["score"] >= 0.3 for r in hits)
    clean = [r for r in held if not r["toxic"]]
    assert sum(r["score"] >= 0.3 for r in clean) <= 0.01 * len(clean)


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "nice words here " + ("idiot scum" if i % 4 == 0 else f"fine {i}"), "s") for i in range(80)]
    rows += [(None, "idiot scum", None), (100, None, "s"), (101, "", "s"), (8, "idiot scum", "s"), (102, "scum " * 50000, "s")]
    df = docs_of(spark, rows).withColumn("score", F.lit("own")).withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(4, 1), (None, 1), (5, None), (999, 1)],
                                   "doc_id long, toxic int")
    machine = toxicity.train(df, labels)
    assert toxicity.scored(df, machine, "s2").count() == len(rows)
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns
    assert all("idiot" not in (r["text"] or "") and r["score"] == "own" for r in kept.collect())
    assert {r["doc_id"] for r in kept.collect()} - {102} == {i for i in range(80) if i % 4} | {100, 101}
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert toxicity.scored(df, toxicity.train(df, none), "s2").where("s2 >= 0 and s2 <= 1").count() == len(rows)
    assert toxicity.without_toxic(df.limit(0), labels).count() == 0
    assert fresh(df, "Score") == "Score_"


def test_labels_of_held_out_documents_are_not_read(spark):
    df = docs_of(spark, [(i, f"w{i}", "s") for i in range(50)])
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    rows = toxicity.labelled_terms(df, labels, toxicity.Settings())
    assert {r["id"] for r in rows} == {i for i in range(50) if crc32(str(i).encode()) % 4 != 2}
    assert len(toxicity.labelled_terms(df, labels, toxicity.Settings(sample=7))) == 7


# Pipeline and queries

def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns and at.schema.simpleString() == docs.schema.simpleString()
        kept[name] = at = spark.createDataFrame(at.collect(), docs.schema)
    ids = {n: Counter(r["doc_id"] for r in d.collect()) for n, d in kept.items()}
    assert len(ids["toxicity"]) >= 170
    assert max(ids["simhash_near_dedup"].values()) == 1 and len(ids["simhash_near_dedup"]) < len(ids["toxicity"])
    assert set(ids["substring_dedup"]) <= set(ids["simhash_near_dedup"])
    assert max(ids["mixing"].values()) in (2, 3)
    packed = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        packed[r["doc_id"]] += r["n_words"]
    size = {r["doc_id"]: len(r["text"].split()) for r in kept["substring_dedup"].collect()}
    assert packed == Counter({i: n * size[i] for i, n in ids["mixing"].items()})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_covers_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    whole = lambda t, c: {r[0] for r in con.execute(f"select {c} from '{SF}/{t}.parquet'").fetchall()}
    if name.startswith("op4"):
        assert {r["query_id"] for r in df.collect()} == {i for i in whole("embeddings", "vec_id") if i % 100 == 0}
    elif name.startswith(("op12", "op13")):
        assert {r["vec_id"] for r in df.collect()} == whole("embeddings", "vec_id")
    elif name.startswith("op5"):
        assert df.count() == con.execute(f"select count(*) from '{SF}/conversations.parquet'").fetchone()[0]
    elif name.startswith("op6") or name == "pipeline":
        assert {r["doc_id"] for r in df.collect()} <= whole("documents", "doc_id")
    else:
        assert {r["doc_id"] for r in df.collect()} == whole("documents", "doc_id")
    assert Path(SF).exists()
