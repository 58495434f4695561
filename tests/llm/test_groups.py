"""SimHash groups, components, passages: beside brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadwise.llm import components, simhash, substring
from threadwise.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS)


def find_roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (2, 3), (5, 6), (6, 6), (None, 4)], [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 80)] + [(100, 101)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = find_roots({n for e in real for n in e}, real)
    assert set(got) == set(want)
    for a, b in combinations(want, 2):
        assert (got[a] == got[b]) == (want[a] == want[b])


def test_components_leave_no_tables_with_the_driver(spark, monkeypatch):
    plans = []
    stored = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()
    assert len({r["root"] for r in got}) == 1 and len(got) == 61
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("task_edges, most", [(5000, 1), (40, 7), (0, 1000)])
def test_components_shuffle_only_many_edges(spark, monkeypatch, task_edges, most):
    """Rounds of few edges shuffle nothing, whatever the session's partitions; the roots are the same."""
    plans = []
    stored = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)]
    edges += [(7919 * i, -104729 * i) for i in range(1000, 4000)]  # enough to make the joins seem large
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()
    assert len(plans) > 4 and 0 < sum("Exchange" in p for p in plans) <= most
    want = find_roots({n for e in edges for n in e}, edges)
    assert {r["node"] for r in got} == set(want)
    assert len({(r["root"], want[r["node"]]) for r in got}) == len(set(want.values())) == 3002
    whole = connected_components(spark.createDataFrame(edges, "a long, b long"), 0).collect()
    assert sorted(got) == sorted(whole)


def test_fingerprint_is_the_majority_of_hashes():
    rng = random.Random(1)
    for text in (None, "", " \t\n", "one", "one two", "ONE Two three", "É é x", prose(rng, 200), "a b c " * 50):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_hash_is_that_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert simhash.signed(simhash.fingerprint("One two three")) == row["h"]


def test_byte_sets_meet_every_case():
    for size in (2, 3, 4, 5):
        sets = simhash.byte_sets(size)
        assert all(any(not set(s) & set(d) for s in sets) for d in combinations(range(8), 3))


@pytest.mark.parametrize("entry_rows", [4096, 8, 2])
def test_links_join_the_same_fingerprints_as_brute_force(spark, entry_rows):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(centre.tolist()) | {0, (1 << 64) - 1}
    for c in centre[:6].tolist():
        for _ in range(25):
            flips = rng.choice(64, int(rng.integers(1, 6)), replace=False)
            fps.add(c ^ sum(1 << int(f) for f in flips))
    # One dense group: all variants of one byte.
    fps |= {int(centre[7]) ^ (x << 8) for x in range(256)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps + fps[:5]], "fp long")
    links = simhash.fingerprint_links(df, 3, entry_rows).collect()
    near = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    unsigned = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links]
    assert all((a ^ b).bit_count() <= 3 for a, b in unsigned)
    assert find_roots(fps, unsigned) == find_roots(fps, near)


def test_groups_and_dedup_with_odd_rows(spark):
    rng = random.Random(2)
    base = prose(rng, 300)
    texts = [base, base, base + " tail", None, "", prose(rng, 200), prose(rng, 200), base, base, prose(rng, 4000)]
    ids = [7, 3, 5, 8, 9, 10, None, 3, None, 11]
    df = docs_of(spark, texts, ids).withColumn("fp", F.lit(1)).withColumn("id_key", F.lit("x"))
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(ids)
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    near = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    roots = find_roots(range(len(ids)), near)
    least = {}
    for i, r in roots.items():
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    want = sorted((str(ids[i]), simhash.signed(fps[i]), str(least.get(r))) for i, r in roots.items())
    assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in got) == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    kept_ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert len(kept_ids) == len(set(roots.values()))
    assert "3" in kept_ids and "8" in kept_ids and "9" not in kept_ids and "11" in kept_ids


def test_empty_tables(spark):
    df = docs_of(spark, [])
    assert simhash.simhash_groups(df).count() == 0
    assert simhash.near_dedup(df).count() == 0
    assert substring.repeated_passages(df).count() == 0
    assert substring.without_repeats(df).count() == 0


def test_bands_are_tuned_for_recall():
    bands, rows = substring.tuned_bands(30, 0.8, 0.999)
    assert (bands, rows) == (10, 3)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def jaccard(a, b):
    sets = [{tuple(t.lower().split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("block", [512, 3])
def test_paragraph_links_find_the_similar_paragraphs(spark, block):
    rng = random.Random(5)
    lines = []
    for _ in range(6):
        words = prose(rng, 80).split()
        for _ in range(6):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = prose(rng, 1)
            lines.append(" ".join(changed))
    lines += [prose(rng, 40) for _ in range(10)]
    df = docs_of(spark, lines).select(F.col("doc_id").alias("id"), F.lit(1).alias("thash"), "text")
    signer = substring.Signer(30, 0.8, 0.999)
    found = substring.units(df, signer, substring.wanted_mask(substring.repeated_keys(df, signer)))
    unit = {r["id"]: r["unit"] for r in found.where("kind = 1").collect()}
    links = [(r["a"], r["b"]) for r in substring.paragraph_links(found, df, 0.8, block).collect()]
    near = [(unit[a], unit[b]) for a, b in combinations(range(len(lines)), 2) if jaccard(lines[a], lines[b]) >= 0.8]
    assert find_roots(unit.values(), links) == find_roots(unit.values(), near)


def test_passages_are_found_inside_paragraphs_and_clean_texts_are_left(spark):
    rng = random.Random(6)
    sentence = lambda n: prose(rng, n).capitalize() + "."
    passage = " ".join(sentence(13) for _ in range(5))
    hosts = [" ".join(sentence(12) for _ in range(10)) for _ in range(6)]
    short = sentence(9)
    texts = [hosts[0] + "\n" + passage, hosts[1] + " " + passage + " " + hosts[2], passage + "\n" + hosts[3],
             hosts[4] + "\n" + short, hosts[5] + "\n" + short, None, ""]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in substring.repeated_passages(df).collect()}
    assert set(got) == {1, 2}
    assert got[1]["kept_doc_ids"] == [0] and got[1]["n_words"] >= 52 and got[2]["n_words"] == 65
    kept = {r["doc_id"]: r["text"] for r in substring.without_repeats(df).collect()}
    assert kept[0] == texts[0] and kept[3] == texts[3] and kept[4] == texts[4] and kept[2] == hosts[3]
    assert kept[1].endswith(hosts[2]) and kept[1].startswith(hosts[1])


def test_near_equal_paragraphs_and_repeated_rows(spark):
    rng = random.Random(8)
    words = prose(rng, 100).split()
    changed = words[:50] + ["other"] + words[51:]
    far = [w if i % 4 else w + "x" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(changed), " ".join(far), " ".join(words), prose(rng, 50), prose(rng, 30000)]
    df = docs_of(spark, texts, [0, 1, 2, 0, None, 9])
    got = substring.repeated_passages(df).collect()
    assert [(r["doc_id"], r["n_words"], r["kept_doc_ids"]) for r in got] == [(1, 100, [0])]
    assert sorted(str(r["doc_id"]) for r in substring.without_repeats(df).collect()) == ["0", "2", "9", "None"]


@pytest.mark.parametrize("layout", ["middle of a sentence", "short sentences", "no stops", "short lines"])
def test_passages_are_found_in_full_length_whatever_their_layout(spark, layout):
    rng = random.Random(9)
    words = [prose(rng, 20) for _ in range(3)]
    if layout == "short sentences":
        words = [" ".join(w + "." * (i % 5 == 4) for i, w in enumerate(part.split())) for part in words]
    passage = " ".join(words)
    other = passage
    if layout == "short lines":
        other = "\n".join(" ".join(passage.split()[i:i + 6]) for i in range(0, 60, 6))
    stop = "." if layout == "middle of a sentence" else ""
    hosts = [prose(rng, 300).replace(" ", "_", 1) for _ in range(4)]
    texts = [f"{hosts[0]} {passage} {hosts[1]}{stop}", f"{hosts[2]} {other} {hosts[3]}{stop}"]
    texts += [passage + " " + prose(rng, 30), prose(rng, 200)]
    df = docs_of(spark, texts, [4, 5, None, 6])
    got = {r["doc_id"]: r for r in substring.repeated_passages(df).collect()}
    assert set(got) == {5, None}
    assert (got[5]["start_word"], got[5]["n_words"], got[5]["kept_doc_ids"]) == (299, 60, [4])
    assert (got[None]["start_word"], got[None]["n_words"], got[None]["kept_doc_ids"]) == (0, 60, [4])
    kept = {r["doc_id"]: r["text"] for r in substring.without_repeats(df).collect()}
    assert kept[4] == texts[0] and kept[5].split() == f"{hosts[2]} {hosts[3]}{stop}".split() and kept[6] == texts[3]


def test_chosen_windows_are_common_to_every_run_of_fifty_words():
    rng = np.random.default_rng(10)
    for _ in range(50):
        run, sides = rng.integers(0, 1 << 62, 50, np.uint64), rng.integers(0, 1 << 62, (4, 40), np.uint64)
        found = []
        for a, b in (sides[:2], sides[2:]):
            text = np.concatenate((a, run, b))
            at, hashed = substring.chosen_windows(text, np.zeros(len(text), int))
            found.append({(s - 40, h) for s, h in zip(at.tolist(), hashed.tolist()) if 40 <= s <= 70})
        assert found[0] & found[1]
    at, _ = substring.chosen_windows(np.tile(run, 2), np.repeat([0, 1], 50))
    assert at.tolist() == [at[0], at[0] + 50]


def test_text_that_repeats_itself_keeps_its_first_window(spark):
    got = substring.repeated_passages(docs_of(spark, ["a " * 100, None])).collect()
    assert [(r["doc_id"], r["start_word"], r["n_words"], r["kept_doc_ids"]) for r in got] == [(0, 20, 80, [0])]
