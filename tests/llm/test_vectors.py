"""Vector codes and whitening beside brute force."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadwise.llm import vectorcodes, whitening
from threadwise.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def slow_codes(rows, parts, entries, rounds, scale):
    held = [(i, v, c) for i, v, c in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(scale * float(np.float32(x)))) for x in v] for _, v, _ in held]
    size = len(whole[0]) // parts
    cut = [[w[p * size:(p + 1) * size] for w in whole] for p in range(parts)]
    least = {}
    for (i, v, _), w in zip(held, whole):
        key = (i is None, i or 0)
        least[key] = min(least.get(key, w), w)
    first = [least[k] for k in sorted(least)][:entries]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books, codes, errors = [], [[] for _ in held], [0] * len(held)
    for p in range(parts):
        book = [w[p * size:(p + 1) * size] for w in first]
        for step in range(rounds + 1):
            near = [min(range(len(book)), key=lambda k: (apart(v, book[k]), k)) for v in cut[p]]
            if step < rounds:
                for k in range(len(book)):
                    mine = [v for v, n in zip(cut[p], near) if n == k]
                    if mine:
                        book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        books += [x for entry in book for x in entry]
        for r, n in enumerate(near):
            codes[r].append(f"{n:02x}")
            errors[r] += apart(cut[p][r], book[n])
    by_label = {}
    for (_, _, c), e in zip(held, errors):
        by_label[c] = by_label.get(c, 0) + e
    digest = sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(repr((i, "".join(c), e, by_label[label], digest)) for (i, _, label), c, e in zip(held, codes, errors))


def fast_codes(df, **how):
    return sorted(repr((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]))
                  for r in vectorcodes.coded(df, **how).collect())


@pytest.mark.parametrize("entries,rounds,spread", [(16, 6, 1.0), (3, 4, 0.01), (16, 2, 0.0)])
def test_codes_are_those_of_brute_force(spark, entries, rounds, spread):
    rng = np.random.default_rng(entries)
    centre = rng.normal(0, 0.3, (12, 8))
    rows = [(int(i), (centre[i % 12] + spread * rng.normal(0, 0.1, 8)).astype(np.float32).tolist(), int(i) % 3 if i % 4 else None)
            for i in rng.permutation(300)]
    rows += [(2 ** 53 + 1, rows[0][1], 1), (None, rows[1][1], None), (7, rows[5][1], 0), rows[9], rows[9]]
    rows += [(1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1), (1004, [], 1)]
    how = dict(parts=4, entries=entries, rounds=rounds, scale=64)
    df = vectors_of(spark, rows).repartition(3).withColumn("code", F.lit("x")).withColumn("entry", F.lit(1))
    assert fast_codes(df, **how) == slow_codes(rows, **how)


def test_bounds_skip_scans_and_stay_valid():
    rng = np.random.default_rng(2)
    vectors = np.rint(np.concatenate([rng.normal(c, 40, (400, 4)) for c in rng.normal(0, 900, (8, 4))])).astype(np.int32)
    history, state, scans = [vectors[::400].astype(np.int64)[None].copy()], None, []
    for _ in range(7):
        state, n = vectorcodes.assign_part(vectors, history, 0, state)
        scans.append(n)
        d = np.sqrt(vectorcodes.distances(vectors, history[-1][0]).astype(float))
        near = d.argmin(1)
        assert (state["entry"] == near).all()
        moved, rows = vectorcodes.Displacements(history, 0), np.arange(len(d))
        others = np.where(np.arange(8) == near[:, None], np.inf, d).min(1)
        assert (state["upper"] + moved.net[state["upper_at"], near] >= d[rows, near]).all()
        assert (state["lower"] - moved.others[state["lower_at"], near] <= others).all()
        sums = np.zeros((1, 8, 5), object)
        for k in range(8):
            sums[0, k] = [int(x) for x in [*vectors[near == k].sum(0, dtype=np.int64), (near == k).sum()]]
        history.append(vectorcodes.moved_entries(history[-1], sums))
    assert scans[0] == len(vectors) and sum(scans[1:]) < 3 * len(vectors)


def test_net_displacement_is_at_most_the_sum_of_steps():
    history = [np.array([[[0, 0], [5, 5]]]), np.array([[[9, 0], [5, 6]]]), np.array([[[1, 0], [5, 5]]])]
    moved = vectorcodes.Displacements(history, 0)
    assert np.isclose(moved.net[0, 0], 1) and np.isclose(moved.net[1, 0], 8) and np.isclose(moved.net[0, 1], 0)
    assert np.isclose(moved.others[0, 0], 0) and np.isclose(moved.others[0, 1], 1)


def test_codes_of_nothing_and_of_wrong_lengths(spark):
    assert vectorcodes.coded(vectors_of(spark, [])).count() == 0
    assert vectorcodes.coded(vectors_of(spark, [(1, None, 1)])).count() == 0
    one = vectorcodes.coded(vectors_of(spark, [(1, [0.5] * 8, None)])).first()
    assert (one["code"], one["error"], one["label_error"]) == ("00" * 8, 0, 0)
    for bad in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 7, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="one length|beyond"):
            vectorcodes.coded(vectors_of(spark, bad).coalesce(1)).count()


def slow_whitening(rows, scale=64, shift=1_000_000, most=16):
    held = [(i, [int(np.floor(scale * float(np.float32(x)))) + shift for x in v]) for i, v, _ in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in held})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * x - s) / n for x, s in zip(f, sums)] for f in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    out = {}
    for i, x in held:
        away = [n * a - s for a, s in zip(x, sums)]
        projected = np.array(away, float) / n @ vectors
        out[(i, tuple(x))] = (n, sum(a * a for a in away), projected, values)
    return out, values, min(most, int((values > 1e-12 * values[0]).sum()))


@pytest.mark.parametrize("kind", ["plain", "steep", "flat"])
def test_whitening_is_that_of_the_eigenvectors(spark, kind):
    rng = np.random.default_rng(3)
    d = 20
    scales = {"plain": np.linspace(3, 1, d), "steep": 2.0 ** -np.arange(d) * 3000, "flat": np.r_[np.linspace(3, 1, 5), np.zeros(d - 5)]}
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0] if kind != "flat" else np.eye(d)
    points = (rng.normal(size=(400, d)) * scales[kind] @ turn).astype(np.float32)
    rows = [(int(i), points[i].tolist(), 0) for i in range(400)]
    rows += [rows[3], (2 ** 53 + 1, rows[4][1], 1), (None, rows[5][1], 1)]
    rows += [(1000, None, 1), (1001, [None] * d, 1), (1002, [float("nan")] * d, 1), (1003, [float("-inf")] * d, 1), (1004, [], 1)]
    df = vectors_of(spark, rows).repartition(3).withColumn("component", F.lit("x")).withColumn("n", F.lit(1))
    got = whitening.whitened(df).collect()
    want, values, k = slow_whitening(rows)
    assert len(got) == 403 * k
    signs, by_id = {}, {}
    for i, v, _ in rows[:403]:
        by_id.setdefault(i, []).append(tuple(int(np.floor(64 * float(np.float32(x)))) + 1_000_000 for x in v))
    for r in got:
        n, deviation, projected, _ = want[(r["vec_id"], by_id[r["vec_id"]][0])]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation) and 0 <= c < k
        assert r["identity_error"] < 1e-6 and np.isclose(r["explained"], values[c] / values.sum(), rtol=1e-6)
        if abs(projected[c]) > 1e-3 * np.sqrt(values[c]):
            sign = signs.setdefault(c, np.sign(r["whitened"]) * np.sign(projected[c]))
            assert np.isclose(r["whitened"], sign * projected[c] / np.sqrt(values[c]), rtol=1e-5, atol=1e-5)


def test_triangular_solve():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(9, 9))) + 4 * np.eye(9)
    a = rng.normal(size=(30, 9))
    assert np.allclose(whitening.right_solved(a, r) @ r, a)


def test_whitening_of_little(spark):
    assert whitening.whitened(vectors_of(spark, [])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, None, 0)])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, [0.5, 2.0], 0), (2, [0.5, 2.0], 0)])).count() == 0
    two = whitening.whitened(vectors_of(spark, [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)])).collect()
    assert [(r["component"], r["n"], abs(round(r["whitened"], 9)), r["explained"]) for r in two] == [(1, 2, 1.0, 1.0)] * 3
    with pytest.raises(Exception, match="one length"):
        whitening.whitened(vectors_of(spark, [(1, [0.5], 0), (2, [0.5, 1.0], 0)])).count()


def test_queries_are_registered():
    assert {"op12_vector_codes", "op13_embedding_whitening"} <= set(QUERIES) and "op12_vector_codes" in ORACLES
