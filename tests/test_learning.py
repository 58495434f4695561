import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from threadwise.operators import forest, learning as L
from threadwise.operators import sentiment
from threadwise.operators.tfidf import tfidf, vocabulary
from threadwise.session import scratch_dir

LABELS = "comment_id STRING, text STRING, is_spam BOOLEAN"


def labels(table):
    spam = [(f"s{i}", f"win bitcoin prize money offer {i}", True) for i in range(12)]
    ham = [(f"h{i}", f"lovely music piano concert recording {i}", False) for i in range(36)]
    return table(LABELS, spam + ham)


@pytest.fixture(scope="module")
def model(spark):
    rows_ = [(f"s{i}", f"win bitcoin prize money offer {i}", True) for i in range(12)]
    rows_ += [(f"h{i}", f"lovely music piano concert recording {i}", False) for i in range(36)]
    return L.train_spam(spark.createDataFrame(rows_, LABELS), trees=10, depth=4)


def test_balanced_weights(table):
    assert rows(L.class_weights(labels(table)), "is_spam", "n", "weight") == [(False, 36, 48 / 72), (True, 12, 2.0)]


def test_training_separates_and_survives_a_round_trip(spark, table, model):
    new = table("comment_id STRING, text STRING", [("a", "win money and a bitcoin prize offer today"), ("b", "lovely piano concert recording and music")])
    scored = {r["comment_id"]: r for r in L.score_spam(new, model).collect()}
    assert scored["a"]["is_spam"] is True and scored["a"]["spam_score"] > 0.85
    assert scored["b"]["is_spam"] is False and scored["b"]["spam_score"] < 0.15
    folder = scratch_dir(spark, "model")
    path = L.save_model(model, folder + "/v1")
    loaded = L.load_model([folder + "/missing", path])
    again = {r["comment_id"]: r["spam_score"] for r in L.score_spam(new, loaded).collect()}
    assert again == {k: r["spam_score"] for k, r in scored.items()}
    assert L.load_model([folder + "/missing"]) is None
    top = [r["term"] for r in L.feature_importance(spark, model, 5).collect()]
    assert len(top) == 5 and set(top) <= {"win", "bitcoin", "prize", "money", "offer", "lovely", "music", "piano", "concert", "recording"}


def test_numeric_columns_beside_the_terms(spark, table):
    df = labels(table).withColumn("marks", F.when(F.col("is_spam"), 5.0).otherwise(0.0))
    model = L.train_spam(df, trees=5, depth=3, numeric=["marks"])
    assert "marks" in [r["term"] for r in L.feature_importance(spark, model, 10).collect()]
    assert L.score_spam(df, model).filter("is_spam").count() == 12


def test_no_labels_and_no_model(table):
    assert L.train_spam(table(LABELS, [])) is None
    new = table("comment_id STRING, text STRING", [("a", "a long enough text without any phrase")])
    assert tuple(L.score_spam(new, None).select("is_spam", "spam_score", "confidence").first()) == (False, 0.5, 0.5)


def test_one_class_only_is_class_one(table):
    ham = labels(table).filter("not is_spam")
    model = L.train_spam(ham, trees=3, depth=2)
    assert {r["p"] for r in L.spam_probability(ham, model).collect()} == {0.0}


def noisy(spark, n=300):
    """Labels that follow a few words with some noise, so that trees grow deep."""
    words = [f"word{chr(97 + i)}" for i in range(20)]
    return spark.createDataFrame([
        (str(i), " ".join(words[(i * k * k + k) % 20] for k in range(1, 4 + i % 5)), (i * i) % 7 < 3) for i in range(n)], LABELS)


def test_the_forest_does_not_depend_on_how_rows_are_dealt(spark):
    df = noisy(spark)
    one, other = (L.train_spam(x, trees=5, depth=12) for x in (df.coalesce(1), df.repartition(7)))
    assert sum(len(t[0]) for t in one.forest.trees()) > 50
    assert rows(L.spam_probability(df, one)) == rows(L.spam_probability(df, other))
    assert list(one.forest.importances) == list(other.forest.importances)


def test_nodes_of_many_rows_are_split_by_all_tasks(spark, monkeypatch):
    """The same trees whether a root is grown in one group or its upper nodes are split level by level."""
    df = noisy(spark).repartition(5)
    whole = L.train_spam(df, trees=3, depth=12)
    monkeypatch.setattr(L, "train_forest", lambda *a: forest.train_forest(*a, group_bytes=20 * 21))
    split = L.train_spam(df, trees=3, depth=12)
    assert len(whole.forest.rows) == 3 and len(split.forest.rows) > 12
    assert rows(L.spam_probability(df, whole)) == rows(L.spam_probability(df, split))
    assert whole.forest.importances == pytest.approx(split.forest.importances)
    assert [len(t[0]) for t in whole.forest.trees()] == [len(t[0]) for t in split.forest.trees()]


def test_best_split_against_all_cuts():
    rng = np.random.default_rng(3)
    x, y, drawn = rng.integers(0, 5, (60, 4)).astype(np.uint8), rng.integers(0, 2, 60), rng.integers(0, 3, 60)
    stats, weights, zero = forest.drawn_stats(y, drawn), np.array([0.7, 1.9]), np.zeros(60, int)
    taken, columns = np.flatnonzero(drawn), np.arange(4)[None]
    keys, sums = forest.counted(x, taken, zero[taken], columns, stats)
    got = forest.best_splits(keys, sums, stats.sum(0)[None], 4, weights, 5)

    def impurity(some):
        w = (stats[some, :2] * weights).sum(0)
        return 2 * w[0] * w[1] / w.sum()

    cuts = {}
    for column in range(4):
        for cut in range(4):
            left = x[:, column] <= cut
            if min(stats[left, :2].sum(), stats[~left, :2].sum()) >= 5:
                cuts[column, cut] = impurity(np.full(60, True)) - impurity(left) - impurity(~left)
    assert (got.slot[0], got.bin[0]) == max(cuts, key=cuts.get) and got.gain[0] == pytest.approx(max(cuts.values()))


def test_a_forest_without_one_of_its_parts_is_not_loaded(spark, model):
    folder = scratch_dir(spark, "model")
    L.save_model(model, f"{folder}/v1")
    model.forest.parts.limit(1).write.mode("overwrite").parquet(f"{folder}/v1/forest/parts")
    assert L.load_model([f"{folder}/v1"]) is None


PREDICTIONS = "video_id STRING, is_spam BOOLEAN, prediction BOOLEAN"


def test_scores_and_status(table):
    df = table(PREDICTIONS, [("v", True, True), ("v", True, False), ("v", False, False), ("v", False, True), ("v", False, False),
                             ("w", None, True)])
    got = L.classification_scores(df).first()
    assert (got["true_positive"], got["false_positive"], got["false_negative"], got["true_negative"]) == (1, 1, 1, 2)
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (0.6, 0.5, 0.5, 0.5)
    assert tuple(L.accuracy(df).first()) == (5, 0.6)
    versions = table("model_type STRING, created_at TIMESTAMP_NTZ", [("spam", at(1))])
    by_video = {r["video_id"]: r for r in L.spam_metrics(df, versions, ["video_id"]).collect()}
    assert (by_video["v"]["model_status"], by_video["v"]["train_accuracy"]) == ("trained", 0.6)
    assert (by_video["w"]["model_status"], by_video["w"]["train_accuracy"]) == ("no_data", None)
    lost = df.withColumn("prediction", F.lit(None).cast("boolean"))
    assert L.spam_metrics(lost, versions).select("model_status", "train_accuracy").first() == ("error", None)
    assert L.spam_metrics(df, versions.filter("false")).first()["model_status"] == "untrained"
    empty = L.classification_scores(df.filter("false")).first()
    assert empty["accuracy"] is None and empty["f1"] == 0.0


def test_spam_and_ham_counts(table):
    df = table(PREDICTIONS, [("v", i < 5, True) for i in range(15)])
    versions = table("model_type STRING, created_at TIMESTAMP_NTZ", [("spam", at(1))])
    got = L.spam_metrics(df, versions).first()
    assert (got["spam_samples"], got["ham_samples"], got["total_samples"]) == (5, 10, 15)


def test_registry_and_history(table):
    metrics = table("accuracy DOUBLE, total_samples BIGINT", [(0.75, 8)])
    version = L.register_version(metrics, "spam", F.lit("v1"), F.lit(at(5)), {"trees": 10})
    assert tuple(version.first()) == ("spam", "v1", '{"accuracy":0.75,"total_samples":8}', '{"trees": 10}', at(5))
    log = L.metrics_row(version).unionByName(table("model_type STRING, metrics STRING, created_at TIMESTAMP_NTZ", [
        ("spam", '{"accuracy":0.5,"total_samples":4}', at(3)), ("toxicity", "{}", at(4)), ("spam", "{}", at(1))]))
    history = L.metrics_history(log, "accuracy DOUBLE, total_samples BIGINT", days=3, as_of=F.lit(at(5)))
    assert [tuple(r) for r in history.collect()] == [(at(3), 0.5, 4), (at(5), 0.75, 8)]


def test_holdout_is_stable_and_disjoint(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("comment_id"))
    split = L.with_split(df)
    assert rows(split) == rows(L.with_split(df.repartition(7)))
    held = split.filter("split = 'holdout'").count()
    assert 300 < held < 500 and split.filter("split = 'training'").count() == 2000 - held


def test_user_scorer_loads_once_per_task(table):
    def maker():
        words = {"idiot": 0.9, "fool": 0.6}
        return lambda texts: texts.map(lambda t: {"insult": max([words.get(w, 0.0) for w in t.split()] + [0.0])})

    df = table("comment_id STRING, text STRING", [("a", "you idiot"), ("b", "nice"), ("c", "")])
    got = {r["comment_id"]: r["toxicity_scores"]["insult"] for r in L.apply_scorer(df, maker).collect()}
    assert got == {"a": 0.9, "b": 0.0, "c": 0.0}


def test_toxicity_model(table):
    df = table("text STRING, toxic INT", [(f"awful horrible idiot {i}", 1) for i in range(10)] + [(f"kind gentle words {i}", 0) for i in range(10)])
    scored = L.ToxicityModel.train(df).score(df).collect()
    assert all((r["toxicity_scores"]["toxic"] > 0.5) == (r["toxic"] == 1) for r in scored)


def test_tfidf_matches_the_formula(table):
    texts = {"a": "Red red blue the x", "b": "blue green", "c": "", "d": "red"}
    df = table("comment_id STRING, text STRING", list(texts.items()))
    assert rows(vocabulary(df)) == [("blue", 2), ("red", 2)]
    got = {(r["comment_id"], r["term"]): (r["tf"], r["weight"]) for r in tfidf(df, "comment_id").collect()}
    idf = math.log(5 / 3) + 1
    norm = math.hypot(2 * idf, idf)
    want = {("a", "red"): (2, 2 * idf / norm), ("a", "blue"): (1, idf / norm), ("b", "blue"): (1, 1.0), ("d", "red"): (1, 1.0)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


LEXICON = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("nope", -1.0)]


def compound(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_lexicon_sentiment(table):
    cases = {
        "": 0.0, "nothing here": 0.0, "a good film": compound(1.9), "a very good film": compound(1.9 + 0.293),
        "good!!!!!": compound(1.9 + 4 * 0.292), "not good": compound(1.9 * -0.74), "a GOOD film": compound(1.9 + 0.733),
        "GOOD": compound(1.9), "very plain good": compound(1.9 + 0.293 * 0.95), "bad ,but good.": compound(-2.5 * 1 + 1.9),
        "bad but good": compound(-2.5 * 0.5 + 1.9 * 1.5), "slightly bad": compound(-2.5 + 0.293), "nope good": compound(1.9 - 1.0),
        "not a very good": compound((1.9 + 0.293) * -0.74), "is it good??": compound(1.9 + 0.36), "good????": compound(1.9 + 0.96),
    }
    del cases["bad ,but good."]
    df = table("comment_id STRING, text STRING", [(t, t) for t in cases])
    lexicon = table("word STRING, valence DOUBLE", LEXICON)
    got = {r["comment_id"]: r for r in sentiment.lexicon_sentiment(df, lexicon).collect()}
    assert {t: r["compound"] for t, r in got.items()} == pytest.approx(cases, abs=1e-4)
    shares = got["a good film"]
    assert (shares["neg"], shares["pos"], shares["neu"]) == (0.0, round(2.9 / 3.9, 3), round(1 / 3.9, 3))
    assert got[""]["neu"] == 0.0


def test_phrases_by_hand(table):
    """Values worked out from the published rules, 1.9 for good and -2.5 for bad."""
    again = {  # the published order: boosters and negations from near to far, then phrases, then least
        "never so good today": 1.9 * 1.25 + 0.293 * 1.25, "never this good": 1.9 * 1.25, "never good": 1.9 * -0.74,
        "it was never quite this good": (1.9 + 0.293 * 0.95) * 1.25, "without doubt good": 1.9, "without good": 1.9 * -0.74,
        "without any doubt good": 1.9, "kind of good": 1.9 - 0.293, "a sort of bad": -2.5 - 0.293, "of kind good": 1.9,
        "least good": 1.9 * -0.74, "at least good": 1.9, "very least good": 1.9 + 0.293 * 0.95, "the least bad": -2.5 * -0.74,
        "a good egg": -1.0, "good egg": -1.0, "egg good": 1.9, "quite a good egg": -1.0, "to die for good film": 3.0,
        "film to die for good": 3.0, "good to die": 1.9, "good good egg": 1.9 - 1.0,
    }
    lexicon = table("word STRING, valence DOUBLE", LEXICON)
    phrases = sentiment.Phrases(idioms={**sentiment.IDIOMS, "good egg": -1.0})
    df = table("comment_id STRING, text STRING", [(t, t) for t in again])
    got = {r["comment_id"]: r["compound"] for r in sentiment.lexicon_sentiment(df, lexicon, phrases=phrases).collect()}
    lexical = dict(LEXICON)
    assert "doubt" not in lexical and "least" not in lexical
    want = {t: compound(v) for t, v in again.items() if t not in ("good good egg", "to die for good film")}
    assert {t: got[t] for t in want} == pytest.approx(want, abs=1e-4)
    with pytest.raises(ValueError):
        sentiment.Phrases(idioms={"one": 1.0})


def test_context_does_not_leave_its_comment(table):
    """Neighbours, capitals and `but` end with the comment, repeated keys are summed up, and unusual blanks part words."""
    texts = [("a", "not"), ("b", "good"), ("c", None), ("d", ""), ("e", "a b c"), ("f", "it was good but"), ("g", "good"),
             ("h", "GOOD"), ("h", "film"), ("i", "not\u2003\u0085\u001fgood"), ("j", "(good) ... 'bad'!!"), ("k", "to"), ("l", "die for good")]
    lexicon = table("word STRING, valence DOUBLE", [*LEXICON, ("really", 0.0)])
    df = table("comment_id STRING, text STRING", texts).coalesce(1)
    for phrases in (None, sentiment.Phrases()):
        got = {r["comment_id"]: r["compound"] for r in sentiment.lexicon_sentiment(df, lexicon, phrases=phrases).collect()}
        want = {"a": 0.0, "b": 1.9, "c": 0.0, "d": 0.0, "e": 0.0, "f": 0.95, "g": 1.9, "h": 1.9, "i": 1.9 * -0.74,
                "j": 1.9 - 2.5 - 2 * 0.292, "k": 0.0, "l": 1.9}
        assert got == pytest.approx({k: compound(v) for k, v in want.items()}, abs=1e-4)


def test_sentiment_shuffles_numbers_for_the_context(table):
    """A word goes to its valence with two numbers for all its neighbours, and no value is worked out row by row."""
    df, lexicon = table("comment_id STRING, text STRING", [("a", "x")]), table("word STRING, valence DOUBLE", LEXICON)
    plan = sentiment.lexicon_sentiment(df, lexicon, phrases=sentiment.Phrases())._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "before1" not in plan and "transform(" not in plan


def test_label_lexicon(table):
    df = table("comment_id STRING, text STRING, good BOOLEAN", [(str(i), "fine words", i < 3) for i in range(4)])
    got = rows(sentiment.label_lexicon(df, "good"))
    assert got == [("fine", 2.0), ("words", 2.0)]


