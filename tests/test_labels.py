from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from threadwise.functions import labels as L
from threadwise.plans import analyze


def test_content_class_at_the_edges(table):
    cases = {(0.0, 0.85): "spam", (0.9, 0.85): "spam", (0.8, 0.84): "toxic", (0.79, 0.0): "questionable", (0.5, 0.0): "questionable",
             (0.49, 0.6): "questionable", (0.49, 0.59): "safe"}
    df = table("t DOUBLE, s DOUBLE", list(cases)).withColumn("c", L.content_class(F.col("t"), F.col("s")))
    assert {(r["t"], r["s"]): r["c"] for r in df.collect()} == cases


def test_sentiment_label_cut_is_exclusive(table):
    df = table("c DOUBLE", [(0.05,), (0.051,), (-0.05,), (-0.051,)]).withColumn("s", L.sentiment_label(F.col("c")))
    assert [r["s"] for r in df.collect()] == ["neutral", "positive", "neutral", "negative"]


def test_split_classification(table):
    df = table("c STRING", [(None,), ("",), ("spam",), ("spam:negative",)])
    content, sentiment = L.split_classification(F.col("c"))
    got = [tuple(r) for r in df.select(content, sentiment).collect()]
    assert got == [("unclassified", "neutral"), ("unclassified", "neutral"), ("spam", "neutral"), ("spam", "negative")]


def test_toxicity_summary(table):
    schema = "id INT, toxicity ARRAY<STRUCT<label STRING, score DOUBLE>>"
    df = table(schema, [(1, [("a", 0.2), ("b", 0.7), ("c", 0.7), ("d", 0.31), ("e", 0.3)]), (2, []), (3, None)])
    got = {r["id"]: (r["main_category"], r["toxicity_score"], [e["label"] for e in r["other_concerns"]])
           for r in L.toxicity_summary(df).collect()}
    assert got == {1: ("b", 0.7, ["c", "d"]), 2: ("unknown", 0.0, []), 3: ("unknown", 0.0, [])}


def test_parse_api_time(table):
    load = datetime(2024, 2, 1)
    cases = [("2022-01-01T12:00:00Z", datetime(2022, 1, 1, 12)), (None, load), ("2022-01-01 12:00:00", load),
             ("2022-13-01T12:00:00Z", load), ("soon", load)]
    df = table("s STRING", [(s,) for s, _ in cases])
    got = df.select(L.parse_api_time(F.col("s"), F.lit(load))).collect()
    assert [r[0] for r in got] == [want for _, want in cases]


def test_sentiment_document_round_trip(table):
    df = table("s STRING, m MAP<STRING,DOUBLE>", [("positive", {"compound": 0.5, "pos": 0.25})])
    stored = df.select(L.encode_sentiment(F.col("s"), F.col("m")).alias("d"))
    assert isinstance(stored.select(F.get_json_object("d", "$.scores")).first()[0], str)
    sentiment, scores = L.decode_sentiment(F.col("d"))
    assert tuple(stored.select(sentiment, scores).first()) == ("positive", {"compound": 0.5, "pos": 0.25})


def test_keyword_weight_is_bounded(table):
    df = table("n BIGINT", [(1,), (4,), (1000,)])
    assert [r[0] for r in df.select(L.keyword_weight(F.col("n"))).collect()] == [1.0, 2.0, 4.0]


def test_display_percent(table):
    df = table("x DOUBLE", [(0.5,), (0.501,), (None,)])
    assert [tuple(r) for r in df.select(*L.display_percent(F.col("x"))).collect()] == [("50.0%", False), ("50.1%", True), (None, None)]


SCORED = "comment_id STRING, text STRING, classification STRING, spam_score DOUBLE, p DOUBLE, compound DOUBLE, " \
         "toxicity ARRAY<STRUCT<label STRING, score DOUBLE>>"


def test_analyze_queue_and_errors(table):
    long_text = "a quite ordinary text of some length"
    df = table(SCORED, [
        ("new", long_text, None, None, 0.1, 0.5, [("toxic", 0.9)]),
        ("half", long_text, "safe:neutral", None, 0.1, 0.5, [("toxic", 0.1)]),
        ("done", long_text, "safe:neutral", 0.1, 0.1, 0.5, [("toxic", 0.1)]),
        ("broken", None, None, None, 0.1, 0.5, [("toxic", 0.9)]),
    ])
    results = analyze.analyze_queue(df)
    assert rows(results, "comment_id", "classification", "toxicity_score", "is_error") == [
        ("broken", None, None, True), ("half", "safe:positive", 0.1, False), ("new", "toxic:positive", 0.9, False)]
    assert tuple(analyze.outcome_counts(results).first()) == (2, 1)
    updated = analyze.write_back(df, results)
    assert rows(updated, "comment_id", "classification", "spam_score") == [
        ("broken", None, None), ("done", "safe:neutral", 0.1), ("half", "safe:positive", 0.1), ("new", "toxic:positive", 0.1)]
