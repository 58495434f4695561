from pyspark.sql import functions as F

from conftest import at, rows
from threadwise.operators import feedback, threads

REQUESTS = "request_id STRING, comment_id STRING, is_spam BOOLEAN, requested_at TIMESTAMP_NTZ"
COMMENTS = "comment_id STRING, text STRING, is_spam BOOLEAN, spam_score DOUBLE, updated_at TIMESTAMP_NTZ"
LABELS = "comment_id STRING, is_spam BOOLEAN, labeled_at TIMESTAMP_NTZ, trained_at TIMESTAMP_NTZ"
VERSIONS = "model_type STRING, created_at TIMESTAMP_NTZ"


def stored(table):
    return table(COMMENTS, [(c, f"text {c}", None, 0.4, None) for c in "abc"])


def test_single_requests(table):
    requests = table(REQUESTS, [("1", "a", True, at(1)), ("1", "a", False, at(2)), ("2", "b", None, at(1)), ("3", "zz", True, at(1))])
    marked = feedback.mark_spam(requests, stored(table))
    assert rows(marked.outcomes, "request_id", "status", "error") == [
        ("1", "success", None), ("1", "success", None), ("2", "error", feedback.NOT_BOOLEAN), ("3", "error", feedback.NOT_FOUND)]
    assert rows(marked.labels, "comment_id", "text", "is_spam", "confidence", "trained_at") == [
        ("a", "text a", False, 1.0, None), ("a", "text a", True, 1.0, None)]
    assert rows(marked.comments) == [("a", "text a", False, 0.0, at(2)), ("b", "text b", None, 0.4, None), ("c", "text c", None, 0.4, None)]
    assert rows(feedback.missing_ids(requests, stored(table)), "comment_id") == [("zz",)]


def test_sets_are_all_or_nothing(table):
    requests = table(REQUESTS, [
        ("1", "a", True, at(1)), ("1", "a", True, at(1)), ("1", "b", True, at(1)),
        ("2", "c", True, at(1)), ("2", "zz", True, at(1)), ("3", "c", None, at(1)),
    ])
    marked = feedback.mark_spam_bulk(requests, stored(table))
    assert rows(marked.outcomes, "request_id", "status", "total", "missing", "processed") == [
        ("1", "success", 2, 0, 2), ("2", "error", 2, 1, 0), ("3", "error", 1, 0, 0)]
    assert rows(marked.labels, "comment_id") == [("a",), ("b",)]
    assert rows(marked.comments, "comment_id", "is_spam", "spam_score") == [("a", True, 1.0), ("b", True, 1.0), ("c", None, 0.4)]


def test_retrain_trigger(table):
    labels = table(LABELS, [(str(i), True, at(10, i), None if i < 9 else at(11)) for i in range(12)])
    none = table(VERSIONS, [])
    assert tuple(feedback.retrain_due(labels, none).first()) == (9, 12, False, True)
    newer = table(VERSIONS, [("spam", at(10, 5)), ("toxicity", at(20))])
    assert tuple(feedback.retrain_due(labels, newer).first()) == (9, 6, False, False)
    assert rows(feedback.newer_than_model(labels, newer), "comment_id") == [("10",), ("11",), ("6",), ("7",), ("8",), ("9",)]
    stamped = feedback.mark_trained(labels, F.lit(at(12)))
    assert stamped.filter(F.col("trained_at") == F.lit(at(12))).count() == 9
    assert tuple(feedback.retrain_due(stamped, newer).first()) == (0, 6, False, False)


def test_latest_label(table):
    labels = table(LABELS, [("a", True, at(1), None), ("a", False, at(2), None), ("b", True, at(1), None)])
    assert rows(feedback.latest_label(labels), "comment_id", "is_spam") == [("a", False), ("b", True)]


def test_latest_label_breaks_ties_alike_in_any_order(table):
    labels = [("a", True, at(1), None), ("a", False, at(1), None), ("b", True, at(2), None)]
    got = [rows(feedback.latest_label(table(LABELS, x)), "comment_id", "is_spam") for x in (labels, labels[::-1])]
    assert got[0] == got[1] and len(got[0]) == 2


def test_thread_join(table):
    comments = table("comment_id STRING, video_id STRING, parent_id STRING, author STRING, text STRING, reply_count BIGINT", [
        ("p", "v", None, "al", "top", 3), ("r1", "v", "p", "bo", "x", 0), ("r2", "v", "p", "cy", "y", 0), ("r3", "v", "gone", "cy", "z", 0)])
    got = rows(threads.thread_join(comments), "comment_id", "parent_author", "replies_found", "replies_declared", "complete")
    assert got == [("r1", "al", 2, 3, False), ("r2", "al", 2, 3, False), ("r3", None, None, None, None)]
