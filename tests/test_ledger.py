"""Reply ledger and dead letters: what is called again after a failure, and what leaves the queue."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from threadwise.operators import ledger
from threadwise.plans.analyze import analyze_queue
from threadwise.session import scratch_dir


def local(folder):
    path = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def counting(log, fails=lambda text: False):
    """A reply maker that notes every call in a folder; a text may fail its call."""
    def make():
        def one(text):
            open(f"{log}/{text}-{os.urandom(6).hex()}", "w").close()
            if fails(text):
                raise ValueError("busy")
            return f"re: {text}"
        return lambda texts: texts.map(one)
    return make


def calls(log):
    return Counter(name.rsplit("-", 1)[0] for name in os.listdir(log))


@pytest.fixture
def places(spark):
    return scratch_dir(spark, "ledger"), local(scratch_dir(spark, "calls"))


def prompts_of(table, texts):
    return table("id BIGINT, prompt STRING", list(enumerate(texts)))


def test_equal_prompts_and_later_runs_call_once(table, places):
    folder, log = places
    df = prompts_of(table, ["a", "b", "a", None, "c"])
    want = [(0, "re: a", None), (1, "re: b", None), (2, "re: a", None), (3, None, "no prompt"), (4, "re: c", None)]
    for _ in range(2):
        assert rows(ledger.call_recorded(df, counting(log), folder), "id", "reply", "error") == want
    more = ledger.call_recorded(prompts_of(table, ["c", "d"]), counting(log), folder)
    assert rows(more, "id", "reply") == [(0, "re: c"), (1, "re: d")]
    assert calls(log) == {"a": 1, "b": 1, "c": 1, "d": 1}


def test_a_task_that_is_tried_again_calls_only_for_what_is_missing(spark, table, places):
    folder, log = places
    df = prompts_of(table, [f"p{i}" for i in range(12)])

    # The job dies in the middle of its task, after some replies are there.
    make = counting(log)

    def dying():
        reply, done = make(), []

        def one(texts):
            if len(done) == 5:
                os._exit(3)  # the worker is gone, not only the call
            done.append(texts)
            return reply(texts)
        return one

    with pytest.raises(Exception):
        ledger.call_recorded(df, dying, folder, tasks=1).collect()
    assert sum(calls(log).values()) == 5
    got = ledger.call_recorded(df, counting(log), folder, tasks=3)
    assert rows(got, "id", "reply") == [(i, f"re: p{i}") for i in range(12)]
    assert set(calls(log).values()) == {1} and len(calls(log)) == 12


def test_failed_calls_leave_nothing_and_are_tried_by_the_next_run(table, places):
    folder, log = places
    df = prompts_of(table, ["a", "b"])
    first = ledger.call_recorded(df, counting(log, fails=lambda t: t == "b"), folder)
    assert rows(first, "reply", "error") == [(None, "ValueError: busy"), ("re: a", None)]
    assert rows(ledger.call_recorded(df, counting(log), folder), "reply", "error") == [("re: a", None), ("re: b", None)]


def test_no_prompts(table, places):
    folder, log = places
    assert ledger.call_recorded(prompts_of(table, []), counting(log), folder).count() == 0 and not calls(log)


SCORED = ("comment_id STRING, text STRING, classification STRING, spam_score DOUBLE, p DOUBLE, "
          "toxicity ARRAY<STRUCT<label: STRING, score: DOUBLE>>, compound DOUBLE")


def test_rows_leave_the_queue_after_so_many_runs(spark, table):
    text, path = "a comment with enough words to be judged by the model", scratch_dir(spark, "failures")
    comments = table(SCORED, [("good", text, None, None, 0.2, [("toxic", 0.1)], 0.5), ("bad", text, None, None, None, None, None),
                              ("later", text, None, None, None, None, None)])
    for run in range(4):
        queue = ledger.still_waiting(comments, ledger.failures(spark, path), "comment_id", attempts=2)
        if run == 1:
            queue = queue.filter("comment_id <> 'later'")
        results = analyze_queue(queue)
        for _ in range(2):  # a run that is repeated counts once
            ledger.record_failures(results.filter("is_error").withColumn("error", F.lit(f"run {run}")), path,
                                   "comment_id", "error", run)
        left = [r[0] for r in rows(queue, "comment_id")]
        assert left == [["bad", "good", "later"], ["bad", "good"], ["good", "later"], ["good"]][run]
    dead = ledger.dead_letters(ledger.failures(spark, path), attempts=2)
    assert rows(dead) == [("bad", 2, "run 1"), ("later", 2, "run 2")]
