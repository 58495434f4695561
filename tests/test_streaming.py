import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from threadwise.operators import merge
from threadwise.session import scratch_dir
from threadwise.streaming import counters, jobs

COMMENTS = "comment_id STRING, video_id STRING, timestamp TIMESTAMP_NTZ, is_spam BOOLEAN"


@pytest.fixture
def landed(spark, table):
    """Streams over landed files; each file arrives in its own micro-batch."""
    def land(schema, *files):
        folder = scratch_dir(spark, "landed")
        for rows_ in files:
            table(schema, rows_).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return land


def read(spark, stream):
    return spark.read.parquet(jobs.run_to_files(stream, scratch_dir(spark, "out")))


def test_ingest_drops_copies_across_batches(spark, landed):
    stream = landed(COMMENTS, [("a", "v", at(1), None), ("a", "v", at(1), None)], [("a", "v", at(1), None), ("b", "v", at(1, 5), None)])
    stored = jobs.ingest(stream, scratch_dir(spark, "ingest"))
    assert rows(spark.read.parquet(stored), "comment_id") == [("a",), ("b",)]


def test_ingest_keeps_ids_that_arrive_late(spark, landed):
    files = [[(f"{day}-{i % 10}", "v", at(day, i), None) for i in range(20)] for day in (20, 21, 5)]
    stored = jobs.ingest(landed(COMMENTS, *files), scratch_dir(spark, "ingest"))
    assert rows(spark.read.parquet(stored), "comment_id") == sorted((f"{d}-{i}",) for d in (20, 21, 5) for i in range(10))


def test_trends_emit_closed_days_only(spark, landed):
    stream = landed(COMMENTS, [("a", "v", at(1, 5), True), ("b", "v", at(1, 7), False), ("c", "v", at(2, 5), True)], [("d", "v", at(3, 6), True)])
    got = rows(read(spark, jobs.daily_trends(stream)), "day", "total", "spam", "ratio")
    assert [(d.day, *rest) for d, *rest in got] == [(1, 2, 1, 0.5)]


def test_sessions_and_sliding_windows(spark, landed):
    files = [("a", "v", at(1, 0), None), ("b", "v", at(1, 0, 20), None), ("c", "v", at(1, 2), None), ("z", "w", at(1, 12), None)]
    bursts = read(spark, jobs.sessions(landed(COMMENTS, files)))
    assert rows(bursts, "video_id", F.col("session_start").cast("timestamp_ntz"), "n") == [("v", at(1, 0), 2), ("v", at(1, 2), 1)]
    sliding = read(spark, jobs.sliding_counts(landed(COMMENTS, files)))
    counts = {(r["video_id"], r["s"]): r["n"] for r in sliding.select("*", F.col("window_start").cast("timestamp_ntz").alias("s")).collect()}
    assert counts[("v", at(1, 0))] == 2 and counts[("v", at(1, 0, 15))] == 1 and counts[("v", at(1, 1, 45))] == 1
    assert sum(counts.values()) == 3 * 4


REQUESTS = "request_id STRING, comment_id STRING, is_spam BOOLEAN, requested_at TIMESTAMP_NTZ"


def decided(spark, folders):
    return rows(spark.read.parquet(folders.decisions), "batch", "labels", "untrained_labels", "due")


def test_training_is_due_at_ten_labels_and_again_at_twenty(spark, table, landed):
    comments = table("comment_id STRING, text STRING", [(str(i), "t") for i in range(60)])
    files = [[("r", str(i), True, at(1 + n, i % 20)) for i in span] for n, span in enumerate(
        [range(6), range(6, 10), range(10, 19), range(19, 20), range(20, 23)])]
    files[0] += [("n", "0", None, at(1)), ("z", "zz", True, at(1)), ("z", None, None, at(1))]
    folders = jobs.feedback(landed(REQUESTS, *files), comments, scratch_dir(spark, "feedback"))
    assert decided(spark, folders) == [
        (0, 6, 6, False), (1, 4, 10, True), (2, 9, 9, False), (3, 1, 10, True), (4, 3, 3, False)]
    labels, decisions = spark.read.parquet(folders.labels), spark.read.parquet(folders.decisions)
    stamps = counters.stamped(labels, decisions).groupBy("batch", "trained_at").count()
    assert rows(stamps, "batch", "trained_at", "count") == [
        (0, at(2, 9), 6), (1, at(2, 9), 4), (2, at(4, 19), 9), (3, at(4, 19), 1), (4, None, 3)]
    rejects = spark.read.parquet(folders.rejects)
    assert rows(rejects, "request_id", "error") == [
        ("n", "label is not boolean"), ("z", "comment not found"), ("z", "label is not boolean")]
    assert rows(labels.filter("comment_id = '0'"), "is_spam", "model_type") == [(True, "spam")]


def test_feedback_goes_on_after_a_restart_and_holds_hot_batches(spark, table, landed):
    comments = table("comment_id STRING, text STRING", [(str(i), "t") for i in range(100)])
    files = [[("r", str(i), i % 2 == 0, at(1 + n, 1)) for i in span] for n, span in enumerate(
        [range(7), range(7, 9), range(9, 99), range(99, 100)])]
    folder, arriving = scratch_dir(spark, "feedback"), scratch_dir(spark, "landed")
    for file in files:
        table(REQUESTS, file).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(arriving)
        folders = jobs.feedback(stream, comments, folder)
    want = [(0, 7, 7, False), (1, 2, 9, False), (2, 90, 99, True), (3, 1, 1, False)]
    assert decided(spark, folders) == want
    # Once more without new requests, and all files in one run.
    assert decided(spark, jobs.feedback(stream, comments, folder)) == want
    whole = jobs.feedback(landed(REQUESTS, *files), comments, scratch_dir(spark, "whole"))
    assert decided(spark, whole) == want


def test_state_store_setting_is_left_as_it_was(spark, table, landed):
    key = next(iter(counters.STATE_STORE))
    before = spark.conf.get(key)
    jobs.feedback(landed(REQUESTS, []), table("comment_id STRING, text STRING", []), scratch_dir(spark, "feedback"))
    assert spark.conf.get(key) == before


def files_read(df):
    """Rows of a table, and how many files its scan read."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return found, sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_ingest_reads_only_the_ledger_folders_of_its_ids(spark, table, landed):
    files = [[(f"{n}-{i}", "v", at(1 + n, i % 20), None) for i in range(200)] for n in range(2)]
    folder = scratch_dir(spark, "ingest")
    jobs.ingest(landed(COMMENTS, *files, [("0-7", "v", at(9), None), (None, "v", at(9), None)]), folder, buckets=16)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("0-7")), F.lit(16)).cast("int")).first()[0]
    known = jobs.known_ids(spark, f"{folder}/ledger", [bucket], 2)
    found, read_files = files_read(known)
    assert {r["bucket"] for r in found} == {bucket} and "0-7" in {r["comment_id"] for r in found}
    assert read_files == 2  # one of each earlier batch, out of two times sixteen
    scan = known._jdf.queryExecution().toString()
    filters = scan.rsplit("PartitionFilters: [", 1)[1].split("], PushedFilters")[0]
    assert "bucket#" in filters and "batch#" in filters
    assert rows(jobs.ingested_counts(spark, folder), "batch", "fetched", "inserted", "duplicates") == [
        (0, 200, 200, 0), (1, 200, 200, 0), (2, 2, 1, 1)]


def test_ingest_counts_are_those_of_the_batch_operator(spark, table, landed):
    stored = [(str(i), "v", at(1, i), None) for i in range(10)]
    batch = [(str(i % 14), "v", at(2, i % 20), None) for i in range(30)]
    folder = scratch_dir(spark, "ingest")
    jobs.ingest(landed(COMMENTS, stored, batch), folder)
    want = merge.ingest_counts(table(COMMENTS, stored), table(COMMENTS, batch), "comment_id", "video_id")
    got = jobs.ingested_counts(spark, folder).filter("batch = 1")
    columns = ["fetched", "inserted", "duplicates"]
    assert rows(got, *columns) == rows(want, *columns) == [(30, 4, 26)]


def test_a_repeated_ingest_batch_stores_its_rows_again(spark, table, landed, monkeypatch):
    """The second batch fails after its rows and ledger are written; the restart writes the same rows once."""
    files = [[("a", "v", at(1), None)], [("a", "v", at(1), None), ("b", "v", at(2), None)]]
    stream, folder = landed(COMMENTS, *files), scratch_dir(spark, "ingest")
    schema = jobs.INGEST_COUNTS
    monkeypatch.setattr(jobs, "INGEST_COUNTS", "nothing")
    with pytest.raises(Exception):
        jobs.ingest(stream, folder)
    monkeypatch.setattr(jobs, "INGEST_COUNTS", schema)
    out = jobs.ingest(stream, folder)
    assert rows(spark.read.parquet(out), "comment_id", "batch") == [("a", 0), ("b", 1)]
    assert rows(jobs.ingested_counts(spark, folder), "batch", "fetched", "inserted") == [(0, 1, 1), (1, 2, 1)]


ARRIVING = "comment_id STRING, text STRING, timestamp TIMESTAMP_NTZ, classification STRING, spam_score DOUBLE"
SCORES = ("comment_id STRING, scored_at TIMESTAMP_NTZ, p DOUBLE, toxicity ARRAY<STRUCT<label: STRING, score: DOUBLE>>, "
          "compound DOUBLE")


def test_comments_wait_for_scores_and_stay_in_the_queue_without(spark, landed):
    plain = "a comment with enough words to be judged by the model at last"
    comments = [[("a", plain, at(1), None, None), ("b", plain, at(1), None, None), ("old", plain, at(1), "safe:neutral", 0.1)],
                [("c", plain, at(2), None, None)], [("d", plain, at(3), None, None)]]
    score = lambda i, day, hour, minute, p: (i, at(day, hour, minute), p, [("toxic", 0.1)], 0.5)
    scores = [[score("a", 1, 0, 30, 0.9), score("old", 1, 0, 30, 0.9)], [score("c", 2, 0, 10, 0.2), score("b", 2, 5, 0, 0.9)],
              [score("d", 3, 0, 5, 0.2)]]
    folder = scratch_dir(spark, "analysis")
    results, queue = jobs.analysis(landed(ARRIVING, *comments), landed(SCORES, *scores), folder)
    assert rows(spark.read.parquet(results), "comment_id", "classification") == [
        ("a", "spam:positive"), ("c", "safe:positive"), ("d", "safe:positive")]
    waiting = spark.read.parquet(queue)
    assert rows(waiting, "comment_id", "timestamp", "classification") == [("b", at(1), None)]
    # The queue goes into the next run, where the scores have come.
    again = spark.readStream.schema(ARRIVING).parquet(f"{queue}/batch=*")
    late, rest = jobs.analysis(again, landed(SCORES, *scores), scratch_dir(spark, "again"), late="8 hours")
    assert rows(spark.read.parquet(late), "comment_id") == []
    late, rest = jobs.analysis(again, landed(SCORES, *scores), scratch_dir(spark, "again"), late="48 hours")
    assert rows(spark.read.parquet(late), "comment_id", "classification") == [("b", "spam:positive")]


def test_repeated_batch_overwrites_itself(spark, landed):
    folder = scratch_dir(spark, "batches")
    stream = landed(COMMENTS, [("a", "v", at(1), None)])
    out = jobs.run_batches(stream, folder, lambda batch, path: [batch.write.mode("overwrite").parquet(path) for _ in range(2)] and None)
    assert spark.read.parquet(out).count() == 1
