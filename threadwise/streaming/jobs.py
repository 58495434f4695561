"""The batch operators on streams. Every job runs until its input is used up and writes files.

Event time columns must be TIMESTAMP, not TIMESTAMP_NTZ, for watermarks; `event_time` casts them.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from threadwise import constants as C
from threadwise.operators.feedback import label_lookup, labels_from, request_outcomes, updates_from
from threadwise.operators.filters import unanalyzed
from threadwise.operators.joins import null_safe_join
from threadwise.operators.merge import first_per_key
from threadwise.plans.analyze import STORED, analyze
from threadwise.session import make_folder, settings
from threadwise.streaming.counters import STATE_STORE, retrain_decisions

DAY_LATE, SHORT_LATE = "1 day", "10 minutes"
LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of the parquet files of a folder or of a glob of files and folders."""
    return spark.readStream.schema(schema).parquet(path)


def event_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_to_files(stream: DataFrame, folder: str) -> str:
    """Append a stream to parquet files; returns their folder."""
    out = f"{folder}/out"
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", out).option("checkpointLocation", f"{folder}/checkpoint").start()
    )
    return _finish(query, out)


def run_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, str], None], mode: str = "append") -> str:
    """Hand each micro-batch to `write(batch, path)`, one path per batch: a repeated batch overwrites itself."""
    out = f"{folder}/out"

    def handle(batch: DataFrame, number: int) -> None:
        write(batch, f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(handle).start()
    )
    return _finish(query, out)


def _finish(query: StreamingQuery, out: str) -> str:
    query.awaitTermination()
    return out


#: Folders of the id ledger: a micro-batch reads those that its ids fall in.
LEDGER_BUCKETS = 64


def known_ids(spark: SparkSession, ledger: str, buckets: list[int], before: int) -> DataFrame:
    """(bucket, comment_id) of the ids that the batches before stored, out of the folders of some buckets only."""
    schema = "comment_id STRING, bucket INT, batch BIGINT"
    rows = spark.read.schema(schema).option("basePath", ledger).parquet(ledger)
    return rows.filter(F.col("bucket").isin(buckets) & (F.col("batch") < before)).select("bucket", "comment_id")


def ingest(comments: DataFrame, folder: str, buckets: int = LEDGER_BUCKETS) -> str:
    """Store the first row of each comment id, whatever its time; returns the folder of the stored rows.

    Each micro-batch appends the ids that no earlier batch has stored: a late file of an old video is kept, and so is a
    single row without an id. The stored ids lie in a ledger of their own, one folder per hash bucket, so a batch reads no
    stored comment and only the ledger folders that its ids fall in. A repeated batch looks at the batches before it only
    and overwrites itself. The rows fetched and inserted are counted while they are written (see `ingested_counts`).
    """
    spark = comments.sparkSession
    ledger, counts = make_folder(spark, f"{folder}/ledger"), f"{folder}/counts"
    bucket = F.pmod(F.xxhash64("comment_id"), F.lit(buckets)).cast("int")
    order = [F.col("timestamp")]

    def write(batch: DataFrame, path: str) -> None:
        session, number = batch.sparkSession, int(path.rsplit("/batch=", 1)[1])
        fetched, inserted = Observation("fetched"), Observation("inserted")
        rows = batch.withColumn("bucket", bucket).observe(fetched, F.count(F.lit(1)).alias("n")).persist()
        try:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
            known = known_ids(session, ledger, touched, number)
            absent = null_safe_join(rows, known, ["bucket", "comment_id"], "left_anti")
            new = first_per_key(absent, "comment_id", order).observe(inserted, F.count(F.lit(1)).alias("n"))
            new.select(*batch.columns).write.mode("overwrite").parquet(path)
            stored = session.read.schema(batch.schema).parquet(path).select("comment_id")
            stored.withColumns({"bucket": bucket, "batch": F.lit(number).cast("long")}).repartition("bucket").write.option(
                "partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "batch").parquet(ledger)
            row = [(fetched.get["n"], inserted.get["n"], fetched.get["n"] - inserted.get["n"])]
            session.createDataFrame(row, INGEST_COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        finally:
            rows.unpersist()

    return run_batches(comments, folder, write)


INGEST_COUNTS = "fetched BIGINT, inserted BIGINT, duplicates BIGINT"


def ingested_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, fetched, inserted, duplicates) of each micro-batch of an ingest."""
    return spark.read.schema(f"{INGEST_COUNTS}, batch BIGINT").parquet(f"{folder}/counts")


def daily_trends(comments: DataFrame, late: str = DAY_LATE) -> DataFrame:
    """Comments and spam per closed day."""
    days = event_time(comments).withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day"))
    counted = days.agg(F.count("*").alias("total"), F.count_if("is_spam").alias("spam"))
    return counted.select(F.to_date("window.start").alias("day"), "total", "spam",
                          F.try_divide("spam", "total").alias("ratio"))


def sessions(comments: DataFrame, gap: str = "30 minutes", late: str = SHORT_LATE) -> DataFrame:
    """Closed bursts of comments per video: no gap inside a burst reaches `gap`.

    Comments are merged to partial sessions before the shuffle, for videos with very many comments.
    """
    comments.sparkSession.conf.set(LOCAL_SESSIONS, "true")
    bursts = event_time(comments).withWatermark("timestamp", late).groupBy("video_id", F.session_window("timestamp", gap))
    return bursts.agg(F.count("*").alias("n")).select(
        "video_id", F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"), "n",
    )


def sliding_counts(comments: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = SHORT_LATE) -> DataFrame:
    """Comments per video in closed overlapping windows."""
    windows = F.window("timestamp", size, step)
    counted = event_time(comments).withWatermark("timestamp", late).groupBy("video_id", windows)
    return counted.agg(F.count("*").alias("n")).select(
        "video_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n"
    )


def analysis(comments: DataFrame, scores: DataFrame, folder: str, late: str = "1 hour") -> tuple[str, str]:
    """Analyse comments as their model scores arrive: a left outer join of two streams.

    scores has comment_id, scored_at and the model columns p, toxicity and compound. A comment waits for scores made up to
    `late` after its time. Results go to one folder, the comments whose time is up without scores to another, the queue:
    both folders are returned. The queue has the comments' own columns, so a later run takes it as its comments, beside
    the scores that have come since, and nothing is lost. Comments that are analysed already are left out at once and never
    held. Each micro-batch overwrites itself when repeated.
    """
    results, queue = f"{folder}/results", f"{folder}/queue"
    left = unanalyzed(event_time(comments)).withWatermark("timestamp", late)
    right = event_time(scores, "scored_at").withColumnRenamed("comment_id", "__scored").withWatermark("scored_at", late)
    same = (F.col("comment_id") == F.col("__scored")) & (F.col("scored_at") >= F.col("timestamp")) & (
        F.col("scored_at") <= F.col("timestamp") + F.expr(f"interval {late}"))
    joined = left.join(right, same, "left_outer")

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            waited = rows.filter(F.col("__scored").isNull()).select(*comments.columns)
            waited.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).write.mode("overwrite").parquet(
                f"{queue}/batch={number}")
            done = analyze(rows.filter(F.col("__scored").isNotNull()))
            done.select("comment_id", *STORED, "is_error").write.mode("overwrite").parquet(f"{results}/batch={number}")
        finally:
            rows.unpersist()

    query = (
        joined.writeStream.outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(handle).start()
    )
    query.awaitTermination()
    return results, queue


@dataclass(frozen=True)
class FeedbackFolders:
    """Where a feedback job writes, a folder per micro-batch: label log rows, comment updates, requests that were turned
    down with the reason, and the retrain decisions."""

    labels: str
    updates: str
    rejects: str
    decisions: str


LABEL_LOG = ("comment_id STRING, text STRING, is_spam BOOLEAN, confidence DOUBLE, labeled_at TIMESTAMP_NTZ, "
             "trained_at TIMESTAMP_NTZ, model_type STRING, batch INT")


def feedback(requests: DataFrame, comments: DataFrame, folder: str, model_type: str = "spam",
             after: int = C.RETRAIN_AFTER) -> FeedbackFolders:
    """Label requests to label log rows, comment updates, rejects and retrain decisions.

    Every request leaves a row: a label, or a reject with its reason (no label, or an unknown comment). The label log is
    then read as a stream of its own, each label once, by counters that keep what no training has seen in keyed state;
    a decision that calls for training starts the count anew, and `counters.stamped` gives its time to the labels that
    the training saw. A restart goes on where the checkpoints stand.
    """
    spark = requests.sparkSession
    found = FeedbackFolders(*(f"{folder}/{name}" for name in ("labels", "updates", "rejects", "decisions")))

    def handle(batch: DataFrame, number: int) -> None:
        outcomes = request_outcomes(batch, comments).persist()
        try:
            accepted = label_lookup(outcomes.filter("error is null"), comments, ["text"])
            at = f"batch={number}"
            labels_from(accepted).withColumn("model_type", F.lit(model_type)).write.mode("overwrite").parquet(
                f"{found.labels}/{at}")
            updates_from(accepted).write.mode("overwrite").parquet(f"{found.updates}/{at}")
            outcomes.filter("error is not null").select(*batch.columns, "error").write.mode("overwrite").parquet(
                f"{found.rejects}/{at}")
        finally:
            outcomes.unpersist()

    query = (
        requests.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(handle).start()
    )
    query.awaitTermination()
    log = spark.readStream.schema(LABEL_LOG).parquet(make_folder(spark, found.labels))
    with settings(spark, STATE_STORE):
        query = (
            retrain_decisions(log, after).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("path", found.decisions).option("checkpointLocation", f"{folder}/decisions-checkpoint").start()
        )
    query.awaitTermination()
    return found
