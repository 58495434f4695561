"""Calls that are paid for once: replies kept under their prompt's hash, and rows that failed too often set aside."""

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadwise.session import make_folder

#: Runs in which a row may fail before it leaves the queue.
ATTEMPTS = 3
FAILURES = "key STRING, error STRING, run BIGINT"


class Ledger:
    """Replies in a folder that all workers share, one small file per prompt: written when the reply is there, whatever
    becomes of the task. A file appears under its name only when it is whole."""

    def __init__(self, folder: str):
        uri = folder if "://" in folder or ":/" in folder else f"file://{folder}"
        self.files, self.root = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/")
                                                       and not uri.startswith("file://") else uri)

    def path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> str | None:
        path = self.path(key)
        if self.files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(path) as held:
            return json.loads(held.read())["reply"]

    def put(self, key: str, reply: str | None) -> None:
        path, own = self.path(key), f"{self.path(key)}.{uuid.uuid4().hex}"
        self.files.create_dir(f"{self.root}/{key[:2]}")
        with self.files.open_output_stream(own) as out:
            out.write(json.dumps({"reply": reply}).encode())
        self.files.move(own, path)


def call_recorded(prompts: DataFrame, maker: Callable, folder: str, prompt: str = "prompt",
                  tasks: int | None = None) -> DataFrame:
    """As `moderation.call_scorer`, with every reply kept in a ledger folder: the prompt column gives way to reply and error.

    Equal prompts are asked once. A task that is tried again, another run, and a later job find the replies that are
    there and call for the others only; a failed call leaves nothing and is tried again by the next run. The folder must be
    one that the workers share. A null prompt is not asked: its reply is null, its error says so.
    """
    spark = prompts.sparkSession
    make_folder(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, reply = Ledger(folder), None
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("asked").to_pylist()):
                found, error = ledger.get(key), None
                if found is None:
                    reply = reply or maker()
                    try:
                        found = reply(pd.Series([text])).iloc[0]
                        ledger.put(key, found)
                    except Exception as raised:  # whatever the user's model raises ends its own call only
                        found, error = None, f"{type(raised).__name__}: {raised}"
                yield pa.RecordBatch.from_pydict({
                    "key": [key], "reply": pa.array([found], pa.string()), "error": pa.array([error], pa.string())})

    name = "__key"
    keyed = prompts.withColumn(name, F.sha2(F.col(prompt).cast("binary"), 256))
    asked = keyed.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("key")).agg(F.first(prompt).alias("asked"))
    spread = asked.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    replies = spread.mapInArrow(run, "key string, reply string, error string")
    error = F.when(F.col(name).isNull(), F.lit("no prompt")).otherwise(F.col("error"))
    return keyed.join(replies, F.col(name) == F.col("key"), "left").withColumn("error", error).drop(name, "key", prompt)


def record_failures(failed: DataFrame, path: str, key: str, error: str, run: int) -> None:
    """Store the rows that failed in a run, in place of what the same run stored before."""
    rows = failed.select(F.col(key).cast("string").alias("key"), F.col(error).cast("string").alias("error"))
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURES).option("basePath", path).parquet(make_folder(spark, path))


def dead_letters(failed: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, attempts, last_error) of the rows that failed in that many runs or more; a row that fails twice in a run has
    failed in one."""
    per_run = failed.groupBy("key", "run").agg(F.max("error").alias("error"))
    counted = per_run.groupBy("key").agg(F.count("*").alias("attempts"), F.max_by("error", "run").alias("last_error"))
    return counted.filter(F.col("attempts") >= attempts)


def still_waiting(queue: DataFrame, failed: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """The rows of a queue that have not failed too often."""
    dead = dead_letters(failed, attempts).select(F.col("key").alias("__dead"))
    return queue.join(dead, F.col(key).cast("string") == F.col("__dead"), "left_anti")
