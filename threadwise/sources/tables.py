"""Stored tables: declared-schema scans, appends and partition replacement."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadwise import constants as C
from threadwise.operators.joins import null_safe_join
from threadwise.operators.merge import apply_updates
from threadwise.operators.ordering import top_per_group
from threadwise.session import scratch_dir


def scan_table(spark: SparkSession, path: str, schema: str, spread: int | None = None) -> DataFrame:
    """Read a stored table with its declared schema (no inference, columns absent on disk read as NULL).

    `spread` deals the rows out over so many tasks: for a table whose files have fewer row groups than there are cores,
    where work on the rows costs more than moving them. A table of many row groups is read in parallel without it.
    """
    rows = spark.read.schema(schema).parquet(path)
    return rows.repartition(spread) if spread else rows


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions present in df. df must not be a plan that reads the same path."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def update_stored(spark: SparkSession, path: str, schema: str, updates: DataFrame, key: str, by: str) -> None:
    """Apply updates to a table stored in partitions, rewriting only the partitions that hold an updated row.

    The new rows are first written to the scratch folder: the table is never replaced by a plan that reads it.
    """
    stored = scan_table(spark, path, schema)
    touched = stored.join(updates.select(key), key, "left_semi").select(by).distinct()
    changed = apply_updates(null_safe_join(stored, touched, [by], "left_semi"), updates, key)
    staged = scratch_dir(spark, "update")
    changed.write.mode("overwrite").parquet(staged)
    replace_partitions(scan_table(spark, staged, schema), path, by)


def store_by_day(comments: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append comments under one folder per day, so that a filter on `day` skips whole folders.

    Each task writes the days it holds; a day is not gathered in one task, as one day may hold most rows.
    """
    comments.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def scan_since(spark: SparkSession, path: str, schema: str, start: Column, time: str = "timestamp") -> DataFrame:
    """Comments stored by day from a point in time on; earlier days are not read."""
    stored = scan_table(spark, path, f"{schema}, day DATE")
    return stored.filter((F.col("day") >= F.to_date(start)) & (F.col(time) >= start)).drop("day")


def table_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types of a table."""
    return [(field.name, field.dataType.simpleString()) for field in df.schema.fields]


def table_profile(comments: DataFrame, rows: int = C.SAMPLE_ROWS) -> DataFrame:
    """Total row count beside the first rows of every video, texts cut for display."""
    total = comments.agg(F.count("*")).scalar()
    head = top_per_group(
        comments.select("video_id", "comment_id", "author", "classification", "mod_action",
                        F.substring("text", 1, C.TEXT_HEAD).alias("text_head"), "timestamp"),
        ["video_id"], [F.col("timestamp"), F.col("comment_id")], rows,
    )
    return head.withColumn("table_rows", total).drop("timestamp")
