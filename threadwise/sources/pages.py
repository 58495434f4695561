"""Comments stored by hour with a directory of row counts, so that a page at any depth reads its own hours only."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadwise import constants as C

DIRECTORY = "video_id STRING, day DATE, hour INT, n BIGINT"


def store_with_directory(comments: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append comments under a folder per day and hour, and the rows of each (video, hour) to the directory.

    A later load of an hour adds rows to both, so counts are summed up when they are read. Comments without a time have
    the hour -1 of no day.
    """
    placed = comments.withColumns({"day": F.to_date(time), "hour": F.coalesce(F.hour(time), F.lit(-1))})
    placed.write.mode("append").partitionBy("day", "hour").parquet(f"{path}/comments")
    placed.groupBy("video_id", "day", "hour").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{path}/directory")


def slices(spark: SparkSession, path: str, video_id: str) -> DataFrame:
    """(day, hour, n, before) of one video, newest hour first; before counts the rows of the hours before it in this order.

    The rows are the hours of one video, not its comments.
    """
    own = spark.read.schema(DIRECTORY).parquet(f"{path}/directory").filter(F.col("video_id") == video_id)
    hours = own.groupBy("day", "hour").agg(F.sum("n").alias("n"))
    newest = Window.orderBy(F.desc_nulls_last("day"), F.desc("hour"))
    before = F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, -1))
    return hours.withColumn("before", F.coalesce(before, F.lit(0)))


def stored_page(spark: SparkSession, path: str, schema: str, video_id: str, page: int = 1,
                per_page: int = C.PAGE_SIZE, time: str = "timestamp") -> DataFrame:
    """One page of a video, newest first, equal times by id, with the video's total and number of pages.

    The directory tells the hours that hold the page, at most as many as it has rows; only their folders are read. A
    page beyond the last is empty.
    """
    first = (page - 1) * per_page
    hours = slices(spark, path, video_id)
    total = hours.agg(F.sum("n")).scalar()
    held = hours.withColumn("total", total).filter(
        (F.col("before") < first + per_page) & (F.col("before") + F.col("n") > first)).orderBy("before").collect()
    rows = spark.read.schema(f"{schema}, day DATE, hour INT").parquet(f"{path}/comments")
    where = F.lit(False)
    for h in held:  # literals, so that the folders are chosen when the plan is made
        where = where | (F.col("day").eqNullSafe(F.lit(h["day"])) & (F.col("hour") == h["hour"]))
    skip, total = (first - held[0]["before"], held[0]["total"]) if held else (0, 0)
    ordered = rows.filter((F.col("video_id") == video_id) & where).orderBy(F.desc_nulls_last(time), "comment_id")
    return ordered.offset(skip).limit(per_page).drop("day", "hour").withColumns({
        "total": F.lit(total).cast("bigint"), "page": F.lit(page).cast("bigint"), "per_page": F.lit(per_page).cast("bigint"),
        "total_pages": F.ceil(F.lit(total) / per_page).cast("bigint")})
