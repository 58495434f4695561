"""Statistics kept up to date by days: partial states on disk that merge into the statistics of any span of days."""

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Bits of the author sketches' length: the estimate's standard error is about 1.04 / sqrt(2^12), 1.6 per cent.
SKETCH_BITS = 12
CLASSES = ["spam", "toxic", "questionable", "safe"]
COUNTS = ["total", "judged", "spam_flagged", *[f"class_{c}" for c in CLASSES], "scored", "responded", "likes"]
STATE = "video_id STRING, " + ", ".join(f"{c} BIGINT" for c in COUNTS) + (
    ", emotion_sum DECIMAL(38,9), first_at TIMESTAMP_NTZ, last_at TIMESTAMP_NTZ, authors BINARY, day DATE")
AUTHORS = "video_id STRING, author STRING, n BIGINT, day DATE"


def day_states(comments: DataFrame) -> DataFrame:
    """One row per (video, day): exact counts and sums, the span of times, and a sketch of the authors."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return comments.groupBy("video_id", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("total"), F.count("classification").alias("judged"), flag(F.col("is_spam")).alias("spam_flagged"),
        *[flag(F.col("content_class") == c).alias(f"class_{c}") for c in CLASSES],
        F.count("emotional_score").alias("scored"), flag(F.col("responded")).alias("responded"),
        F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"),
        # As decimals, a sum does not depend on its order, so merged states equal a full run.
        F.coalesce(F.sum(F.col("emotional_score").cast("decimal(18,9)")), F.lit(0)).cast("decimal(38,9)").alias("emotion_sum"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
        F.hll_sketch_agg(F.coalesce("author", F.lit("")), SKETCH_BITS).alias("authors"))


def store_states(comments: DataFrame, path: str) -> None:
    """Write the states of the days in a table of comments, in place of those that are stored for these days.

    `comments` holds whole days. The comments per author are stored beside the sketches, for exact numbers of authors.
    """
    per_author = comments.groupBy("video_id", "author", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    for rows, name in ((day_states(comments), "states"), (per_author, "authors")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")


def merged(spark: SparkSession, path: str, exact: bool = False, since: str | None = None) -> DataFrame:
    """Statistics per video out of the states alone, of all days or those from `since` on.

    distinct_authors is the merged sketches' estimate, or with `exact` counted from the stored authors.
    """
    days = F.lit(True) if since is None else F.col("day") >= F.lit(since).cast("date")
    states = spark.read.schema(STATE).parquet(f"{path}/states").filter(days)
    sums = states.groupBy("video_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.sum("emotion_sum").alias("emotion_sum"), F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"), F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("distinct_authors"))
    found = sums.withColumn("avg_emotion", F.try_divide(F.col("emotion_sum").cast("double"), "scored")).drop("emotion_sum")
    if not exact:
        return found
    authors = spark.read.schema(AUTHORS).parquet(f"{path}/authors").filter(days)
    counted = authors.select("video_id", "author").distinct().groupBy("video_id").agg(F.count("*").alias("distinct_authors"))
    same = found["video_id"].eqNullSafe(counted["video_id"])
    return found.drop("distinct_authors").join(counted, same).drop(counted["video_id"])
