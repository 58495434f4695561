"""Replies beside their parent comments."""

from pyspark.sql import DataFrame, functions as F


def thread_join(comments: DataFrame) -> DataFrame:
    """Each reply with its parent's author and text, the replies found and the number the parent declares.

    Replies are counted per thread before the join.
    """
    replies = comments.filter("parent_id is not null")
    found = replies.groupBy("parent_id").agg(F.count("*").alias("replies_found"))
    parents = comments.select(
        F.col("comment_id").alias("parent_id"), F.col("author").alias("parent_author"),
        F.col("text").alias("parent_text"), F.col("reply_count").alias("replies_declared"),
    ).join(found, "parent_id")
    return replies.select("comment_id", "video_id", "parent_id", "author", "text").join(
        parents, "parent_id", "left"
    ).withColumn("complete", F.col("replies_found") == F.col("replies_declared"))
