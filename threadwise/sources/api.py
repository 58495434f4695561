"""Landed API documents to table rows."""

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C
from threadwise.functions.labels import parse_api_time
from threadwise.schemas import THREADS_DOCUMENT, VIDEO_DOCUMENT


def _comment_columns(snippet: Column, load_time: Column) -> list[Column]:
    return [
        F.coalesce(snippet["authorDisplayName"], F.lit(C.UNKNOWN_AUTHOR)).alias("author"),
        F.coalesce(snippet["textDisplay"], F.lit("")).alias("text"),
        F.coalesce(snippet["likeCount"], F.lit(0)).cast("bigint").alias("likes"),
        parse_api_time(snippet["publishedAt"], load_time).alias("timestamp"),
    ]


def _thread_items(documents: DataFrame, json: str) -> DataFrame:
    parsed = documents.select(F.from_json(F.col(json), THREADS_DOCUMENT).alias("d"))
    return parsed.select(F.col("d.request.videoId").alias("video_id"), F.explode("d.items").alias("item"))


def ingest_threads(documents: DataFrame, load_time: Column, json: str = "json") -> DataFrame:
    """Top-level comments of thread documents, with defaults for absent fields."""
    items = _thread_items(documents, json).filter("item.snippet.topLevelComment is not null")
    snippet = F.col("item.snippet.topLevelComment.snippet")
    return items.select(
        F.col("item.id").alias("comment_id"), "video_id", F.lit(None).cast("string").alias("parent_id"),
        *_comment_columns(snippet, load_time),
        F.coalesce("item.snippet.totalReplyCount", F.lit(0)).cast("bigint").alias("reply_count"),
    )


def ingest_replies(documents: DataFrame, load_time: Column, json: str = "json") -> DataFrame:
    """Replies of the threads that declare any; a reply has no replies itself."""
    items = _thread_items(documents, json).filter(F.coalesce("item.snippet.totalReplyCount", F.lit(0)) > 0)
    replies = items.select("video_id", F.col("item.id").alias("parent_id"), F.explode("item.replies.comments").alias("r"))
    return replies.select(
        F.col("r.id").alias("comment_id"), "video_id", "parent_id",
        *_comment_columns(F.col("r.snippet"), load_time), F.lit(0).cast("bigint").alias("reply_count"),
    )


def ingest_comments(documents: DataFrame, load_time: Column, json: str = "json") -> DataFrame:
    """Top-level comments and replies in one table."""
    return ingest_threads(documents, load_time, json).unionByName(ingest_replies(documents, load_time, json))


def ingest_videos(documents: DataFrame, json: str = "json") -> DataFrame:
    """A row for each item of the video documents, under the item's id (the requested one where it has none); a
    document without items, or an item without snippet, gives no row."""
    parsed = documents.select(F.from_json(F.col(json), VIDEO_DOCUMENT).alias("d"))
    items = parsed.select(F.col("d.request.videoId").alias("asked"), F.explode("d.items").alias("i"))
    found = items.select(F.coalesce("i.id", "asked").alias("video_id"), F.col("i.snippet").alias("s"))
    return found.filter("s is not null").select(
        "video_id",
        F.coalesce("s.title", F.lit(C.UNKNOWN_TITLE)).alias("title"),
        F.coalesce("s.channelTitle", F.lit(C.UNKNOWN_CHANNEL)).alias("channel_title"),
        F.col("s.thumbnails.default.url").alias("thumbnail_url"),
    )
