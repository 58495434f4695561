"""Selections and listings."""

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C
from threadwise.functions.labels import display_percent, split_classification
from threadwise.functions.times import days_before
from threadwise.operators.ordering import top_per_group


def filter_video(df: DataFrame, video_id: str | None = None) -> DataFrame:
    """Rows of one video, or all rows."""
    return df if video_id is None else df.filter(F.col("video_id") == video_id)


def unanalyzed(df: DataFrame) -> DataFrame:
    return df.filter("classification is null or spam_score is null")


def unclassified(df: DataFrame, video_id: str | None = None) -> DataFrame:
    return filter_video(df.filter("classification is null"), video_id)


def judged_only(df: DataFrame, column: str = "is_spam") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def since_days(df: DataFrame, time: str = "timestamp", days: int = C.HISTORY_DAYS, as_of: Column | None = None) -> DataFrame:
    """Rows of the last days before `as_of`, by default the newest time of the table."""
    end = df.agg(F.max(time)).scalar() if as_of is None else as_of
    return df.filter(F.col(time) >= days_before(end, days))


def with_split_classification(df: DataFrame) -> DataFrame:
    content, sentiment = split_classification(F.col("classification"))
    return df.withColumns({"content_class": content, "sentiment": sentiment})


def faceted_search(df: DataFrame, content: str | None = None, sentiment: str | None = None,
                   query: str | None = None) -> DataFrame:
    """Rows that meet all given facets: class, sentiment, text fragment in any case.

    The facets are the stored columns, so that the scan can skip by them; a table without them has its combined
    class split.
    """
    stored = {"content_class", "sentiment"} <= set(df.columns)
    found = df if stored else with_split_classification(df)
    if content:
        found = found.filter(F.col("content_class") == content)
    if sentiment:
        found = found.filter(F.col("sentiment") == sentiment)
    if query:
        found = found.filter(F.lower("text").contains(query.lower()))
    return found


def video_comments(df: DataFrame, video_id: str | None = None) -> DataFrame:
    """Listing of the comments, newest first; a comment never judged shows as not spam."""
    listed = filter_video(df, video_id).select(
        "video_id", "comment_id", "text", "author", "timestamp", "classification", "toxicity_score",
        F.coalesce("is_spam", F.lit(False)).alias("is_spam"), "spam_score", "spam_features",
    )
    return listed.orderBy("video_id", F.desc("timestamp"), "comment_id")


def sample_comments(df: DataFrame, rows: int = C.SAMPLE_ROWS) -> DataFrame:
    """First comments of each video, long texts cut with dots."""
    head = F.when(F.length("text") > C.TEXT_HEAD, F.concat(F.substring("text", 1, C.TEXT_HEAD), F.lit("...")))
    samples = df.select(
        "video_id", "comment_id", "author", "classification", "mod_action", "timestamp", "emotional_score",
        head.otherwise(F.col("text")).alias("text"),
    )
    return top_per_group(samples, ["video_id"], [F.col("timestamp"), F.col("comment_id")], rows)


def score_display(df: DataFrame) -> DataFrame:
    """Percent texts and alert flags of the spam and toxicity scores."""
    spam, spam_alert = display_percent(F.col("spam_score"))
    toxicity, toxicity_alert = display_percent(F.col("toxicity_score"))
    return df.withColumns({
        "spam_display": spam, "spam_alert": spam_alert,
        "toxicity_display": toxicity, "toxicity_alert": toxicity_alert,
    })
