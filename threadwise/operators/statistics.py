"""Per-video counts and statistics.

Distinct authors, author rankings and active hours come from a first aggregate on (video, author) or
(video, hour), so that a video with very many comments is spread over the cluster; the second aggregate
sees only those partial rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C
from threadwise.functions.times import hour_bucket, hours_between
from threadwise.operators.filters import since_days
from threadwise.operators.ordering import top_per_group


def video_overview(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """Every video with its comment count, first and last comment and class counts, latest activity first."""
    per_video = comments.groupBy("video_id").agg(
        F.count("*").alias("comment_count"),
        F.min("timestamp").alias("first_comment"),
        F.max("timestamp").alias("last_comment"),
        F.count_if(F.col("content_class") == "toxic").alias("toxic_count"),
        F.count_if(F.col("content_class") == "questionable").alias("questionable_count"),
        F.count_if("is_spam").alias("spam_count"),
    )
    counts = ["comment_count", "toxic_count", "questionable_count", "spam_count"]
    joined = videos.select("video_id", "title", "channel_title", "thumbnail_url").join(per_video, "video_id", "left")
    return joined.fillna(0, counts).orderBy(F.desc_nulls_last("last_comment"), "video_id")


def _counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("video_id", column).agg(F.count("*").alias("n"))


def class_counts(comments: DataFrame) -> DataFrame:
    """Comments per class; comments without class are their own group."""
    return _counts_by(comments, "classification")


def class_breakdown(comments: DataFrame) -> DataFrame:
    return _counts_by(comments.filter("classification <> ''"), "classification")


def mod_action_counts(comments: DataFrame, drop_empty: bool = False) -> DataFrame:
    kept = comments.filter("mod_action <> ''" if drop_empty else "mod_action is not null")
    return _counts_by(kept, "mod_action")


def counts_map(counts: DataFrame, column: str, name: str) -> DataFrame:
    """Counts of a label column as one sorted map per video. The labels are a small vocabulary."""
    label = F.coalesce(F.col(column), F.lit("null"))
    entries = F.array_sort(F.collect_list(F.struct(label, "n")))
    return counts.groupBy("video_id").agg(F.map_from_entries(entries).alias(name))


def emotion_bands(comments: DataFrame) -> DataFrame:
    """Positive, neutral and negative comments; the band ends +-0.3 count in two bands."""
    score = F.col("emotional_score")
    return comments.groupBy("video_id").agg(
        F.count_if(score >= 0.3).alias("positive"),
        F.count_if(score.between(-0.3, 0.3)).alias("neutral"),
        F.count_if(score <= -0.3).alias("negative"),
    )


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def _score_bands() -> dict[str, Column]:
    score = F.col("emotional_score")
    return {
        "positive": F.count_if(score > 0.5),
        "neutral": F.count_if(score.between(0.3, 0.7)),
        "negative": F.count_if(score < 0.5),
    }


def _score_stats() -> dict[str, Column]:
    score = F.col("emotional_score")
    return {
        "score_sum": F.sum(score), "scored": F.count(score), "score_max": F.max(score), "score_min": F.min(score),
        **_score_bands(),
    }


def author_stats(comments: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Partial statistics per (video, author), with `more` sums."""
    counts = {"comments": F.count("*"), "responded": F.count_if("responded"), **(more or {})}
    return comments.groupBy("video_id", "author").agg(*_named({**counts, **_score_stats()}))


def _merged(stats: DataFrame) -> list[Column]:
    merge = {"score_max": F.max, "score_min": F.min}
    return [merge.get(c, F.sum)(c).alias(c) for c in stats.columns if c not in ("video_id", "author")]


def merge_author_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """Totals of author statistics per `by`, with the number of authors."""
    if "video_id" not in by:
        stats = stats.groupBy("author").agg(*_merged(stats))
    return stats.groupBy(*by).agg(*_merged(stats), F.count("*").alias("unique_authors"))


def engagement_columns() -> dict[str, Column]:
    rate = F.try_divide(F.col("responded") * 100, F.col("comments"))
    return {
        "total_comments": F.col("comments"),
        "responded_comments": F.col("responded"),
        "response_rate": F.coalesce(F.round(rate, 2), F.lit(0.0)),
        "unique_authors": F.col("unique_authors"),
    }


def emotion_columns() -> dict[str, Column]:
    return {
        "avg_emotional_score": F.round(F.try_divide(F.col("score_sum"), F.col("scored")), 2),
        "max_emotional_score": F.round("score_max", 2),
        "min_emotional_score": F.round("score_min", 2),
        "positive": F.col("positive"),
        "neutral": F.col("neutral"),
        "negative": F.col("negative"),
    }


def engagement(comments: DataFrame) -> DataFrame:
    totals = merge_author_stats(author_stats(comments), ["video_id"])
    return totals.select("video_id", *_named(engagement_columns()))


def emotion_stats(comments: DataFrame) -> DataFrame:
    """Mean, extremes and overlapping bands of the emotional scores; has_scores is false where there are none."""
    stats = comments.groupBy("video_id").agg(*_named(_score_stats()))
    return stats.select("video_id", (F.col("scored") > 0).alias("has_scores"), *_named(emotion_columns()))


def distinct_authors(comments: DataFrame, error: float | None = None) -> DataFrame:
    """Authors per video; with a relative error the count is approximate and no author is shuffled."""
    authors = F.countDistinct("author") if error is None else F.approx_count_distinct("author", error)
    return comments.groupBy("video_id").agg(authors.alias("unique_authors"))


def top_commenters(comments: DataFrame, k: int = C.TOP_COMMENTERS) -> DataFrame:
    """Most active authors of each video with mean scores and a map of their class counts.

    avg_emotional_score divides by all comments of the author, avg_scored by the scored ones.
    """
    by_class = comments.groupBy("video_id", "author", "classification").agg(
        F.count("*").alias("n"), F.sum("emotional_score").alias("score_sum"), F.count("emotional_score").alias("scored")
    )
    named = F.when(F.col("classification") != "", F.struct("classification", "n"))
    total = F.sum("n")
    score_sum = F.coalesce(F.sum("score_sum"), F.lit(0.0))
    authors = by_class.groupBy("video_id", "author").agg(
        total.alias("comment_count"),
        F.round(score_sum / total, 2).alias("avg_emotional_score"),
        F.round(F.try_divide(score_sum, F.sum("scored")), 2).alias("avg_scored"),
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("classifications"),
    )
    return top_per_group(authors, ["video_id"], [F.desc("comment_count"), F.col("author")], k, "author_rank")


def spam_trends(comments: DataFrame, days: int = C.HISTORY_DAYS, as_of: Column | None = None) -> DataFrame:
    """Comments and spam per day over the last days."""
    recent = since_days(comments, days=days, as_of=as_of)
    total, spam = F.count("*"), F.count_if("is_spam")
    per_day = recent.groupBy(F.to_date("timestamp").alias("day")).agg(
        total.alias("total"), spam.alias("spam"), F.try_divide(spam, total).alias("ratio")
    )
    return per_day.orderBy("day")


def sample_counts(comments: DataFrame) -> DataFrame:
    """Spam and ham among the judged comments of each video."""
    judged = comments.filter("is_spam is not null")
    return judged.groupBy("video_id").agg(
        F.count_if("is_spam").alias("spam_samples"),
        F.count_if(~F.col("is_spam")).alias("ham_samples"),
        F.count("*").alias("total_samples"),
    )


def training_counts(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count("*").alias("total_samples"),
        F.count_if("is_spam").alias("spam_samples"),
        F.count_if(~F.col("is_spam")).alias("ham_samples"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def video_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("video_id").agg(F.count("*").alias("n"))


def facet_counts(comments: DataFrame) -> DataFrame:
    """Comments per class, per sentiment, per both and in all; the cube runs over the pre-counted pairs."""
    pairs = comments.groupBy("content_class", "sentiment").agg(F.count("*").alias("n"))
    return pairs.cube("content_class", "sentiment").agg(
        F.sum("n").alias("n"), F.grouping_id("content_class", "sentiment").cast("bigint").alias("level")
    )


def timeline(comments: DataFrame) -> DataFrame:
    """Comments per video and hour."""
    return comments.groupBy("video_id", hour_bucket(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("n"))


def hour_stats(comments: DataFrame) -> DataFrame:
    """Partial time statistics per (video, hour of day); unreadable times are left out."""
    timed = comments.filter("timestamp is not null")
    return timed.groupBy("video_id", F.hour("timestamp").cast("bigint").alias("hour")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


def merge_hour_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """First and last comment, mean gap and most active hour per `by`.

    The gaps between neighbours add up to last - first, so no sort is needed. Of equally active hours the
    one seen first wins.
    """
    if "video_id" not in by:
        stats = stats.groupBy("hour").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    totals = stats.groupBy(*by).agg(
        F.sum("n").alias("timed"), F.min("first").alias("first_comment"), F.max("last").alias("last_comment"),
        F.min_by("hour", F.struct(-F.col("n"), "first")).alias("most_active_hour"),
    )
    gap = F.try_divide(hours_between(F.col("first_comment"), F.col("last_comment")), F.col("timed") - 1)
    return totals.withColumn("avg_hours_between", F.coalesce(F.round(gap, 2), F.lit(0.0))).drop("timed")


def time_patterns(comments: DataFrame) -> DataFrame:
    return merge_hour_stats(hour_stats(comments), ["video_id"])
