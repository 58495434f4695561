"""Statistics documents per video, for all videos in one job."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from threadwise.operators import keywords as K
from threadwise.operators import statistics as S
from threadwise.operators.filters import sample_comments
from threadwise.operators.joins import null_safe_join


def _scalars(authors: DataFrame, hours: DataFrame, by: list[str]) -> DataFrame:
    """One row per `by` out of the partial statistics."""
    merged = S.merge_author_stats(authors, by)
    columns = {**S.engagement_columns(), **S.emotion_columns(), "total_word_count": F.col("words")}
    base = merged.select(*by, *[c.alias(n) for n, c in columns.items()])
    times = S.merge_hour_stats(hours, by)
    if by:
        joined = null_safe_join(base, times, by, "left")
    else:
        one = times.select(F.struct(*times.columns)).scalar()
        joined = base.withColumns({c: one[c] for c in times.columns})
    words_per_comment = F.try_divide(F.col("total_word_count"), F.col("total_comments"))
    return joined.withColumns({
        "total_word_count": F.coalesce("total_word_count", F.lit(0)),
        "avg_words_per_comment": F.coalesce(F.round(words_per_comment, 2), F.lit(0.0)),
    })


def comment_stats(comments: DataFrame, overall: bool = True) -> DataFrame:
    """Scalar statistics per video and, with `overall`, one row over all videos (video_id NULL).

    The overall row is merged from the per-video partial rows; no comment is counted twice.
    """
    words = comments.withColumn("__words", K.insight_words(F.col("text")))
    authors, hours = S.author_stats(words, {"words": F.sum("__words")}), S.hour_stats(comments)
    per_video = _scalars(authors, hours, ["video_id"])
    if not overall:
        return per_video
    total = _scalars(authors, hours, []).withColumn("video_id", F.lit(None).cast("string"))
    return per_video.unionByName(total)


def _ranked_array(df: DataFrame, rank: str, columns: list[str | Column], name: str) -> DataFrame:
    """The few ranked rows of each video as one array."""
    ranked = F.collect_list(F.struct(rank, F.struct(*columns).alias("row")))
    rows = F.array_sort(ranked, lambda a, b: (a[rank] - b[rank]).cast("int"))
    return df.groupBy("video_id").agg(F.transform(rows, lambda x: x["row"]).alias(name))


def comment_stats_document(comments: DataFrame) -> DataFrame:
    """One row per video: scalar statistics, breakdown maps, top commenters, keywords and sample comments."""
    commenters = ["author", "comment_count", "avg_emotional_score", "avg_scored", "classifications"]
    samples = ["text", "author", "classification", "mod_action", "timestamp", "emotional_score"]
    parts = [
        S.counts_map(S.class_breakdown(comments), "classification", "classification_breakdown"),
        S.counts_map(S.mod_action_counts(comments, drop_empty=True), "mod_action", "mod_action_breakdown"),
        _ranked_array(S.top_commenters(comments), "author_rank", commenters, "top_commenters"),
        _ranked_array(K.keywords_insight(comments), "keyword_rank", ["keyword", "n"], "top_keywords"),
        sample_comments(comments).groupBy("video_id").agg(
            F.array_sort(F.collect_list(F.struct("timestamp", "comment_id", F.struct(*samples).alias("row")))).alias("__s")
        ).select("video_id", F.transform("__s", lambda x: x["row"]).alias("sample_comments")),
    ]
    return reduce(lambda doc, part: null_safe_join(doc, part, ["video_id"], "left"), parts, comment_stats(comments, overall=False))


def analysis_summary(comments: DataFrame) -> DataFrame:
    """One row per video: class counts, action counts, emotion bands and top keywords, the lists as JSON text."""
    classes = S.counts_map(S.class_counts(comments), "classification", "classifications")
    actions = S.counts_map(S.mod_action_counts(comments), "mod_action", "mod_actions")
    words = _ranked_array(K.keywords_summary(comments), "keyword_rank", ["keyword", "n"], "__words")
    keywords = F.map_from_entries("__words")
    parts = [classes, actions, words]
    return reduce(lambda a, b: null_safe_join(a, b, ["video_id"], "left"), parts, S.emotion_bands(comments)).select(
        "video_id", "positive", "neutral", "negative",
        F.coalesce(F.to_json("classifications"), F.lit("{}")).alias("classifications"),
        F.coalesce(F.to_json("mod_actions"), F.lit("{}")).alias("mod_actions"),
        F.coalesce(F.to_json(keywords), F.lit("{}")).alias("top_keywords"),
    )


def summary_prompts(document: DataFrame) -> DataFrame:
    """A report request per video for an external text model, the statistics as JSON sections."""
    sections = [
        ("Classification breakdown", F.to_json("classification_breakdown")),
        ("Moderation actions", F.to_json("mod_action_breakdown")),
        ("Engagement", F.to_json(F.struct("responded_comments", "response_rate", "unique_authors"))),
        ("Time patterns", F.to_json(F.struct("first_comment", "last_comment", "avg_hours_between", "most_active_hour"))),
        ("Top commenters", F.to_json("top_commenters")),
        ("Keywords", F.to_json(F.struct("top_keywords", "total_word_count", "avg_words_per_comment"))),
        ("Emotions", F.to_json(F.struct("avg_emotional_score", "max_emotional_score", "min_emotional_score",
                                        "positive", "neutral", "negative"))),
    ]
    head = F.concat(F.lit("Summarise these comment statistics for the creator of the video.\nTotal comments: "),
                    F.col("total_comments").cast("string"))
    bodies = [F.concat(F.lit(f"{title}:\n"), F.coalesce(body, F.lit("{}"))) for title, body in sections]
    tail = F.lit("Describe audience engagement, content trends and recommendations.")
    return document.select("video_id", F.concat_ws("\n\n", head, *bodies, tail).alias("prompt"))
