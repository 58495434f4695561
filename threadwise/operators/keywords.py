"""Keyword reports. Words are counted per (video, word) before anything is ranked."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C
from threadwise.functions.labels import keyword_weight
from threadwise.functions.text import long_tokens, tokens
from threadwise.operators.joins import null_safe_join
from threadwise.operators.ordering import top_per_group


def word_counts(comments: DataFrame, split: Callable[[Column], Column] = tokens,
                stop_words: list[str] = C.STOP_WORDS) -> DataFrame:
    """Occurrences of each word in the texts of each video, stop words left out."""
    exploded = comments.select("video_id", F.explode(split(F.lower("text"))).alias("keyword"))
    kept = exploded.filter(~F.col("keyword").isin(stop_words))
    return kept.groupBy("video_id", "keyword").agg(F.count("*").alias("n"))


def _top(counts: DataFrame, k: int) -> DataFrame:
    return top_per_group(counts, ["video_id"], [F.desc("n"), F.col("keyword")], k, "keyword_rank")


def keywords_summary(comments: DataFrame, k: int = C.TOP_KEYWORDS) -> DataFrame:
    """Top words of each video, of any length."""
    return _top(word_counts(comments), k)


def insight_word_counts(comments: DataFrame) -> DataFrame:
    """Counts of the words of at least three characters."""
    return word_counts(comments, long_tokens)


def insight_words(text: Column, stop_words: list[str] = C.STOP_WORDS) -> Column:
    """Number of the counted words of a text, without bringing them together."""
    return F.size(F.filter(long_tokens(F.lower(text)), lambda t: ~t.isin(stop_words)))


def keywords_insight(comments: DataFrame, k: int = C.TOP_KEYWORDS) -> DataFrame:
    """Top words of at least three characters, with the kept words of the video and their mean per comment."""
    totals = comments.groupBy("video_id").agg(
        F.sum(insight_words(F.col("text"))).alias("total_word_count"), F.count("*").alias("__comments"))
    per_comment = F.round(F.col("total_word_count") / F.col("__comments"), 2)
    return (
        null_safe_join(_top(insight_word_counts(comments), k), totals, ["video_id"], "inner")
        .withColumn("avg_words_per_comment", per_comment).drop("__comments")
    )


def keyword_cloud(comments: DataFrame, k: int = C.TOP_KEYWORDS) -> DataFrame:
    return _top(insight_word_counts(comments), k).withColumn("weight", keyword_weight(F.col("n")))
