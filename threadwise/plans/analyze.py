"""Analysis of new comments: toxicity, sentiment and spam columns, classes, write-back."""

from pyspark.sql import DataFrame, functions as F

from threadwise.functions.labels import (
    combined_class, content_class, encode_sentiment, sentiment_label, toxicity_summary,
)
from threadwise.functions.text import FEATURES, spam_verdict, text_features
from threadwise.operators.filters import unanalyzed
from threadwise.operators.merge import apply_updates


#: Columns of the comment table that an analysis fills.
STORED = ["classification", "content_class", "sentiment", "emotional_score", "toxicity_score", "spam_score", "is_spam",
          "toxicity_scores", "sentiment_scores", "spam_features"]


def analyze(scored: DataFrame, probability: str = "p", toxicity: str = "toxicity", compound: str = "compound",
            text: str = "text", sentiment_scores: str | None = None) -> DataFrame:
    """Result columns out of the model columns; rows without text are errors and keep no result.

    `scored` holds the spam probability, the (label, score) list and the compound sentiment of each comment, and
    maybe a map of its sentiment scores. The scores of all labels, the text features and the sentiment scores are
    results too. The sentiment does not influence the content class. A comment that no model could score (no
    probability, no list or no compound) is an error as well.
    """
    described = text_features(scored, text).withColumn("spam_features", F.struct(*FEATURES)).drop(*FEATURES)
    summarised = toxicity_summary(spam_verdict(described, probability, text), toxicity)
    given = F.col(sentiment_scores) if sentiment_scores else F.create_map(F.lit("compound"), F.col(compound))
    classed = summarised.withColumns({
        "is_error": F.col(text).isNull() | F.col(toxicity).isNull() | F.col(compound).isNull(),
        "toxicity_scores": F.map_from_entries(toxicity),
        "sentiment_scores": given.cast("map<string,double>"),
        "sentiment": sentiment_label(F.col(compound)),
        "emotional_score": F.col(compound),
        "content_class": content_class(F.col("toxicity_score"), F.col("spam_score")),
    }).withColumn("classification", combined_class(F.col("content_class"), F.col("sentiment")))
    results = [*STORED, "confidence"]
    return classed.withColumns({c: F.when(~F.col("is_error"), F.col(c)) for c in results})


def analyze_queue(comments: DataFrame, **columns: str) -> DataFrame:
    """Analysis of the comments that have no class or no spam score yet."""
    return analyze(unanalyzed(comments), **columns)


def write_back(comments: DataFrame, results: DataFrame) -> DataFrame:
    """Comments with the results of the analysed rows; error rows stay in the queue."""
    columns = [c for c in STORED if c in comments.columns]
    return apply_updates(comments, results.filter("not is_error").select("comment_id", *columns), "comment_id")


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(~F.col("is_error")).alias("processed"), F.count_if("is_error").alias("errors"))


def sentiment_document(results: DataFrame, scores: str) -> DataFrame:
    """Add the sentiment document as stored text."""
    return results.withColumn("sentiment_scores", encode_sentiment(F.col("sentiment"), F.col(scores)))
