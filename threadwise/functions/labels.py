"""Class and sentiment labels, toxicity summary, display values, API times and JSON score columns."""

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C
from threadwise.functions import patterns as P


def sentiment_label(compound: Column) -> Column:
    return (
        F.when(compound > C.SENTIMENT_CUT, "positive")
        .when(compound < -C.SENTIMENT_CUT, "negative")
        .otherwise("neutral")
    )


def content_class(toxicity: Column, spam: Column) -> Column:
    return (
        F.when(spam >= C.CLASS_SPAM, "spam")
        .when(toxicity >= C.CLASS_TOXIC, "toxic")
        .when((toxicity >= C.CLASS_QUESTIONABLE_TOXICITY) | (spam >= C.CLASS_QUESTIONABLE_SPAM), "questionable")
        .otherwise("safe")
    )


def combined_class(content: Column, sentiment: Column) -> Column:
    return F.concat(content, F.lit(":"), sentiment)


def split_classification(classification: Column) -> tuple[Column, Column]:
    """Content class and sentiment of a combined class; absent parts get their defaults."""
    parts = F.split(classification, ":")
    combined = classification.contains(":")
    content = F.when(combined, F.get(parts, F.lit(0))).otherwise(
        F.coalesce(F.nullif(classification, F.lit("")), F.lit("unclassified"))
    )
    sentiment = F.when(combined, F.get(parts, F.lit(1))).otherwise(F.lit("neutral"))
    return content, sentiment


def toxicity_summary(df: DataFrame, scores: str = "toxicity") -> DataFrame:
    """Add the top label, its score and the other labels above the concern mark.

    `scores` is an array of (label, score). The first of equal scores wins, as in list order.
    No scores means ('unknown', 0.0, no concerns).
    """
    entries = F.col(scores)
    best = F.col("__best")
    top = F.get(F.filter(entries, lambda e: e["score"] == F.array_max(F.transform(entries, lambda x: x["score"]))), F.lit(0))
    others = F.filter(entries, lambda e: (e["score"] > C.TOXICITY_CONCERN_ABOVE) & (e["label"] != best["label"]))
    return df.withColumn("__best", top).withColumns({
        "main_category": F.coalesce(best["label"], F.lit("unknown")),
        "toxicity_score": F.coalesce(best["score"], F.lit(0.0)),
        "other_concerns": F.coalesce(others, F.filter(F.array(best), lambda e: F.lit(False))),
    }).drop("__best")


def display_percent(score: Column) -> tuple[Column, Column]:
    """Percent text with one decimal and the alert flag."""
    percent = F.round(score * 100, 1).cast("decimal(6,1)").cast("string")
    return F.concat(percent, F.lit("%")), score > C.DISPLAY_ALERT_ABOVE


def keyword_weight(count: Column) -> Column:
    """Font weight of a keyword in a cloud."""
    return F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.log2(count)))


def parse_api_time(text: Column, load_time: Column) -> Column:
    """API time text as a zone-free timestamp; bad or absent text becomes the load time."""
    parsed = F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")
    return F.coalesce(F.when(text.rlike(P.API_TIME), parsed), load_time.cast("timestamp_ntz"))


SCORES = "map<string,double>"


def encode_sentiment(sentiment: Column, scores: Column) -> Column:
    """Sentiment document as stored text: the score map is text inside the text."""
    return F.to_json(F.struct(sentiment.alias("sentiment"), F.to_json(scores).alias("scores")))


def decode_sentiment(document: Column) -> tuple[Column, Column]:
    """Sentiment label and score map of a stored sentiment document."""
    outer = F.from_json(document, "sentiment STRING, scores STRING")
    return outer["sentiment"], F.from_json(outer["scores"], SCORES)
