"""Declared table schemas, as DDL text."""

VIDEOS = (
    "video_id STRING, title STRING, channel_title STRING, thumbnail_url STRING, created_at TIMESTAMP_NTZ"
)

SPAM_FEATURES_DDL = (
    "length BIGINT, word_count BIGINT, avg_word_length DOUBLE, capitals_ratio DOUBLE, digits_ratio DOUBLE, "
    "punctuation_ratio DOUBLE, exclamation_count BIGINT, question_count BIGINT, url_count BIGINT, "
    "has_email BIGINT, spam_word_ratio DOUBLE"
)

COMMENTS = (
    "comment_id STRING, video_id STRING, parent_id STRING, author STRING, text STRING, likes BIGINT, "
    "reply_count BIGINT, timestamp TIMESTAMP_NTZ, content_class STRING, sentiment STRING, classification STRING, "
    "mod_action STRING, reason STRING, responded BOOLEAN, emotional_score DOUBLE, toxicity_score DOUBLE, "
    "sentiment_scores MAP<STRING,DOUBLE>, toxicity_scores MAP<STRING,DOUBLE>, spam_score DOUBLE, is_spam BOOLEAN, "
    f"spam_features STRUCT<{SPAM_FEATURES_DDL}>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)

SPAM_TRAINING = (
    f"comment_id STRING, text STRING, features STRUCT<{SPAM_FEATURES_DDL}>, is_spam BOOLEAN, confidence DOUBLE, "
    "labeled_at TIMESTAMP_NTZ, trained_at TIMESTAMP_NTZ"
)

MODEL_VERSIONS = (
    "model_type STRING, version STRING, metrics STRING, parameters STRING, created_at TIMESTAMP_NTZ"
)

MODEL_METRICS = ("model_type STRING, metrics STRING, created_at TIMESTAMP_NTZ")

# Columns that must not be NULL, and unique keys, per table.
COMMENTS_NOT_NULL = ["video_id", "comment_id", "author", "text", "timestamp"]

# Landed API documents. `request` holds the parameters of the call that produced the document.
SNIPPET_DDL = "STRUCT<authorDisplayName: STRING, textDisplay: STRING, likeCount: BIGINT, publishedAt: STRING>"
THREADS_DOCUMENT = (
    "request STRUCT<videoId: STRING>, items ARRAY<STRUCT<id: STRING, "
    f"snippet: STRUCT<totalReplyCount: BIGINT, topLevelComment: STRUCT<snippet: {SNIPPET_DDL}>>, "
    f"replies: STRUCT<comments: ARRAY<STRUCT<id: STRING, snippet: {SNIPPET_DDL}>>>>>"
)
VIDEO_DOCUMENT = (
    "request STRUCT<videoId: STRING>, items ARRAY<STRUCT<id: STRING, snippet: STRUCT<title: STRING, channelTitle: STRING, "
    "thumbnails: STRUCT<default: STRUCT<url: STRING>>>>>"
)
