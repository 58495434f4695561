"""Human spam labels: requests, label log, comment updates and the retrain trigger."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C
from threadwise.operators.merge import apply_updates, first_per_key

NOT_FOUND = "comment not found"
NOT_BOOLEAN = "label is not boolean"


@dataclass(frozen=True)
class Marked:
    """Result of a batch of label requests."""

    outcomes: DataFrame   # one row per request: status and error
    labels: DataFrame     # rows to append to the label log
    comments: DataFrame   # the comments after the update


def label_lookup(requests: DataFrame, comments: DataFrame, columns: list[str]) -> DataFrame:
    """Requests with the stored columns of their comments."""
    stored = comments.select("comment_id", *columns)
    return requests.join(stored, "comment_id")


def missing_ids(requests: DataFrame, comments: DataFrame) -> DataFrame:
    """Requested comments that are not stored."""
    asked = requests.select("request_id", "comment_id").distinct()
    return asked.join(comments.select("comment_id"), "comment_id", "left_anti")


def latest_label(labels: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The last label of each comment; the log keeps all of them."""
    return first_per_key(labels, "comment_id", order or [F.desc("labeled_at")])


def request_outcomes(requests: DataFrame, comments: DataFrame) -> DataFrame:
    known = comments.select("comment_id", F.lit(True).alias("__known"))
    error = F.when(F.col("is_spam").isNull(), NOT_BOOLEAN).when(F.col("__known").isNull(), NOT_FOUND)
    return (
        requests.join(known, "comment_id", "left")
        .withColumn("error", error)
        .withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))
        .drop("__known")
    )


def labels_from(found: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Label log rows of requests joined to their texts; trained_at stays NULL until a training run stamps it."""
    return found.select(
        "comment_id", "text", "is_spam", F.lit(confidence).alias("confidence"),
        F.col("requested_at").alias("labeled_at"), F.lit(None).cast("timestamp_ntz").alias("trained_at"),
    )


def updates_from(accepted: DataFrame) -> DataFrame:
    """The last accepted label of each comment as a comment update."""
    last = first_per_key(accepted, "comment_id", [F.desc("requested_at"), F.desc("request_id")])
    return last.select(
        "comment_id", "is_spam", F.col("is_spam").cast("double").alias("spam_score"),
        F.col("requested_at").alias("updated_at"),
    )


def mark_spam(requests: DataFrame, comments: DataFrame, confidence: float = 1.0) -> Marked:
    """Apply label requests (request_id, comment_id, is_spam, requested_at) one by one."""
    outcomes = request_outcomes(requests, comments)
    valid = requests.filter("is_spam is not null")
    updated = apply_updates(comments, updates_from(valid), "comment_id")
    return Marked(outcomes, labels_from(label_lookup(valid, comments, ["text"]), confidence), updated)


def mark_spam_bulk(requests: DataFrame, comments: DataFrame, confidence: float = 1.0) -> Marked:
    """Apply label requests as sets (request_id, is_spam): a set with any unknown comment changes nothing.

    Repeated comments in a set count once.
    """
    asked = requests.groupBy("request_id", "is_spam", "comment_id").agg(F.max("requested_at").alias("requested_at"))
    known = comments.select("comment_id", F.lit(True).alias("__known"))
    checked = asked.join(known, "comment_id", "left")
    sets = checked.groupBy("request_id", "is_spam").agg(
        F.count("*").alias("total"), F.count_if(F.col("__known").isNull()).alias("missing")
    )
    error = F.when(F.col("is_spam").isNull(), NOT_BOOLEAN).when(F.col("missing") > 0, NOT_FOUND)
    outcomes = (
        sets.withColumn("error", error)
        .withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))
        .withColumn("processed", F.when(F.col("error").isNull(), F.col("total")).otherwise(0).cast("bigint"))
    )
    complete = outcomes.filter("status = 'success'").select("request_id", "is_spam")
    accepted = asked.join(complete, ["request_id", "is_spam"], "left_semi")
    updated = apply_updates(comments, updates_from(accepted), "comment_id")
    return Marked(outcomes, labels_from(label_lookup(accepted, comments, ["text"]), confidence), updated)


def newer_than_model(labels: DataFrame, versions: DataFrame, model_type: str = "spam") -> DataFrame:
    """Labels given after the newest model of the type, or all labels without one."""
    newest = versions.filter(F.col("model_type") == model_type).agg(F.max("created_at")).scalar()
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return labels.filter(F.col("labeled_at") > F.coalesce(newest, epoch))


def retrain_due(labels: DataFrame, versions: DataFrame, model_type: str = "spam",
                after: int = C.RETRAIN_AFTER) -> DataFrame:
    """One row: labels no training has seen, labels newer than the model, and whether either calls for training."""
    newer = newer_than_model(labels, versions, model_type).agg(F.count("*")).scalar()
    counted = labels.agg(F.count_if(F.col("trained_at").isNull()).alias("untrained_labels"))
    return counted.withColumn("newer_labels", newer).withColumns({
        "due_by_untrained": F.col("untrained_labels") >= after,
        "due_by_newer": F.col("newer_labels") >= after,
    })


def mark_trained(labels: DataFrame, trained_at: Column) -> DataFrame:
    """Stamp the labels a training run has used."""
    return labels.withColumn("trained_at", F.coalesce("trained_at", trained_at.cast("timestamp_ntz")))
