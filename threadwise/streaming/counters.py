"""Keyed state of the label stream: partial counters, and the trigger that calls for training."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadwise import constants as C

#: Counters per model: no state cell takes the labels of more than this share's inverse.
COUNTER_BUCKETS = 64
#: Keyed state of this kind needs Spark's RocksDB state store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
COUNTS = "model_type STRING, batch INT, n BIGINT, newest BIGINT"
DECISIONS = "model_type STRING, batch INT, labels BIGINT, untrained_labels BIGINT, due BOOLEAN, newest BIGINT"


class BucketCounter(StatefulProcessor):
    """Labels of one (model, bucket) cell: what came of each label batch, and the cell's total in its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat([r.groupby("batch").agg(n=("at", "size"), newest=("at", "max")) for r in rows])
        found = parts.groupby(level=0).agg(n=("n", "sum"), newest=("newest", "max")).reset_index()
        held = self.total.get()[0] if self.total.exists() else 0
        self.total.update((held + int(found["n"].sum()),))
        yield found.assign(model_type=key[0])[["model_type", "batch", "n", "newest"]]

    def close(self) -> None:
        pass


class RetrainTrigger(StatefulProcessor):
    """Labels of one model that no training has seen, from the counters' rows: a few per label batch, however many labels.

    A label batch that brings them to `after` calls for training; that training has seen them all, so they count no more.
    """

    def __init__(self, after: int):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.untrained = handle.getValueState("untrained", "n BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = pd.concat(list(rows)).groupby("batch").agg(n=("n", "sum"), newest=("newest", "max")).sort_index()
        held, out = self.untrained.get()[0] if self.untrained.exists() else 0, []
        for batch, n, newest in batches.itertuples():
            held += int(n)
            due = held >= self.after
            out.append((key[0], batch, n, held, due, newest))
            held = 0 if due else held
        self.untrained.update((held,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    def close(self) -> None:
        pass


def retrain_decisions(labels: DataFrame, after: int = C.RETRAIN_AFTER, buckets: int = COUNTER_BUCKETS) -> DataFrame:
    """A stream of labels (model_type, comment_id, labeled_at, batch) to one row per model and label batch: its labels,
    the untrained ones with them, whether training is due, and the time up to which that training stamps its labels.

    The labels are counted per (model, hash bucket of the comment) and only these partial counts meet in the model's
    cell. A batch without labels has no row.
    """
    keyed = labels.select(
        "model_type", F.pmod(F.xxhash64("comment_id"), F.lit(buckets)).alias("bucket"), "batch",
        F.unix_micros(F.col("labeled_at").cast("timestamp")).alias("at"))
    partial = keyed.groupBy("model_type", "bucket").transformWithStateInPandas(BucketCounter(), COUNTS, "Append", "None")
    decided = partial.groupBy("model_type").transformWithStateInPandas(RetrainTrigger(after), DECISIONS, "Append", "None")
    stamp = F.when(F.col("due"), F.timestamp_micros("newest").cast("timestamp_ntz"))
    return decided.withColumn("trained_at", stamp).drop("newest")


def stamped(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """The label log with trained_at: the stamp of the first training due with a label's batch or after it."""
    due = decisions.filter("due").select("model_type", F.col("batch").alias("__due"), F.col("trained_at").alias("__at"))
    batches = decisions.select("model_type", "batch").join(due, "model_type").filter("__due >= batch")
    first = batches.groupBy("model_type", "batch").agg(F.min_by("__at", "__due").alias("__at"))
    return labels.join(first, ["model_type", "batch"], "left").withColumn(
        "trained_at", F.coalesce("trained_at", "__at")).select(*labels.columns)
