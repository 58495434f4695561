"""Mixing sources to target weights: exact word budgets cut from a random order of each source."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from threadwise.llm.shared import JOINED_ID, fresh, split_id, stored, text_key, with_row_key, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words.
MOST = 3


def running(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """The rows range-sorted by keys, with `before`: the sum of value over the rows of the same group before each.

    keys begin with the group, which may be null. A task sums up its own range of rows; a group that spans many ranges
    gets the sums of the earlier ranges from one row per range and group.
    """
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = (), 0  # no group equals the empty tuple
        for batch in batches:
            if not len(batch):
                continue
            name = batch[group]
            values = batch[value].to_numpy(np.int64)
            codes = pd.factorize(name, use_na_sentinel=True)[0]
            sums = np.cumsum(values) - values
            first = np.concatenate(([True], np.diff(codes) != 0))
            start = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
            same = start == 0
            head = None if codes[0] == -1 else name.iloc[0]
            carry = total if last == (head,) else 0
            inside = sums - sums[start] + np.where(same, carry, 0)
            yield batch.assign(inside=inside)
            last, total = (None if codes[-1] == -1 else name.iloc[-1],), int(inside[-1] + values[-1])

    schema = rows.schema.simpleString()[len("struct<"):-1] + ",inside:bigint"
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(add_up, schema)
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    starts = (
        ranged.groupBy(F.col(group).alias("g"), F.col("range").alias("r")).agg(F.sum(value).alias("s"))
        .select("g", "r", F.coalesce(F.sum("s").over(
            W.partitionBy("g").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start")))
    return ranged.join(starts, F.col(group).eqNullSafe(F.col("g")) & (F.col("range") == F.col("r"))).select(
        *rows.columns, (F.col("inside") + F.col("start")).alias("before"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with target: shares of all sizes by weight, each at most `most` times its source.

    The excess of a source at its limit goes to the others by weight. A round is one aggregate over the sources;
    sources at their limit stay there as the share of the others only rises.
    """
    ranks = running(sources.withColumn("all", F.lit(0)).withColumn("one", F.lit(1).cast("long")).withColumn(
        "none", F.col("source").isNull()), ["all", "none", "source"], "all", "one")
    weight = F.array(*[F.lit(w) for w in weights])[(F.col("before") % len(weights)).cast("int")].cast("long")
    ranked = stored(ranks.select("source", "source_size", weight.alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    limit = F.col("source_size") * most
    while True:
        full = limit <= F.col("weight") * F.lit(share)
        n, taken, free = ranked.agg(
            F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, share = n, (total - (taken or 0)) / free
    return ranked.select("source", "source_size", F.least(
        limit.cast("double"), F.col("weight") * F.lit(float(share))).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, thash, size, source_size, target, taken) per row of the documents.

    Documents of a source come in the order of a hash of their id (then of the text, then as stored, so that
    repeated rows spread). A source's budget is its target rounded to words: every document as often as the budget
    holds the whole source, then from the front of the order until the rest is used up, the last one partly. A null
    source is a source like any other, last in order; null and empty texts have size 0 and give nothing. A null id is
    hashed like a value. No documents give no rows.
    """
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("thash"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    order = rows.select(
        *split_id(F.col("doc_id")), "thash", "source", "size", F.col("source").isNull().alias("last"),
        F.xxhash64("doc_id", F.lit("mix")).alias("order"), F.monotonically_increasing_id().alias("row"))
    before = running(order, ["last", "source", "order", "thash", "row"], "source", "size")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    at = sources.withColumnRenamed("source", "s")
    return before.join(at, F.col("source").eqNullSafe(F.col("s"))).select(
        F.expr(JOINED_ID).alias("doc_id"), "thash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix as documents: each one as many times as words were taken from it, in whole documents.

    The one document of a source that the budget cuts through stays whole. Repeated equal rows (id and text) are
    numbered alike in both tables by summing up their copies first.
    """
    picked = mixed(docs, weights, most).where("taken > 0").select(
        "doc_id", "thash", F.ceil(F.col("taken") / F.col("size")).alias("n"))
    rows, key = with_row_key(docs, F.col("doc_id"), text_key(F.col("text")))
    picked, picked_key = with_row_key(picked, F.col("doc_id"), F.col("thash"))
    picked = picked.groupBy(*[F.col(p).alias(k) for p, k in zip(picked_key, key)]).agg(
        F.sum("n").cast("int").alias(copies := fresh(docs, "copies")))
    return rows.dropDuplicates(key).join(picked, key).withColumn(
        copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
