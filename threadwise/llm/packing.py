"""Best-fit packing of documents into sequences of fixed capacity, with documents that must not meet kept apart."""

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadwise.llm.shared import JOINED_ID, split_id, stored

#: Words of a sequence.
CAPACITY = 2048
#: Pieces that are packed together, about; their bins are closed with them.
GROUP = 4096


def best_fit(lengths: list[int], marks: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, placed in the given order.

    Bins are held in the order of their room left. The search starts at the first bin with enough room and goes on to
    its successors until one has none of the piece's marks (bits of a source and of a cluster); that is the tightest
    bin that may take it. Without one a new bin is opened.
    """
    open_: list[tuple[int, int]] = []
    held: list[int] = []
    places = []
    for length, mark in zip(lengths, marks):
        at = bisect_left(open_, (length, -1))
        while at < len(open_) and held[open_[at][1]] & mark:
            at += 1
        if at < len(open_):
            room, bin_ = open_.pop(at)
        else:
            room, bin_ = capacity, len(held)
            held.append(0)
        held[bin_] |= mark
        places.append((bin_, capacity - room))
        if room > length:
            insort(open_, (room - length, bin_))
    return places


def bitmaps(sources: np.ndarray, clusters: np.ndarray) -> list[int]:
    """One bit per source, and one per cluster that has several pieces here (any other cannot meet its like)."""
    source = pd.factorize(sources, use_na_sentinel=False)[0]
    code, sizes = np.unique(clusters, return_inverse=True)[1], None
    sizes = np.bincount(code)
    rank = np.cumsum(sizes > 1) - 1
    shift = int(source.max()) + 1
    return [1 << int(s) | (1 << shift + int(rank[c]) if sizes[c] > 1 else 0) for s, c in zip(source, code)]


def packed(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, source, cluster, length) with their pieces' place: piece, start, n_words, bin_id, bin_offset.

    A document longer than the capacity is cut into pieces of the capacity, each of which fills a bin, and a rest.
    No bin has two pieces of one source or of one cluster; a null source is a source of its own, a null cluster is
    none. Empty documents (length null or under 1) take no place and have no row. Rows are dealt out evenly whatever
    their keys, so that a source or cluster with most rows spreads; about `group` pieces are packed together,
    longest first, which bounds the memory of a task; the deal depends on the pieces alone. bin_id is unique. Repeated rows are packed as often as they
    come, apart by their cluster.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = [], 0
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= 2 * group:  # rows that are equal in all their keys
                rows = pd.concat(held, ignore_index=True)
                yield pack(rows.iloc[:group], number)
                held, number = [rows.iloc[group:]], number + 1
        if sum(map(len, held)):
            yield pack(pd.concat(held, ignore_index=True), number)

    def pack(rows: pd.DataFrame, number: int) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "none", "key", "piece", "cluster"], ascending=[False, True, True, True, True])
        marks = bitmaps(rows["source"].to_numpy(object), rows["cluster"].to_numpy(np.int64))
        places = best_fit(rows["n_words"].tolist(), marks, capacity)
        base = int(rows["task"].iloc[0]) * (1 << 33) + number * 2 * group
        return rows.assign(
            bin_id=np.array([b for b, _ in places], np.int64) + base, bin_offset=[o for _, o in places])

    length = F.col("length").cast("long")
    # A document without a cluster gets one of its own from its row number.
    cut = pieces.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("cluster").cast("long"), -F.monotonically_increasing_id() - 1).alias("cluster"),
        length.alias("length")).where("length > 0")
    cut = cut.select("doc_id", "source", "cluster", F.posexplode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(capacity).cast("long")),
        lambda s: F.struct(s.alias("start"), F.least(F.col("length") - s, F.lit(capacity)).alias("n_words"))
    )).alias("piece", "part")).select("doc_id", "source", "cluster", "piece", "part.*")
    # Dealt by a hash of the piece into tasks of about a group each: the bins are the same whatever the partitions are.
    cut = stored(cut, "pieces")
    groups = -(-cut.count() // group) or 1
    dealt = cut.repartition(groups, F.xxhash64("doc_id", "cluster", "piece")).select(
        *split_id(F.col("doc_id")), "source", "cluster", "piece", "start", "n_words", F.spark_partition_id().alias("task"))
    packed_rows = dealt.mapInPandas(run, "none boolean, key long, source string, cluster long, piece int, start long, "
                                         "n_words long, task int, bin_id long, bin_offset long")
    return packed_rows.select(
        F.expr(JOINED_ID).alias("doc_id"), "source", "cluster", "piece", "start", "n_words", "bin_id", "bin_offset")
