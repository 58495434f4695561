"""Exact top-k inner products by the three-phase uniform threshold."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from threadwise.llm.shared import stored

#: Segments that a vector is cut into, each with a score list of its own.
SEGMENTS = 2
#: Vectors and queries that meet in one task.
VECTORS, QUERIES = 16_384, 4_096
#: Queries scored at once inside a task.
SLAB = 64
LONG = (1 << 63) - 1


def scaled(rows: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(id, dim, vec) of the rows that take part: vec holds floor(factor * x) of each component as 64-bit doubles."""
    def run(batches):
        for batch in batches:
            found = []
            for v in batch["vec"]:
                v = np.floor(factor * np.asarray(v, np.float64)) + 0.0  # + 0.0: no negative zero
                found.append(v.tobytes())
            yield pd.DataFrame({"id": batch["id"], "dim": batch["vec"].map(len), "vec": found})

    vec = F.col(vector_col).cast("array<double>")
    valid = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()).where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return valid.mapInPandas(run, "id long, dim int, vec binary")


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while they hold them, else Python integers."""
    most = (np.abs(queries).max(initial=0) or 0) * (np.abs(vectors).max(initial=0) or 0) * max(1, queries.shape[1])
    if most < 2.0 ** 52:
        return queries @ vectors.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(vectors).T if queries.shape[1] else np.zeros((len(queries), len(vectors)))


def segment_scores(queries: np.ndarray, vectors: np.ndarray, segments: int) -> list[np.ndarray]:
    cuts = [queries.shape[1] * i // segments for i in range(segments + 1)]
    return [products(queries[:, a:b], vectors[:, a:b]) for a, b in zip(cuts, cuts[1:])]


def _cells(rows: pd.DataFrame):
    """Query numbers, cutoffs and matrix, vector numbers and matrix of a cell of the grid."""
    matrix = lambda r: np.frombuffer(b"".join(r["vec"]), np.float64).reshape(len(r), -1)
    asked, held = rows[rows["query"]], rows[~rows["query"]]
    return asked, matrix(asked) if len(asked) else None, held["cid"].to_numpy(), matrix(held) if len(held) else None


def _result(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    n = [len(c) for _, c, _ in found]
    score = [max(-LONG - 1, min(LONG, int(s))) for _, _, x in found for s in x]
    return pd.DataFrame({
        "qid": np.repeat(np.array([q for q, _, _ in found], np.int64), n),
        "cid": np.concatenate([c for _, c, _ in found] or [np.zeros(0, np.int64)]),
        "score": np.array(score, np.int64)})


def _lists(k: int, segments: int):
    """Phase 1: the best k vectors of each segment's list, with their whole scores."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked, q, cid, c = _cells(rows)
        found = []
        for at in range(0, len(asked) if c is not None else 0, SLAB):
            parts = segment_scores(q[at:at + SLAB], c, segments)
            total = sum(parts)
            for i, qid in enumerate(asked["cid"].iloc[at:at + SLAB]):
                best = [np.argpartition(-p[i], k - 1)[:k] if p.shape[1] > k else np.arange(p.shape[1]) for p in parts]
                best = np.unique(np.concatenate(best))
                found.append((qid, cid[best], total[i, best]))
        return _result(found)

    return run


def _sufficient(segments: int):
    """Phases 2 and 3: entries that reach the cutoff in some segment, resolved exactly, those of the threshold kept."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked, q, cid, c = _cells(rows)
        found = []
        for at in range(0, len(asked) if c is not None else 0, SLAB):
            parts = segment_scores(q[at:at + SLAB], c, segments)
            for i, (qid, least) in enumerate(zip(asked["cid"].iloc[at:at + SLAB], asked["least"].iloc[at:at + SLAB])):
                if pd.isna(least):
                    enough = np.arange(len(cid))
                else:
                    enough = np.flatnonzero(np.logical_or.reduce([p[i] * segments >= least for p in parts]))
                total = sum(p[i, enough] for p in parts)
                reach = np.ones(len(enough), bool) if pd.isna(least) else (total >= least).astype(bool)
                found.append((qid, cid[enough[reach]], total[reach]))
        return _result(found)

    return run


def _grid(vectors: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int):
    """Each cell (dim, i, j) meets a bounded share i of the vectors with a bounded share j of the queries."""
    nv, nq = -(-n_vectors // VECTORS) or 1, -(-n_queries // QUERIES) or 1
    own = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select("cid", "dim", "vec", F.lit(False).alias("query"), F.lit(None).cast("double").alias("least"),
                          own(nv).alias("i"), every(nq).alias("j"))
    asked = queries.select("cid", "dim", "vec", F.lit(True).alias("query"), F.col("least").cast("double").alias("least"),
                           every(nv).alias("i"), own(nq).alias("j"))
    return held.unionByName(asked).groupBy("dim", "i", "j")


def top_k(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          factor: int = 1024, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with the other rows.

    Ties go to the smaller id. is_query is a condition on the column `id`. A vector is cut into segments, each of which
    has a score list per query. Phase 1 gathers the front of every list and takes the k-th whole score found as a safe
    threshold; phase 2 sends threshold / segments as the cutoff, for a sum that reaches the threshold has a segment
    that reaches its share (whatever the signs), and collects all entries above it; phase 3 adds up their other
    segments exactly and ranks what reaches the threshold.

    Rows without an id or vector, or with null or non-finite components, take no part; of an id with several vectors
    the least (as bytes) counts. Vectors meet only vectors of their own length. Equal vectors are scored once and
    stand for their k + 1 smallest ids, so copies cost no pairs. Fewer than k others give as many rows. Scores beyond
    64 bits are held at the limit.
    """
    one = scaled(rows, id_col, vector_col, factor).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v")).select(
        "id", "v.*")
    one = stored(one, "vectors")
    alike = W.partitionBy("dim", "vec").orderBy("id")
    members = stored(one.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).withColumn(
        "cid", F.first("id").over(alike)), "members")
    vectors = members.where("n = 1").select("cid", "dim", "vec")
    asking = one.where(is_query)
    queries = stored(asking.groupBy("dim", "vec").agg(F.min("id").alias("cid")), "queries")
    n_vectors, n_queries = vectors.count(), queries.count()
    result = "qid long, cid long, score long"

    gathered = _grid(vectors, queries.withColumn("least", F.lit(None)), n_vectors, n_queries).applyInPandas(
        _lists(k + 1, segments), result)
    ranked = W.partitionBy("qid").orderBy(F.desc("score"), "cid")
    least = gathered.distinct().withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).groupBy(
        F.col("qid").alias("cid")).agg(F.min("score").alias("least"), F.count("*").alias("found"))
    # As a double, a little below the threshold: no rounding may lift it.
    least = least.select("cid", F.when(
        F.col("found") == k + 1, F.col("least") - F.abs(F.col("least").cast("double")) * 2.0 ** -50).alias("least"))
    bounded = stored(queries.join(least, "cid", "left"), "thresholds")
    entries = _grid(vectors, bounded, n_vectors, n_queries).applyInPandas(_sufficient(segments), result)
    # The classes' best rows first, then the queries of a class, less their own row.
    best = entries.join(members.select("cid", "id"), "cid").withColumn(
        "n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    best = best.select("qid", F.col("id").alias("vec_id"), "score")
    named = asking.join(queries.withColumnRenamed("cid", "qid"), ["dim", "vec"]).select(F.col("id").alias("query_id"), "qid")
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        named.join(best, "qid").where("query_id <> vec_id").withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
