"""Connected components of an edge table by repeated contraction."""

from pyspark.sql import DataFrame, functions as F

from threadwise.llm.shared import stored
from threadwise.session import settings

#: Edges that one task takes through a round, 2 MB: fewer are not worth a shuffle.
TASK_EDGES = 1 << 17
#: Spark takes the product of its sides for the size of a join, and would shuffle a partition that seems so large.
ONE_PARTITION = {"spark.sql.maxSinglePartitionBytes": str(1 << 62)}


def dealt(rows: DataFrame, few: bool) -> DataFrame:
    """The rows, few ones in one partition: what is joined or grouped there needs no shuffle."""
    return rows.coalesce(1) if few else rows


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long; root is one node of the component, the same for all.

    Each round every node moves to the neighbour of least hash (itself included) and the edges between the targets go
    on to the next round. The hash is drawn anew each round, so a round removes a constant share of the nodes whatever
    their numbering. No node's neighbours meet in one row: minima combine before the shuffle. Once no more than
    `task_edges` are left, a round is one task's work and shuffles nothing: its time would go into starting tasks for
    each of the session's partitions. Loops, null ends and repeated edges are ignored; no edges give an empty table.
    """
    edges = stored(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    moves: list[tuple[bool, DataFrame]] = []
    few = False
    while n := dealt(edges, few).count():
        rank, few = len(moves), n <= task_edges  # rounds only remove edges
        both = dealt(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
        order = lambda c: F.struct(F.xxhash64(F.lit(rank), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        move = stored(least.select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["n"].alias("to")), "move")
        moves.append((few, move))
        to = dealt(move, few)
        # Merged: a broadcast table stays with the driver until its garbage is collected.
        half = dealt(dealt(edges, few).join(to.toDF("a", "x").hint("merge"), "a"), few)
        moved = half.join(to.toDF("b", "y").hint("merge"), "b").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        with settings(edges.sparkSession, ONE_PARTITION):
            edges = stored(moved, "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last round back: a node's root is its target's root, or the target where that moved no more.
    roots = moves.pop()[1].select("node", F.col("to").alias("root"))
    for few, move in reversed(moves):
        later = dealt(roots, few).toDF("to", "r").hint("merge")
        roots = stored(dealt(move, few).join(later, "to", "left").select("node", F.coalesce("r", "to").alias("root")), "roots")
    return roots
