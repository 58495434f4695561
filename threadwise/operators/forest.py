"""A random forest of two classes over binned columns, grown in groups of rows that Spark deals out.

Nodes of many rows are split level by level from counts that all tasks add up; a node whose rows fit one group's matrix
is grown to its leaves there. Each level costs its rows only, so the work grows with the rows times the depth.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, e, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadwise.session import checkpointed

#: Bytes of the matrix of a group, one per row and column.
GROUP_BYTES = 1 << 26
#: Trees that one group grows while their roots fit it: their rows are sent once.
TREES = 4
#: Rows of a block, and bins of a column.
BLOCK, BINS = 2048, 256
#: Weights in (0, 1] are binned by their logarithm: 254 bins over eight octaves below one, zero has its own.
OCTAVES, FINE = 8, 254

BLOCK_SCHEMA = "n int, sizes binary, at binary, value binary, y binary, seeds binary"
GROUP_SCHEMA = f"part int, {BLOCK_SCHEMA}, draws binary"
COUNT_SCHEMA = "tree int, node long, keys binary, counts binary, totals binary"
SPLIT_SCHEMA = "tree int, node long, feature int, bin int, gain double, left array<long>, right array<long>"
SUBTREE_SCHEMA = "tree int, node long, feature binary, bin binary, child binary, p binary, importance binary"
ABOUT_SCHEMA = "terms int, edges array<array<double>>, parts long"


@dataclass(frozen=True)
class Binning:
    """Columns as bytes: the first `terms` hold weights from 0 to 1, the others have edges of their own."""

    terms: int
    edges: list[list[float]]

    @property
    def columns(self) -> int:
        return self.terms + len(self.edges)

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, np.uint8)
        at = np.nonzero(values[:, :self.terms] > 0)
        place = np.floor((np.log2(values[at]) + OCTAVES) * (FINE / OCTAVES))
        out[at] = 1 + np.clip(place, 0, FINE - 1).astype(np.uint8)
        for j, edges in enumerate(self.edges, self.terms):
            out[:, j] = np.searchsorted(edges, values[:, j])
        return out


def column_edges(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Quantiles of columns that are not weights, at most one for each bin."""
    shares = [i / (BINS - 1) for i in range(BINS)]
    return [sorted(set(q))[:BINS - 1] for q in rows.approxQuantile(columns, shares, 1 / BINS / 4)] if columns else []


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: How often a row is drawn: Poisson with mean one.
POISSON = np.cumsum([1 / e / factorial(k) for k in range(16)])


def draws(seeds: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each tree draws each row; it follows from the row's seed alone."""
    own = _mixed(seeds.astype(np.uint64) + np.uint64(seed))
    numbers = _mixed(own[:, None] ^ _mixed(np.arange(trees, dtype=np.uint64))[None]) >> np.uint64(11)
    return np.searchsorted(POISSON, numbers * 2.0 ** -53, "right").astype(np.uint8)


def chosen_columns(tree: np.ndarray, nodes: np.ndarray, columns: int, count: int, seed: int) -> np.ndarray:
    """The columns that each node may split by; they follow from its place in the tree."""
    own = _mixed(_mixed(tree.astype(np.uint64) + np.uint64(seed)) ^ nodes.astype(np.uint64))
    out = np.empty((len(nodes), count), np.int64)
    places = _mixed(np.arange(columns, dtype=np.uint64))[None]
    for i in range(0, len(nodes), 512):
        ranks = _mixed(own[i:i + 512, None] ^ places)
        out[i:i + 512] = np.argpartition(ranks, count - 1, 1)[:, :count] if count < columns else np.arange(columns)
    return np.sort(out, 1)


def drawn_stats(y: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Draws of rows as (first class, second class, distinct rows)."""
    return np.stack([np.where(y == 0, drawn, 0), np.where(y == 1, drawn, 0), drawn > 0], 1).astype(np.int64)


def gini(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity times the weight of rows, from the counts of both classes."""
    a, b = counts[..., 0] * weights[0], counts[..., 1] * weights[1]
    return 2 * a * b / np.maximum(a + b, 1e-300)


def counted(x: np.ndarray, rows: np.ndarray, node: np.ndarray, columns: np.ndarray,
            stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of stats by (node, place among its columns, bin), without the bin zero."""
    values = x[rows[:, None], columns[node]]
    row, slot = np.nonzero(values)
    keys = (node[row] * columns.shape[1] + slot) * BINS + values[row, slot]
    order = np.argsort(keys, kind="stable")
    return summed(keys[order], stats[rows[row[order]]])


def summed(keys: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of stats by sorted keys."""
    if not len(keys):
        return keys, stats
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(stats, first)


@dataclass
class Splits:
    """Best split of the nodes that have one: place of the node, of the column among its own, highest bin on the left."""

    node: np.ndarray
    slot: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    left: np.ndarray


def best_splits(keys: np.ndarray, stats: np.ndarray, totals: np.ndarray, slots: int, weights: np.ndarray,
                least: int) -> Splits:
    """Of all cuts between two bins, the one of most gain; both sides keep at least `least` drawn rows. Stats and
    totals are drawn rows of either class and distinct rows, in whole numbers: equal counts give equal gains."""
    segment = keys // BINS
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(keys) else np.zeros(0, np.int64)
    zero = totals[segment[first] // slots] - (np.add.reduceat(stats, first) if len(keys) else stats)
    keys, stats = np.insert(keys, first, segment[first] * BINS), np.insert(stats, first, zero, 0)
    node = keys // BINS // slots
    cum = np.cumsum(stats, 0)
    first = first + np.arange(len(first))
    lengths = np.diff(np.r_[first, len(keys)])
    left = cum - np.repeat(cum[first] - stats[first], lengths, 0)
    right = totals[node] - left
    whole = gini(totals, weights)
    gain = whole[node] - gini(left, weights) - gini(right, weights)
    bad = (left[:, :2].sum(1) < least) | (right[:, :2].sum(1) < least) | (gain <= 1e-12 * (totals[:, :2] @ weights)[node])
    gain = np.where(bad, -1.0, gain)
    if not len(keys):
        return Splits(node, node, node, gain, left)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    most = np.maximum.reduceat(gain, starts)
    hit = np.flatnonzero((gain == np.repeat(most, np.diff(np.r_[starts, len(node)]))) & (gain > 0))
    hit = hit[np.r_[True, node[hit][1:] != node[hit][:-1]]] if len(hit) else hit
    return Splits(node[hit], keys[hit] // BINS % slots, keys[hit] % BINS, gain[hit], left[hit])


@dataclass(frozen=True)
class Growth:
    """How the trees grow."""

    columns: int
    trees: int
    depth: int
    least: int
    seed: int
    weights: tuple[float, float]

    @property
    def count(self) -> int:
        return min(self.columns, ceil(sqrt(self.columns)))

    def splits(self, totals: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which nodes may be split: of both classes, with rows for two sides, above the last level."""
        deep = node >= 1 << self.depth
        return (totals[:, :2] > 0).all(1) & (totals[:, :2].sum(1) >= 2 * self.least) & ~deep

    def share(self, totals: np.ndarray) -> np.ndarray:
        """Share of the second class."""
        w = totals[:, :2] * np.array(self.weights)
        return w[:, 1] / np.maximum(w.sum(1), 1e-300)

    def grow(self, tree: int, start: int, x: np.ndarray, y: np.ndarray, drawn: np.ndarray) -> dict:
        """The tree below a node from its rows, all nodes of a level at once. Node i of the next level stands behind
        its elder; the right child stands behind the left one."""
        rows = np.flatnonzero(drawn)
        stats = drawn_stats(y, drawn)
        path, node = np.array([start], np.int64), np.zeros(len(rows), np.int64)
        totals = stats[rows].sum(0, keepdims=True)
        weights, importance, size = np.array(self.weights), np.zeros(self.columns), 1
        out = {"feature": [], "bin": [], "child": [], "p": []}
        while len(path):
            feature, cut, child = np.full(len(path), -1, np.int16), np.zeros(len(path), np.uint8), np.zeros(len(path), np.int32)
            open_ = np.flatnonzero(self.splits(totals, path))
            place = np.full(len(path), -1)
            place[open_] = np.arange(len(open_))
            stays = place[node] >= 0
            rows, node = rows[stays], place[node[stays]]
            columns = chosen_columns(np.full(len(open_), tree), path[open_], self.columns, self.count, self.seed)
            found = best_splits(*counted(x, rows, node, columns, stats), totals[open_], self.count, weights, self.least)
            of, by = open_[found.node], columns[found.node, found.slot]
            feature[of], cut[of], child[of] = by, found.bin, size + 2 * np.arange(len(of))
            np.add.at(importance, by, found.gain)
            for key, part in zip(out, (feature, cut, child, self.share(totals).astype(np.float32))):
                out[key].append(part)
            size += 2 * len(of)
            place = np.full(len(open_), -1)
            place[found.node] = np.arange(len(of))
            stays = place[node] >= 0
            rows, node = rows[stays], place[node[stays]]
            node = 2 * node + (x[rows, by[node]] > found.bin[node])
            both = np.stack([found.left, totals[of] - found.left], 1).reshape(-1, 3)
            path, totals = np.stack([2 * path[of], 2 * path[of] + 1], 1).reshape(-1), both
        return {key: np.concatenate(parts).tobytes() for key, parts in out.items()} | {"importance": importance.tobytes()}


def _blocks(rows: DataFrame, binning: Binning) -> DataFrame:
    """Blocks of rows with the bins that are not zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            x = binning.of(batch.column("x").flatten().to_numpy().reshape(len(batch), -1))
            row, at = np.nonzero(x)
            parts = [np.bincount(row, minlength=len(x)).astype("<u2"), at.astype("<u2"), x[row, at],
                     batch.column("y").to_numpy().astype(np.uint8), batch.column("seed").to_numpy()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int32())} | {
                c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(("sizes", "at", "value", "y", "seeds"), parts)})

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _matrix(block: dict, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, classes, seeds) of a block."""
    sizes = np.frombuffer(block["sizes"], "<u2")
    x = np.zeros((len(sizes), columns), np.uint8)
    x[np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(block["at"], "<u2")] = np.frombuffer(block["value"], np.uint8)
    return x, np.frombuffer(block["y"], np.uint8), np.frombuffer(block["seeds"], np.int64)


class Top:
    """The split nodes of many rows of all trees; which rows stand in a node follows from walking down from the root."""

    def __init__(self):
        self.split: dict[tuple[int, int], tuple[int, int]] = {}

    def walk(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The lowest node reached by each row."""
        node, rows, at = np.ones(len(x), np.int64), np.arange(len(x)), 1
        pending = [(at, rows)] if (tree, at) in self.split else []
        while pending:
            at, rows = pending.pop()
            feature, cut = self.split[tree, at]
            right = x[rows, feature] > cut
            for child, some in ((2 * at, rows[~right]), (2 * at + 1, rows[right])):
                node[some] = child
                if (tree, child) in self.split:
                    pending.append((child, some))
        return node


def _counts(blocks: DataFrame, top: Top, wanted: list[tuple[int, int]], growth: Growth) -> DataFrame:
    """Best split of each wanted node, from counts that each task adds up over its blocks."""
    by_tree: dict[int, list[int]] = {}
    for tree, node in sorted(wanted):
        by_tree.setdefault(tree, []).append(node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        chosen = {t: chosen_columns(np.full(len(n), t), np.array(n), growth.columns, growth.count, growth.seed)
                  for t, n in by_tree.items()}
        for block in (b for batch in batches for b in batch.to_pylist()):
            x, y, seeds = _matrix(block, growth.columns)
            drawn = draws(seeds, growth.trees, growth.seed)
            for tree, nodes in by_tree.items():
                node = top.walk(tree, x)
                place = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                rows = np.flatnonzero((np.array(nodes)[place] == node) & (drawn[:, tree] > 0))
                stats = drawn_stats(y, drawn[:, tree])
                totals = np.zeros((len(nodes), 3), np.int64)
                np.add.at(totals, place[rows], stats[rows])
                keys, values = counted(x, rows, place[rows], chosen[tree], stats)
                if tree in sums:
                    before = sums[tree]
                    keys, values = np.r_[before[0], keys], np.concatenate([before[1], values])
                    order = np.argsort(keys, kind="stable")
                    keys, values = summed(keys[order], values[order])
                    totals = totals + before[2]
                sums[tree] = [keys, values, totals]
        for tree, (keys, values, totals) in sums.items():
            of, inside = np.divmod(keys, growth.count * BINS)
            ends = np.searchsorted(of, np.arange(len(totals) + 1))
            parts = [slice(a, b) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree] * len(parts), pa.int32()), "node": pa.array(by_tree[tree], pa.int64()),
                "keys": pa.array([inside[p].tobytes() for p in parts], pa.binary()),
                "counts": pa.array([values[p].tobytes() for p in parts], pa.binary()),
                "totals": pa.array([t.tobytes() for t in totals], pa.binary())})

    def split(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.int64) for k in parts["keys"]])
        values = np.concatenate([np.frombuffer(c, np.int64).reshape(-1, 3) for c in parts["counts"]])
        totals = sum(np.frombuffer(t, np.int64) for t in parts["totals"])[None]
        order = np.argsort(keys, kind="stable")
        found = best_splits(*summed(keys[order], values[order]), totals, growth.count, np.array(growth.weights), growth.least)
        if not growth.splits(totals, np.array([key[1]]))[0] or not len(found.node):
            return pd.DataFrame([[*key, -1, 0, 0.0, totals[0].tolist(), [0, 0, 0]]], columns=names)
        columns = chosen_columns(np.array([key[0]]), np.array([key[1]]), growth.columns, growth.count, growth.seed)
        left = found.left[0]
        return pd.DataFrame([[*key, int(columns[0, found.slot[0]]), int(found.bin[0]), float(found.gain[0]), left.tolist(),
                              (totals[0] - left).tolist()]], columns=names)

    names = [c.split()[0] for c in SPLIT_SCHEMA.split(", ")]
    return blocks.mapInArrow(run, COUNT_SCHEMA).groupBy("tree", "node").applyInPandas(split, SPLIT_SCHEMA)


def _subtrees(blocks: DataFrame, top: Top, groups: list[list[tuple[int, int]]], growth: Growth) -> DataFrame:
    """The rows of each group of nodes meet in one place, where they are grown."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in batch.to_pylist()):
            x, _, seeds = _matrix(block, growth.columns)
            drawn = draws(seeds, growth.trees, growth.seed)
            walked = {t: top.walk(t, x) for t in {t for group in groups for t, _ in group}}
            sizes = np.frombuffer(block["sizes"], "<u2")
            for part, group in enumerate(groups):
                own = np.stack([np.where(walked[t] == n, drawn[:, t], 0) for t, n in group], 1).astype(np.uint8)
                rows = own.any(1)
                if not rows.any():
                    continue
                within = np.repeat(rows, sizes)
                sent = [sizes[rows], np.frombuffer(block["at"], "<u2")[within], np.frombuffer(block["value"], np.uint8)[within],
                        np.frombuffer(block["y"], np.uint8)[rows], seeds[rows], own[rows]]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "n": pa.array([int(rows.sum())], pa.int32())} | {
                    c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(("sizes", "at", "value", "y", "seeds", "draws"), sent)})

    def grow(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        group, at = groups[key[0]], 0
        x, y = np.zeros((parts["n"].sum(), growth.columns), np.uint8), np.zeros(parts["n"].sum(), np.uint8)
        for block in parts.to_dict("records"):
            some = slice(at, at := at + block["n"])
            x[some], y[some], _ = _matrix(block, growth.columns)
        own = np.concatenate([np.frombuffer(d, np.uint8).reshape(-1, len(group)) for d in parts["draws"]])
        return pd.DataFrame([{"tree": tree, "node": node} | growth.grow(tree, node, x, y, own[:, i])
                             for i, (tree, node) in enumerate(group) if own[:, i].any()], columns=names)

    names = [c.split()[0] for c in SUBTREE_SCHEMA.split(", ")]
    dealt = blocks.mapInArrow(deal, GROUP_SCHEMA).repartition(len(groups), "part")
    return dealt.groupBy("part").applyInPandas(grow, SUBTREE_SCHEMA)


def train_forest(rows: DataFrame, binning: Binning, weights: tuple[float, float], trees: int, depth: int, least: int,
                 seed: int, group_bytes: int = GROUP_BYTES) -> "Forest":
    """A forest from rows (x vector, y 0 or 1, seed long), with a weight for either class.

    Each tree draws rows with replacement, by a row's own seed; each node looks at the square root of the columns, by its
    own place: the trees do not depend on how the rows are dealt out.
    """
    spark, growth = rows.sparkSession, Growth(binning.columns, trees, depth, least, seed, weights)
    blocks = _blocks(rows.select(vector_to_array("x").alias("x"), "y", "seed"), binning).persist(StorageLevel.MEMORY_AND_DISK)
    most = max(1, group_bytes // binning.columns)
    try:
        fits = (blocks.agg(F.sum("n").alias("n")).first()["n"] or 0) <= most
        roots = [(tree, 1) for tree in range(trees)]
        groups = [roots[i:i + TREES] for i in range(0, trees, TREES)] if fits else []
        top, large, upper = Top(), [] if fits else roots, []
        spread = blocks.coalesce(spark.sparkContext.defaultParallelism)
        while large:
            found, large = _counts(spread, top, large, growth).collect(), []
            for r in found:
                tree, node, feature, left = r["tree"], r["node"], r["feature"], np.array([r["left"]])
                importance = np.zeros(growth.columns)
                importance[feature] = r["gain"]
                share = growth.share(left) if feature < 0 else np.zeros(1)
                upper.append((tree, node, *[bytearray(a.tobytes()) for a in (
                    np.array([feature], np.int16), np.array([r["bin"]], np.uint8), np.array([-1], np.int32),
                    share.astype(np.float32), importance)]))
                if feature >= 0:
                    top.split[tree, node] = feature, r["bin"]
                    for child, totals in ((2 * node, r["left"]), (2 * node + 1, r["right"])):
                        large.append((tree, child)) if totals[2] > most else groups.append([(tree, child)])
        grown = spark.createDataFrame(upper, SUBTREE_SCHEMA)
        grown = grown.unionByName(_subtrees(blocks, top, groups, growth)) if groups else grown
        return Forest(binning, checkpointed(grown))
    finally:
        blocks.unpersist()


@dataclass(frozen=True)
class Forest:
    """The parts of the trees as rows; scoring takes 15 bytes a node to each task."""

    binning: Binning
    parts: DataFrame

    @cached_property
    def rows(self) -> list:
        return self.parts.drop("importance").collect()

    @cached_property
    def importances(self) -> np.ndarray:
        """Gain by column, each tree's adding up to one before all are."""
        def add(parts: pd.DataFrame) -> pd.DataFrame:
            whole = sum(np.frombuffer(p, np.float64) for p in parts["importance"])
            return pd.DataFrame({"importance": [whole.tobytes()]})

        found = self.parts.groupBy("tree").applyInPandas(add, "importance binary").collect()
        own = [np.frombuffer(r["importance"], np.float64) for r in found]
        total = sum((o / (o.sum() or 1) for o in own), np.zeros(self.binning.columns))
        return total / (total.sum() or 1)

    def trees(self) -> list[tuple[np.ndarray, ...]]:
        """(column, bin, left, right, share) of each tree; a column of -1 marks a leaf."""
        own: dict[int, list] = {}
        for r in sorted(self.rows, key=lambda r: (r["tree"], r["node"])):
            own.setdefault(r["tree"], []).append(r)
        out = []
        for parts in own.values():
            feature = [np.frombuffer(r["feature"], np.int16) for r in parts]
            starts = np.cumsum([0, *map(len, feature)])
            place = {r["node"]: start for r, start in zip(parts, starts)}
            left, right = [], []
            for r, start in zip(parts, starts):
                child = np.frombuffer(r["child"], np.int32)
                above = child[0] < 0 and 2 * r["node"] in place
                left.append(np.array([place[2 * r["node"]]], np.int32) if above else child + np.int32(start))
                right.append(np.array([place[2 * r["node"] + 1]], np.int32) if above else child + np.int32(start + 1))
            whole = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in parts])
            out.append((np.concatenate(feature), whole("bin", np.uint8), np.concatenate(left), np.concatenate(right),
                        whole("p", np.float32)))
        return out

    def probability(self, vector: Column) -> Column:
        """Mean share of the second class in the leaves that a row falls into."""
        binning, sent = self.binning, self.parts.sparkSession.sparkContext.broadcast(self.trees())

        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            out = [pa.array(_score(sent.value, binning.of(p.flatten().to_numpy().reshape(len(p), -1))))
                   for p in (values.slice(i, BLOCK) for i in range(0, len(values), BLOCK))]
            return pa.concat_arrays(out) if out else pa.array([], pa.float64())

        return score(vector_to_array(vector))

    def save(self, path: str) -> None:
        spark = self.parts.sparkSession
        self.parts.write.parquet(f"{path}/parts")
        about = [(self.binning.terms, self.binning.edges, len(self.rows))]
        spark.createDataFrame(about, ABOUT_SCHEMA).coalesce(1).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        """The forest as it was saved; one that lacks a part raises an error."""
        about = spark.read.schema(ABOUT_SCHEMA).parquet(f"{path}/about").first()
        forest = cls(Binning(about["terms"], about["edges"]), spark.read.schema(SUBTREE_SCHEMA).parquet(f"{path}/parts"))
        if len(forest.rows) != about["parts"]:
            raise ValueError(f"{path} has {len(forest.rows)} of {about['parts']} parts")
        return forest


def _score(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, cut, left, right, p in trees:
        node, going = np.zeros(len(x), np.int32), np.arange(len(x))
        while len(going):
            at = node[going]
            column = feature[at]
            inner = column >= 0
            going, at, column = going[inner], at[inner], column[inner]
            node[going] = np.where(x[going, column] > cut[at], right[at], left[at])
        total += p[node]
    return total / max(1, len(trees))
