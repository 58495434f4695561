"""SimHash near-duplicates: fingerprints linked through an inverted index of their bytes by position."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from threadwise.llm.components import connected_components
from threadwise.llm.shared import JOINED_ID, in_small_batches, split_id, stored, text_key, with_row_key

SEED = 42
#: Members of one index entry that a task compares at once; longer entries are split by further bits.
ENTRY_ROWS = 4096
#: Bits that a split entry leaves free at the last step: it has at most 2 ** 13 different members.
LAST_BITS = 13


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats counted: a bit is 1 if set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends.tolist()[shingle - 1:])]
    bits, step = np.zeros(64, np.int64), 1 << 16
    values = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), step):
        bits += np.unpackbits(values[at:at + step], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(values), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, thash, fp) of every row: thash is the key of its text, fp the fingerprint as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = [signed(fingerprint(t, shingle)) for t in rows["text"]]
            yield rows[["none", "key", "thash"]].assign(fp=np.array(fps, np.int64))

    narrow = in_small_batches(docs).select(
        *split_id(F.col(id_col)), text_key(F.col(text_col)).alias("thash"), F.col(text_col).alias("text"))
    found = narrow.mapInPandas(run, "none boolean, key long, thash long, fp long")
    return found.select(F.expr(JOINED_ID).alias("id"), "thash", "fp")


def byte_sets(chosen: int, differing: int = 3, positions: int = 8) -> list[tuple[int, ...]]:
    """Sets of byte positions of which one stays untouched whichever bytes differ, picked greedily."""
    open_ = set(combinations(range(positions), positions - differing))
    sets = []
    while open_:
        best = max(combinations(range(positions), chosen), key=lambda s: sum(set(s) <= set(o) for o in open_))
        sets.append(best)
        open_ = {o for o in open_ if not set(best) <= set(o)}
    return sets


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _pieces(free: int, parts: int) -> list[int]:
    """The free bits cut into parts masks of about equal size."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def _entry(mask: int, of: str = "fp"):
    """Index entry of a mask: its number and the masked bits, as one key."""
    return F.struct(F.lit(signed(mask)).alias("mask"), F.col(of).bitwiseAND(F.lit(signed(mask))).alias("bits"))


def _link_entries(max_bits: int):
    """Links that join the linked members of each entry: all are compared, a spanning forest is returned."""
    def neighbours(values: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
        # Count filter: with at most max_bits bits apart at least 8 - max_bits bytes agree; then the bits are counted.
        apart = values[rest] ^ values[at]
        agree = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = agree >= 8 - max_bits
        near[near] = np.bitwise_count(apart[near]) <= max_bits
        return near

    def forest(values: np.ndarray) -> Iterator[tuple[int, int]]:
        rest, queue = np.arange(1, len(values)), [0]
        while len(rest):
            if not queue:
                queue, rest = [rest[0]], rest[1:]
                continue
            at = queue.pop()
            near = neighbours(values, at, rest)
            for other in rest[near]:
                yield at, other
                queue.append(other)
            rest = rest[~near]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            mask, bits, fp = (rows[c].to_numpy(np.int64) for c in ("mask", "bits", "fp"))
            new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(bits) != 0)) + 1
            last = new[-1] if len(new) else 0
            held = rows.iloc[last:]
            yield links(fp[:last], new)
        if held is not None and len(held):
            yield links(held["fp"].to_numpy(np.int64), np.array([len(held)]))

    def links(fp: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        sizes, values = ends - starts, fp.view(np.uint64)
        pairs = starts[sizes == 2]
        near = neighbours_of_pairs(values, pairs)
        a, b = [fp[pairs[near]]], [fp[pairs[near] + 1]]
        for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
            found = np.array(list(forest(values[s:e])), np.int64).reshape(-1, 2) + s
            a.append(fp[found[:, 0]])
            b.append(fp[found[:, 1]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    def neighbours_of_pairs(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = values[at] ^ values[at + 1] if len(at) else values[:0]
        agree = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        return (agree >= 8 - max_bits) & (np.bitwise_count(apart) <= max_bits)

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 3, entry_rows: int = ENTRY_ROWS) -> DataFrame:
    """(a, b) links between the different fingerprints of column fp, enough to join all that are linked.

    Two fingerprints at most max_bits bits apart agree in at least 8 - max_bits of 8 bytes by position. The inverted
    index has an entry for each set of agreeing bytes out of a family that meets every such case; in an entry the
    agreeing bytes of a pair are counted, pairs with fewer than guaranteed are left out, the others verified bit by
    bit. Only different fingerprints are indexed, so copies cost nothing. An entry of more than entry_rows members is
    split by one more agreeing byte, then twice by a quarter of its free bits (one quarter agrees, as at most three
    bits differ), which leaves at most 2 ** 13 possible members: no task ever holds a larger group, none is dropped.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index is laid out for at most 3 differing bits")
    every = (1 << 64) - 1
    level, found, members = [_mask(s) for s in byte_sets(4)], [], fps.select("fp").distinct()
    finer = [lambda mask: [mask | _mask((p,)) for p in range(8) if not mask >> 8 * p & 0xFF]]
    finer += [lambda mask: [mask | piece for piece in _pieces(every & ~mask, 4)]] * 2
    rows = members.select("fp", F.explode(F.array(*[_entry(m) for m in level])).alias("e")).select("fp", "e.*")
    for step in range(len(finer) + 1):
        rows = stored(rows, "entries")
        sizes = stored(rows.groupBy("mask", "bits").count().where("count > 1"), "sizes")
        fits = sizes if step == len(finer) else sizes.where(F.col("count") <= entry_rows)
        found.append(
            rows.join(fits.select("mask", "bits"), ["mask", "bits"]).repartition("mask", "bits")
            .sortWithinPartitions("mask", "bits", "fp").mapInPandas(_link_entries(max_bits), "a long, b long"))
        large = sizes.where(F.col("count") > entry_rows).select("mask", "bits")
        if step == len(finer) or large.isEmpty():
            break
        held = {m for m, in large.select("mask").distinct().collect()}  # at most the masks of this level
        nexts = {signed(m): finer[step](m) for m in level if signed(m) in held}
        level = sorted({m for ms in nexts.values() for m in ms})
        table = F.create_map(*[x for k, ms in nexts.items() for x in (
            F.lit(k), F.array(*[F.lit(signed(m)) for m in ms]))])
        rows = (
            rows.join(large, ["mask", "bits"]).select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct()
            .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 3, entry_rows: int = ENTRY_ROWS) -> DataFrame:
    """(doc_id, thash, fp, component_id, root) per row: documents joined by links of at most max_bits differing bits.

    component_id is the smallest id that can be reached, the row's own included. Null and empty texts have the
    fingerprint zero, which links like any other. A null id takes part and gets its component; it is never a
    component's id unless no other is there. Repeated rows stay; an empty table gives an empty table.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(fingerprint_links(rows, max_bits, entry_rows))
    classes = stored(
        classes.join(roots.toDF("fp", "root"), "fp", "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "root").join(least, "root")
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), "thash", "fp", "component_id", "root")


def near_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The documents with one of each group kept: that of the smallest doc_id, of equal ids that of the smallest text
    key. Repeated equal rows (id and text) count as one document. A null id is kept only where its group has no other.
    Columns and texts stay as they are."""
    groups, own = with_row_key(
        simhash_groups(docs, "doc_id", "text", shingle, max_bits), F.col("doc_id"), F.col("thash"))
    rows, key = with_row_key(docs, F.col("doc_id"), text_key(F.col("text")))
    kept = groups.groupBy("root").agg(F.min(F.struct(*[F.col(o).alias(k) for o, k in zip(own, key)])).alias("kept"))
    return rows.dropDuplicates(key).join(kept.select("kept.*"), key, "left_semi").select(*docs.columns)
