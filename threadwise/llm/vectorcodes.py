"""Product codes of vectors: codebooks fitted by k-means rounds that skip what norm-of-sum bounds rule out."""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadwise.llm.shared import drop_stored, finite_vectors, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest magnitude of an integer component: sums of squares over a part of 1024 components stay below 2^63.
LARGEST = 1 << 25
#: Bytes of vectors in one record of the working tables.
BLOCK_BYTES = 1 << 20
#: Relative room for the rounding of a distance and of the bounds made from it.
SLACK = 1e-6
WRONG_LENGTH = "vectors must have one length that {} divides"


@dataclass(frozen=True)
class Codebooks:
    """history[r] has the entries (parts, entries, components) as they were before round r; the last are the final ones."""

    history: list[np.ndarray]

    @property
    def final(self) -> np.ndarray:
        return self.history[-1]

    def digest(self) -> str:
        """sha256 of all final components' decimal digits by part, entry and place, joined by commas."""
        return sha256(",".join(map(str, self.final.ravel().tolist())).encode()).hexdigest()


def distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, entries) of the rows of two integer matrices."""
    out = np.zeros((len(vectors), len(entries)), np.int64)
    for j in range(vectors.shape[1]):
        apart = vectors[:, j, None].astype(np.int64) - entries[None, :, j]
        out += apart * apart
    return out


class Displacements:
    """How far the entries of one part have come since each earlier round: the length of the whole way from there to
    here, which is at most the sum of the single steps' lengths."""

    def __init__(self, history: list[np.ndarray], part: int):
        now = history[-1][part]
        past = np.stack([h[part] for h in history])
        self.net = np.sqrt(((past - now) ** 2).sum(2).astype(float)) * (1 + SLACK)  # (stamp, entry)
        n = self.net.shape[1]
        order = np.argsort(-self.net, axis=1, kind="stable")
        most = np.take_along_axis(self.net, order, 1)
        #: The farthest way of all entries but one, by stamp and that one.
        self.others = np.repeat(most[:, :1], n, 1) if n > 1 else np.zeros_like(self.net)
        if n > 1:
            np.put_along_axis(self.others, order[:, :1], most[:, 1:2], 1)


def assign_part(vectors: np.ndarray, history: list[np.ndarray], part: int, state: dict[str, np.ndarray] | None):
    """New state of one part's vectors under the newest entries, and how many vectors were scanned against all of them.

    State: entry, the nearest one (ties: the least index); upper, a bound on its distance as of round upper_at; lower, a
    bound on the distance of every other entry as of round lower_at. A bound holds now after adding, or taking off, the
    net displacement since its own stamp. Where the upper one stays below the lower one the entry is still the nearest.
    Else the distance to the entry is measured anew, and only where that does not decide either, all are.
    """
    entries, now = history[-1][part], len(history) - 1
    n = len(vectors)
    if state is None:
        state = {"entry": np.zeros(n, np.uint8), "upper": np.full(n, np.inf, np.float32), "lower": np.zeros(n, np.float32),
                 "upper_at": np.zeros(n, np.uint8), "lower_at": np.zeros(n, np.uint8)}
    state = {k: v.copy() for k, v in state.items()}
    moved = Displacements(history, part)
    entry = state["entry"].astype(np.intp)
    lower = state["lower"] - moved.others[state["lower_at"], entry]
    open_ = np.flatnonzero(state["upper"] + moved.net[state["upper_at"], entry] >= lower)
    apart = vectors[open_].astype(np.int64) - entries[entry[open_]]
    exact = np.sqrt((apart * apart).sum(1).astype(float))
    state["upper"][open_], state["upper_at"][open_] = outward(exact), now
    scan = open_[state["upper"][open_] >= lower[open_]]
    squares = distances(vectors[scan], entries)
    best = squares.argmin(1)
    rows = np.arange(len(scan))
    state["entry"][scan] = best
    state["upper"][scan] = outward(np.sqrt(squares[rows, best].astype(float)))
    squares[rows, best] = np.iinfo(np.int64).max
    state["lower"][scan] = np.sqrt(squares.min(1, initial=np.iinfo(np.int64).max).astype(float)) * (1 - SLACK)
    state["lower_at"][scan] = now
    return state, len(scan)


def outward(distance: np.ndarray) -> np.ndarray:
    return (distance * (1 + SLACK)).astype(np.float32)


STATE = ("entry", "upper", "lower", "upper_at", "lower_at")
KINDS = {"entry": np.uint8, "upper": np.float32, "lower": np.float32, "upper_at": np.uint8, "lower_at": np.uint8}
BLOCKS = ("ids array<long>, labels array<string>, vectors binary, " + ", ".join(f"{s} binary" for s in STATE)
          + ", sums binary, scanned long")


def blocks_of(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int, parts: int) -> DataFrame:
    """The rows that take part as records of many vectors each, without a state yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            sizes = np.diff(lists.offsets.to_numpy())
            if not len(batch):
                continue
            if sizes.min() != sizes.max() or sizes[0] % parts:
                raise ValueError(WRONG_LENGTH.format(parts))
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)).reshape(len(batch), -1)
            if np.abs(values).max(initial=0) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST / scale}")
            values = values.astype(np.int32)
            step = max(1, BLOCK_BYTES // max(1, 4 * values.shape[1]))
            for at in range(0, len(batch), step):
                held = batch.slice(at, step)
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([held.column("id").to_pylist()], pa.list_(pa.int64())),
                    "labels": pa.array([held.column("label").to_pylist()], pa.list_(pa.string())),
                    "vectors": pa.array([values[at:at + step].tobytes()], pa.binary()),
                    **{s: pa.array([None], pa.binary()) for s in (*STATE, "sums")},
                    "scanned": pa.array([0], pa.int64())})

    rows = finite_vectors(vectors, vector_col).select(
        F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, BLOCKS)


def records(batch: pa.RecordBatch) -> Iterator[dict]:
    """The records one by one, so that one of them is taken apart at a time."""
    for at in range(len(batch)):
        yield batch.slice(at, 1).to_pylist()[0]


def matrix_of(record: dict, shape: tuple[int, ...]) -> np.ndarray:
    """(vectors, parts, components) of a record."""
    return np.frombuffer(record["vectors"], np.int32).reshape(len(record["ids"]), shape[0], shape[2])


def state_of(record: dict, parts: int) -> list[dict[str, np.ndarray] | None]:
    n = len(record["ids"])
    if record["entry"] is None:
        return [None] * parts
    held = {s: np.frombuffer(record[s], KINDS[s]).reshape(parts, n) for s in STATE}
    return [{s: held[s][p] for s in STATE} for p in range(parts)]


def assigned(blocks: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The records with the state under the newest entries, and the sums and counts of each entry's vectors."""
    shape = history[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in records(batch):
                vectors, out = matrix_of(record, shape), []
                sums = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64)
                for part, held in enumerate(state_of(record, shape[0])):
                    state, scanned = assign_part(vectors[:, part], history, part, held)
                    out.append(state)
                    record["scanned"] += scanned
                    for j in range(shape[2]):  # exact: below 2^53 as a block holds few vectors
                        sums[part, :, j] = np.bincount(state["entry"], vectors[:, part, j], shape[1])
                    sums[part, :, -1] = np.bincount(state["entry"], minlength=shape[1])
                record |= {s: np.stack([o[s] for o in out]).tobytes() for s in STATE} | {"sums": sums.tobytes()}
                yield pa.RecordBatch.from_pylist([record], batch.schema)

    return blocks.mapInArrow(run, BLOCKS)


def entry_sums(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums and counts (parts, entries, components + 1) over all records, as Python integers.

    Each task adds up its records; one number a place goes to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
        for batch in batches:
            for held in batch.column("sums").to_pylist():
                total += np.frombuffer(held, np.int64)
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(total)), "value": total})

    found = blocks.select("sums").mapInArrow(run, "place long, value long").groupBy("place").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total = np.zeros(shape[0] * shape[1] * (shape[2] + 1), object)
    for place, value in found.collect():  # parts * entries * (components + 1) rows
        total[place] = int(value)
    return total.reshape(shape[0], shape[1], shape[2] + 1)


def first_entries(vectors: DataFrame, id_col: str, vector_col: str, scale: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, ascending; of an id with several vectors the least, null ids last."""
    rows = finite_vectors(vectors, vector_col).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    by_id = F.col("id").asc_nulls_last()
    ids = rows.select("id").distinct().orderBy(by_id).limit(entries)
    named = rows.join(F.broadcast(ids.withColumnRenamed("id", "first")), F.col("id").eqNullSafe(F.col("first")), "left_semi")
    found = named.groupBy("id").agg(F.min("vec").alias("vec")).orderBy(by_id).collect()  # one row an entry
    if not found:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(r["vec"]) for r in found}) > 1 or len(found[0]["vec"]) % parts:
        raise ValueError(WRONG_LENGTH.format(parts))
    whole = np.floor(scale * np.array([r["vec"] for r in found], float)).astype(np.int64)
    return whole.reshape(len(found), parts, -1).transpose(1, 0, 2)


def moved_entries(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); an entry without vectors stays."""
    out = entries.copy()
    for part, entry in np.argwhere(sums[:, :, -1] > 0):
        count = sums[part, entry, -1]
        out[part, entry] = [s // count for s in sums[part, entry, :-1]]
    return out


def trained(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
            parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """(Codebooks, records): codebooks after the rounds, and the vectors with their state under the final entries.

    The state goes from round to round with the vectors, in a table of the shared folder that replaces the one before:
    two bounds and their stamps, ten bytes a part. `scanned` counts the parts that were measured against all entries.
    """
    label = F.lit(None) if label is None else label
    history = [first_entries(vectors, id_col, vector_col, scale, parts, entries)]
    held = blocks = blocks_of(vectors, id_col, vector_col, label, scale, parts)
    if not history[0].shape[1]:
        return Codebooks(history), blocks
    for step in range(rounds + 1):
        blocks = stored(assigned(held, history), "vector-blocks")
        if step:
            drop_stored(held)
        held = blocks
        if step < rounds:
            history.append(moved_entries(history[-1], entry_sums(blocks, history[-1].shape)))
    return Codebooks(history), blocks


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
          parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that takes part.

    A component x counts as floor(scale * x). Rows whose vector is null, empty or holds null or non-finite components
    take no part. All others must have one length that `parts` divides and components below LARGEST / scale, else a
    ValueError says so. Repeated rows count as often as they come; null ids take part and are last in order. Fewer ids
    than entries give as many entries; no rows give no rows. code has two hex digits a part; error sums the squared
    distances to the final entries, label_error sums it over the rows of one label, nulls together (without a label
    column: over all).
    """
    label = F.lit(None) if label_col is None else F.col(label_col)
    books, blocks = trained(vectors, id_col, vector_col, label, parts, entries, rounds, scale)
    shape, final = books.final.shape, books.final

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in records(batch):
                whole = matrix_of(record, shape)
                entry = np.frombuffer(record["entry"], np.uint8).reshape(shape[0], -1)
                error = np.zeros(len(record["ids"]), np.int64)
                for part in range(shape[0]):
                    apart = whole[:, part].astype(np.int64) - final[part][entry[part]]
                    error += (apart * apart).sum(1)
                code = np.ascontiguousarray(entry.T).tobytes().hex()
                width = 2 * shape[0]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(record["ids"], pa.int64()), "label": pa.array(record["labels"], pa.string()),
                    "code": [code[i:i + width] for i in range(0, len(code), width)], "error": error})

    rows = blocks.mapInArrow(run, "vec_id long, label string, code string, error long")
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
