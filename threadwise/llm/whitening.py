"""Whitening of embeddings by shifted Cholesky QR of the centred rows."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadwise.llm.shared import finite_vectors, stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows that a task takes into its matrices at once.
ROWS = 4096
#: Passes at most, and how near to the identity the last rows' Gram matrix must be.
PASSES, NEAR = 6, 1e-12
#: Components with less than this share of the largest eigenvalue count as not there.
RANK = 1e-12


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x) of the rows that take part: x holds floor(scale * c) + shift of each component as long."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * scale).cast("long") + shift)
    return finite_vectors(rows, vector_col).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def matrix_of(lists: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a column of lists without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


@dataclass(frozen=True)
class Centre:
    """Number of the fitted vectors and their sums by dimension, exact."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact; Python integers where 64 bits may not hold it or the sum of its squares."""
        reach = max(max(abs(self.n * m - s) for m, s in zip(side, self.sums)) for side in (self.least, self.most))
        if reach * reach * len(self.sums) >= 1 << 63:
            x = x.astype(object)
        return self.n * x - np.array(self.sums, x.dtype)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.away(x) / self.n).astype(float)


def centre_of(fit: DataFrame) -> Centre | None:
    """The centre of the fitted vectors, None without any; a ValueError if their lengths differ."""
    size = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not size[0]:
        return None
    if size[1] != size[2]:
        raise ValueError("vectors must have one length")
    value = F.col("value").cast("decimal(38,0)")
    found = fit.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(
        F.sum(value), F.min(value), F.max(value)).orderBy("at").collect()  # a row for each dimension
    return Centre(size[0], *[[int(r[i]) for r in found] for i in (1, 2, 3)])


def right_solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows times the inverse of an upper triangular matrix, column after column."""
    out = np.empty_like(a)
    for j in range(len(r)):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def summed_gram(fit: DataFrame, centre: Centre, change) -> np.ndarray:
    """Gram matrix of change(centred rows) over all rows: each task adds up its own, the sums meet by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = change(centre.centred(matrix_of(batch.column("x").slice(at, ROWS))))
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "place": np.arange(total.size), "value": np.ascontiguousarray(total).ravel()})

    found = fit.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect()
    flat = np.zeros(len(found))
    for place, value in found:  # dimensions squared
        flat[place] = value
    side = round(len(found) ** 0.5)
    gram = flat.reshape(side, side)
    return (gram + gram.T) / 2


def factors_of(fit: DataFrame, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """(R, Gram of the orthogonalised rows): the centred rows are those orthogonalised rows times R.

    Each pass takes the Gram matrix of the rows after the triangular solves of all passes before, adds a shift that
    makes its Cholesky factor exist whatever the rows' condition, and takes that factor as the next solve. The passes
    end when the Gram matrix is the identity, or no longer comes nearer to it where the rows lack rank.
    """
    d, factors, last = len(centre.sums), [], np.inf
    while True:
        gram = summed_gram(fit, centre, lambda rows: _solved(rows, factors))
        apart = np.abs(gram - np.eye(d)).max()
        if apart < NEAR or len(factors) == PASSES or factors and len(factors) > 2 and apart > 0.5 * last:
            break
        last = apart
        norm = np.linalg.norm(gram, 2)
        if not norm:
            break
        # As large as the rounding of the Gram matrix and of its factor, for a first pass; later rows are almost
        # orthogonal and need no more than their own rounding.
        shift = 11 * (centre.n * d + d * (d + 1)) * 2.0 ** -53 * norm if not factors else 16 * d * 2.0 ** -53 * norm
        factors.append(np.linalg.cholesky(gram + min(shift, 1e-6 * norm) * np.eye(d)).T)
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    return r, gram


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for factor in factors:
        rows = right_solved(rows, factor)
    return rows


def components_of(r: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the covariance, by falling eigenvalue: of the singular value
    decomposition of R, after the symmetric root of what the orthogonalised rows' Gram matrix still is."""
    values, vectors = np.linalg.eigh(gram)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    _, singular, right = np.linalg.svd(root @ r)
    return singular ** 2 / n, right.T


WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector that takes part, for each
    component up to `components` that the fitted vectors span.

    A vector's component c counts as x = floor(scale * c) + shift. Every different x vector is fitted once: n of them,
    with sums S. Components are unit eigenvectors of their covariance (divisor n), numbered from 1 by falling
    eigenvalue e. whitened is x - S/n projected on the component over sqrt(e), deviation the sum of (n*x - S)^2 (an
    OverflowError if 64 bits do not hold it), explained e over the covariance's trace, identity_error the largest
    absolute entry of the whitened fitted vectors' covariance less the identity. Rows whose vector is null, empty or holds
    null or non-finite components take no part; the others must have one length, else a ValueError says so. Repeated rows
    and null ids stay. A component without variance has no rows: none at all where all vectors are equal or none is there.
    """
    taking = whole_vectors(rows, id_col, vector_col, scale, shift)
    # One row for each different vector; copies combine before the shuffle.
    fit = stored(taking.select("x").distinct(), "fitted")
    centre = centre_of(fit)
    empty = rows.sparkSession.createDataFrame([], WHITENED)
    if centre is None:
        return empty
    r, gram = factors_of(fit, centre)
    values, vectors = components_of(r, gram, centre.n)
    total = float(values.sum())
    k = min(components, int((values > RANK * values[0]).sum())) if total else 0
    if not k:
        return empty
    turn = vectors[:, :k] / np.sqrt(values[:k])
    covariance = summed_gram(fit, centre, lambda held: held @ turn) / centre.n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = values[:k] / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                held = batch.slice(at, ROWS)
                away = centre.away(matrix_of(held.column("x")))
                deviation = pa.array((away * away).sum(1).tolist(), pa.int64())
                found = (away / centre.n).astype(float) @ turn
                each = pa.array(np.repeat(np.arange(len(held)), k))
                n = len(held) * k
                yield pa.RecordBatch.from_arrays([
                    held.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(held))),
                    pa.array(np.full(n, centre.n)), deviation.take(each), pa.array(found.ravel()),
                    pa.array(np.tile(explained, len(held))), pa.array(np.full(n, error))],
                    names=[c.split()[0] for c in WHITENED.split(", ")])

    return taking.mapInArrow(run, WHITENED)
