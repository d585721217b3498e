"""Whitening of embeddings by shifted CholeskyQR.

Vectors are quantised to integers, and the fit list holds each distinct one once. Its centred rows A are
orthogonalised in passes: a pass adds up the Gram matrix of the rows so far, in double precision, whose
Cholesky factor the next passes divide out by a triangular solve. Where the Gram matrix is too
ill-conditioned to be factored as it is, a small shift on its diagonal makes it so, and further passes
take out what the shift left; so small eigenvalues keep the precision that a covariance matrix would
lose. The factors multiply to one triangle R with A = QR, whose singular value decomposition gives the
components, and the whitened rows are the rows of Q turned by its left side.

Rows stay in their tasks. A pass shuffles one row of numbers per dimension and task, adds them up per
dimension, and brings one d x d matrix to the driver; rows are read anew in blocks of ``BLOCK``. Counts,
sums and deviations are exact integers; rows are centred exactly before they become doubles.

Defined results: vectors that are NULL, empty, or hold a NULL or an entry that is not finite are left
out, as are those of another length than the most frequent one (ties: the shorter); zero vectors and
repeated rows stay, a NULL vec_id too; a component whose eigenvalue is zero to double precision is left
out, so a fit list of a single vector, or an empty table, gives an empty result; a deviation beyond 64
bits is NULL; entries beyond 64 bits raise; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmart.scratch import measured, written
from reelmart.shipping import ship_package

COMPONENTS = 16
BLOCK = 4_096

# The quantisation: floor(SCALE * entry) + OFFSET.
SCALE = 64
OFFSET = 1_000_000

# Passes at most; two are enough for well-conditioned rows, a shift asks for one or two more.
_PASSES = 8
_EPSILON = float(np.finfo(np.float64).eps)
# A Gram matrix this close to the identity is made one by its own factor.
_NEAR_IDENTITY = 1e-6
# Smallest over largest eigenvalue from which on no shift is needed.
_WELL_CONDITIONED = 1e-6


class Whitener(NamedTuple):
    """What whitens a row: count and sums of the fit list, factors, turn, and shares of variance."""

    n: int
    sums: np.ndarray
    factors: list[np.ndarray]
    turn: np.ndarray
    explained: np.ndarray


def quantised(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the rows that take part, x as integers."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    sound = (F.size("entries") > 0) & F.forall(
        "entries", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    found = (
        embeddings.where("embedding IS NOT NULL")
        .select("vec_id", entries.alias("entries"))
        .where(sound)
        .select("vec_id", F.transform("entries", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    )
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("x") == (lengths["d"] if lengths else 0))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly; as Python integers where 64 bits could be too few."""
    largest = max(int(np.abs(x).max(initial=0)) * n, int(np.abs(sums).max(initial=0)))
    return n * x - sums if largest < 2**61 else n * x.astype(object) - sums.astype(object)


def squared_lengths(deviation: np.ndarray) -> list[int | None]:
    """Sums of squares per row, exactly; None where they exceed 64 bits."""
    largest = int(np.abs(deviation).max(initial=0))
    if largest**2 * deviation.shape[1] < 2**63:
        return (deviation * deviation).sum(axis=1).tolist()
    exact = (deviation.astype(object) ** 2).sum(axis=1)
    return [value if value < 2**63 else None for value in exact]


def divided(rows: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangle, by substitution."""
    solved = np.asfortranarray(rows)
    if solved is rows:
        solved = rows.copy(order="F")
    for j in range(len(triangle)):
        if j:
            solved[:, j] -= solved[:, :j] @ triangle[:j, j]
        solved[:, j] /= triangle[j, j]
    return solved


def orthogonal_rows(deviation: np.ndarray, n: int, factors: list[np.ndarray]) -> np.ndarray:
    """The rows of Q that belong to rows of the list, given as exact deviations."""
    return reduce(divided, factors, deviation.astype(np.float64) / n)


def triangle_of(gram: np.ndarray, largest: float, smallest: float) -> np.ndarray:
    """The upper Cholesky factor, of a shifted matrix if that is needed."""
    identity = np.eye(len(gram))
    shift = 0.0 if smallest > _WELL_CONDITIONED * largest else 10 * len(gram) * _EPSILON * largest
    while True:
        try:
            return np.linalg.cholesky(gram + shift * identity).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, _EPSILON * largest)


def _blocks(batches: Iterable[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their vectors as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            lists = part.column(part.schema.get_field_index(column))
            yield part, lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _added_up(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Element-wise sums of ``(place, numbers)`` per place; one row per place reaches the driver."""
    dtype = np.int64 if kind == "bigint" else np.float64

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, numbers in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = numbers.values.to_numpy(zero_copy_only=False)
                totals[place] = totals[place] + row if place in totals else row.astype(dtype)
        yield _placed(list(totals), list(totals.values()), dtype)

    summed = parts.repartition("place").mapInArrow(add, f"place int, numbers array<{kind}>")
    return {r["place"]: np.array(r["numbers"], dtype) for r in summed.collect()}


def _placed(places: list[int], rows: list[np.ndarray], dtype: type) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = pa.array(np.concatenate([np.empty(0, dtype), *rows]))
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["place", "numbers"]
    )


def _sums(fit: DataFrame) -> np.ndarray:
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.sum(axis=0) for _, x in _blocks(batches)]
        if parts:
            yield _placed([0], [np.sum(parts, axis=0)], np.int64)

    return _added_up(fit.mapInArrow(add, "place int, numbers array<bigint>"), "bigint")[0]


def _gram(fit: DataFrame, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix of what ``rows`` makes of the vectors of the fit list."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            part = rows(x)
            total = part.T @ part if total is None else total + part.T @ part
        if total is not None:
            yield _placed(list(range(len(total))), list(total), np.float64)

    summed = _added_up(fit.mapInArrow(add, "place int, numbers array<double>"), "double")
    gram = np.stack([summed[i] for i in range(len(summed))])
    return (gram + gram.T) / 2


def fit_whitener(fit: DataFrame, n: int, components: int = COMPONENTS) -> Whitener:
    """Components of the ``n`` rows of ``fit`` (column x), by passes of shifted CholeskyQR."""
    sums = _sums(fit)
    d = len(sums)
    factors: list[np.ndarray] = []
    for step in range(_PASSES):
        # Bound here, as a later pass must not change what this one's tasks see.
        done = list(factors)
        gram = _gram(fit, lambda x: orthogonal_rows(deviations(x, n, sums), n, done))
        values = np.linalg.eigvalsh(gram)
        if values[-1] <= 0:
            break
        factors.append(triangle_of(gram, values[-1], values[0]))
        # Directions that stay below the shift after two passes hold nothing but rounding.
        empty = values <= 10 * d * _EPSILON * values[-1] if step >= 2 else np.zeros(d, bool)
        if step and np.all((np.abs(values - 1) <= _NEAR_IDENTITY) | empty):
            break
    if not factors:
        return Whitener(n, sums, [], np.empty((d, 0)), np.empty(0))
    left, singular, _ = np.linalg.svd(reduce(lambda r, factor: factor @ r, factors))
    kept = min(components, int((singular > 4 * d * _EPSILON * singular[0]).sum()))
    variance = singular**2
    return Whitener(n, sums, factors, left[:, :kept] * np.sqrt(n), variance[:kept] / variance.sum())


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    if not len(w.explained):
        return 0.0
    gram = _gram(fit, lambda x: orthogonal_rows(deviations(x, w.n, w.sums), w.n, w.factors) @ w.turn)
    return float(np.abs(gram / w.n - np.eye(len(gram))).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per remaining row: vec_id, n, deviation, whitened, explained (arrays by component), identity_error."""
    ship_package(embeddings.sparkSession)
    rows = written(quantised(embeddings))
    fit, found = measured(rows.select("x").distinct(), n=F.count("*"))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, deviation bigint, whitened array<double>"
    if not found["n"]:
        w, error = Whitener(0, np.empty(0), [], np.empty((0, 0)), np.empty(0)), 0.0
    else:
        w = fit_whitener(fit, found["n"], components)
        error = identity_error(fit, w)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            deviation = deviations(x, w.n, w.sums)
            turned = orthogonal_rows(deviation, w.n, w.factors) @ w.turn
            ends = np.arange(0, turned.size + 1, max(1, turned.shape[1]), dtype=np.int32)
            if not turned.size:
                ends = np.zeros(part.num_rows + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(squared_lengths(deviation), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(turned).ravel())),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    shares = F.array(*(F.lit(float(share)) for share in w.explained)).cast("array<double>")
    return rows.mapInArrow(apply, schema).select(
        "vec_id",
        F.lit(w.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whitened_components(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component, numbered from 1."""
    return whiten(embeddings, components).select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("place")).alias("explained"),
        "identity_error",
    )
