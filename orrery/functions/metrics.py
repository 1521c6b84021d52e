"""Distances between float vectors as Spark expressions, in double precision.

cosine: max(0, 1 - cos), so a zero vector is at 1 from everything; l2: rooted; l1; dot: 1 - inner product, which may be negative.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = ("cosine", "l2", "l1", "dot")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def distance(space: str, a: Column, b: Column, unit: bool = False) -> Column:
    """The distance of two vectors; unit: both are already normalised (or zero)."""
    if space == "cosine":
        if unit:
            return F.greatest(F.lit(0.0), 1 - inner(a, b))
        scale = norm(a) * norm(b)
        return F.greatest(F.lit(0.0), 1 - F.when(scale > 0, F.try_divide(inner(a, b), scale)).otherwise(0.0))
    if space == "l2":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    if space == "l1":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    if space == "dot":
        return 1 - inner(a, b)
    raise ValueError(f"Unsupported space: '{space}'. Supported spaces: 'cosine', 'l2', 'l1', 'dot'")


def normalise(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, F.try_divide(x.cast("double"), n)).otherwise(x.cast("double")).cast("float")))[0]


def vector_error(a: Column, dim: int) -> Column:
    """Why a vector can't be stored, or null: it is missing, empty, of another width, or not finite (first bad place)."""
    bad = F.array_position(F.transform(a, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), True)
    return (
        F.when(a.isNull() | (F.size(a) == 0), F.lit("Vector cannot be empty"))
        .when(F.size(a) != dim, F.concat(F.lit(f"Vector dimension mismatch: expected {dim}, got "), F.size(a)))
        .when(bad > 0, F.concat(F.lit("Vector contains invalid value at index "), bad - 1, F.lit(" (must be finite)")))
    )


def block_distances(space: str, queries: np.ndarray, rows: np.ndarray, unit: bool = False) -> np.ndarray:
    """All distances between two blocks of vectors (float64); unit: cosine takes them as normalised."""
    if space == "l1":
        return np.stack([np.abs(rows - q).sum(1) for q in queries]) if len(queries) else np.zeros((0, len(rows)))
    if space == "l2":
        return np.sqrt(_squares(queries, rows))
    dots = queries @ rows.T
    if space == "dot":
        return 1 - dots
    if unit:
        return np.maximum(0.0, 1 - dots)
    scale = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((rows**2).sum(1))[None, :]
    return np.maximum(0.0, 1 - np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0))


def pair_distances(space: str, a: np.ndarray, b: np.ndarray, unit: bool = False) -> np.ndarray:
    """The distance of each row of a to the same row of b, summed in an order that does not depend on how many rows there are."""
    if space == "l1":
        return np.abs(a - b).sum(1)
    if space == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    dots = (a * b).sum(1)
    if space == "dot":
        return 1 - dots
    if unit:
        return np.maximum(0.0, 1 - dots)
    scale = np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1))
    return np.maximum(0.0, 1 - np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0))


def _squares(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared L2 distances by one matrix product; near pairs, where its digits cancel, are taken from the differences."""
    whole = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :]
    out = whole - 2 * (queries @ rows.T)
    q, r = np.nonzero(out <= 1e-4 * whole)
    for i in range(0, len(q), 50_000):
        at = slice(i, i + 50_000)
        out[q[at], r[at]] = ((queries[q[at]] - rows[r[at]]) ** 2).sum(1)
    return out
