"""Product quantisation: train a codebook, encode, reconstruct, and score codes against queries or codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import block_distances

SEED = 42


def kmeans(x: np.ndarray, k: int, seed: int = SEED, tolerance: float = 1e-6) -> np.ndarray:
    """k-means++ and Lloyd steps from a fixed seed; an empty cluster takes a point drawn at random."""
    rng = np.random.default_rng(seed)
    centres = np.empty((k, x.shape[1]))
    centres[0] = x[rng.integers(len(x))]
    nearest = ((x - centres[0]) ** 2).sum(1)
    for i in range(1, k):
        total = nearest.sum()
        at = rng.integers(len(x)) if total <= 0 else min(len(x) - 1, int(np.searchsorted(np.cumsum(nearest), rng.random() * total)))
        centres[i] = x[at]
        nearest = np.minimum(nearest, ((x - centres[i]) ** 2).sum(1))
    before = np.inf
    for _ in range(100 if len(x) <= 50_000 else 50):
        to, inertia = assign(x, centres)
        if abs(before - inertia) <= tolerance:
            break
        before = inertia
        counts = np.bincount(to, minlength=k)
        sums = np.stack([np.bincount(to, x[:, j], k) for j in range(x.shape[1])], 1)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            centres[~full] = x[rng.integers(len(x), size=int((~full).sum()))]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """The nearest centre of each row (ties: the lowest) and the mean squared distance."""
    to, total = np.empty(len(x), np.int64), 0.0
    norms = (centres**2).sum(1)
    for i in range(0, len(x), 8192):
        part = x[i : i + 8192]
        d = norms - 2 * part @ centres.T
        to[i : i + 8192] = d.argmin(1)
        total += float(np.maximum(0, d.min(1) + (part**2).sum(1)).sum())
    return to, total / max(1, len(x))


def train(sample: DataFrame, subvectors: int, bits: int, order: str = "seq") -> np.ndarray:
    """A codebook (subvectors, centroids, width) from a bounded sample of vectors: one task for each subvector.

    Rows are put in the order of a column first, so that the fixed seed gives the same codebook at any partitioning.
    """
    width = F.size("vector") / subvectors
    parts = F.transform(F.sequence(F.lit(0), F.lit(subvectors - 1)), lambda s: F.struct(s.cast("int").alias("s"), F.slice("vector", (s * width + 1).cast("int"), width.cast("int")).alias("part")))
    exploded = sample.select(F.col(order).alias("place"), F.explode(parts).alias("p")).select("place", "p.*")

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        x = np.array(group.column("part").to_pylist(), float)
        centres = kmeans(x, 2**bits, SEED + group.column("s")[0].as_py())
        return pa.table({"s": pa.array([group.column("s")[0].as_py()] * len(centres), pa.int32()), "c": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    rows = sorted(exploded.groupBy("s").applyInArrow(fit, "s int, c int, centre array<double>").collect(), key=lambda r: (r.s, r.c))
    return np.array([r.centre for r in rows], np.float32).reshape(subvectors, 2**bits, -1)


def encode_block(vectors: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Codes (uint8, rows x subvectors): the nearest centroid of each part, the lowest on ties."""
    s, _, w = codebook.shape
    parts = np.asarray(vectors, float).reshape(len(vectors), s, w)
    return np.stack([((parts[:, i, None, :] - codebook[i].astype(float)) ** 2).sum(2).argmin(1) if len(vectors) else np.zeros(0) for i in range(s)], 1).astype(np.uint8)


def reconstruct_block(codes: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return np.concatenate([codebook[i][codes[:, i]] for i in range(codebook.shape[0])], 1)


def code_rows(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def encode(rows: DataFrame, codebook: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and code (binary) of rows with id and vector, and the columns to keep."""
    shared = rows.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in encode_block(x, shared.value)], pa.binary()), *(batch.column(c) for c in keep)], names=["id", "code", *keep])

    kinds = dict(rows.dtypes)
    return rows.select(*dict.fromkeys(["id", "vector", *keep])).mapInArrow(run, f"id {kinds['id']}, code binary" + "".join(f", {c} {kinds[c]}" for c in keep))


def reconstruct(coded: DataFrame, codebook: np.ndarray) -> DataFrame:
    """id and the vector that each code stands for."""
    shared = coded.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = reconstruct_block(code_rows(batch.column("code")), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "vector"])

    return coded.select("id", "code").mapInArrow(run, f"id {dict(coded.dtypes)['id']}, vector array<float>")


class AsymmetricDistance:
    """Scores codes against whole queries: the squared L2 distance to what the codes stand for, from a table for each query."""

    columns = ("code",)

    def __init__(self, matrix: np.ndarray, codebook: np.ndarray):
        s, k, w = codebook.shape
        parts = np.asarray(matrix, float).reshape(len(matrix), s, 1, w)
        self.table = ((parts - codebook.astype(float)[None]) ** 2).sum(3)

    def __len__(self) -> int:
        return len(self.table)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        codes = code_rows(batch.column("code"))
        out = np.zeros((len(self.table), len(codes)))
        for i in range(self.table.shape[1]):
            out += self.table[:, i, :][:, codes[:, i]]
        return out


class ReconstructedDistance:
    """Scores what the codes stand for by the collection's own metric."""

    columns = ("code",)

    def __init__(self, space: str, matrix: np.ndarray, codebook: np.ndarray):
        self.space, self.matrix, self.codebook = space, np.asarray(matrix, float), codebook

    def __len__(self) -> int:
        return len(self.matrix)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return block_distances(self.space, self.matrix, reconstruct_block(code_rows(batch.column("code")), self.codebook).astype(float), unit=True)


def symmetric_distance(a: np.ndarray, b: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared L2 distances between two blocks of codes."""
    out = np.zeros((len(a), len(b)))
    for i in range(codebook.shape[0]):
        c = codebook[i].astype(float)
        table = ((c[:, None] - c[None]) ** 2).sum(2)
        out += table[a[:, i][:, None], b[:, i][None, :]]
    return out
