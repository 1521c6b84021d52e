"""How many candidates a quantised search fetches before it rescores them on raw vectors, given or calibrated."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.metrics import block_distances, pair_distances
from .quantize import AsymmetricDistance, encode_block
from .topk import CELLS, PAIRS

#: Fixed values of the rule.
HEADROOM, LOWEST, SHARE, RECALL = 1.75, 250, 4, 0.99
PAGES, FRACTIONS, QUERIES = (1, 10, 100), (0.25, 0.5, 0.75, 1.0), 512
EXPONENT_MARGIN, EXPONENT_RANGE = 0.15, (0.40, 1.0)
#: Counts by distance for each query, and queries whose counts travel in one row.
BINS, PIECE = 64, 256


@dataclass
class Calibration:
    fetch: int
    records: int
    queries: int
    exponent: float
    fit_fetches: list[int]
    page_fetches: list[int]
    page_exponent: float = 0.0
    millis: int = 0

    def to_json(self) -> dict:
        return asdict(self)


def fetch_count(k: int, n: int, factor: int | None, calibration: Calibration | None) -> int:
    """Candidates for a page of k among n records: by the caller's factor, else by the calibration, else by a fixed rule."""
    most = max(n, k)
    if factor is not None:
        return min(k * factor, most)
    lowest = max(LOWEST, 5 * k)
    if calibration is None:
        return min(max(n // 50, lowest), most)
    grown = HEADROOM * calibration.fetch * (n / max(1, calibration.records)) ** calibration.exponent * page_scale(k, calibration)
    return min(min(max(math.floor(grown + 0.5), lowest), max(n // SHARE, lowest)), most)


def page_scale(k: int, calibration: Calibration) -> float:
    """The measured fetch at a page of k over that at 10, read off the log-log line through the measured pages; from 1 to k/10."""
    if k <= 10:
        return 1.0
    x, y = np.log(PAGES), np.log(np.maximum(1, calibration.page_fetches))
    at = math.log(k)
    slope = (y[2] - y[1]) / (x[2] - x[1])
    value = np.interp(at, x, y) if at <= x[2] else y[2] + slope * (at - x[2])
    return float(min(max(math.exp(value - y[1]), 1.0), k / 10))


def _needed(space: str, vectors: np.ndarray, codes: np.ndarray, codebook: np.ndarray, queries: np.ndarray, page: int) -> int:
    """The rank by codes within which the given share of true neighbours lies, over all queries' neighbours together."""
    batch = pa.RecordBatch.from_pydict({"code": pa.array([c.tobytes() for c in codes], pa.binary())})
    ranks = []
    for i in range(0, len(queries), 64):
        part = queries[i : i + 64]
        true = block_distances(space, part, vectors)
        near = AsymmetricDistance(part, codebook).scores(batch)
        page_ids = np.argsort(true, axis=1, kind="stable")[:, :page]
        place = np.empty_like(near, dtype=np.int64)
        np.put_along_axis(place, np.argsort(near, axis=1, kind="stable"), np.arange(near.shape[1])[None, :], 1)
        ranks.append(np.take_along_axis(place, page_ids, 1).ravel() + 1)
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[math.ceil(RECALL * len(ranks)) - 1])


def calibrate(space: str, vectors: np.ndarray, codebook: np.ndarray) -> Calibration | None:
    """Measure the fetch on the bounded training sample (in arrival order), and how it grows with the records."""
    began, n = time.perf_counter(), len(vectors)
    if n < 2:
        return None
    codes = encode_block(vectors, codebook)
    queries = vectors[:: max(1, n // QUERIES)][:QUERIES].astype(float)
    x = vectors.astype(float)
    fits = [_needed(space, x[: int(n * f)], codes[: int(n * f)], codebook, queries, min(10, int(n * f))) for f in FRACTIONS]
    slope = float(np.polyfit(np.log([n * f for f in FRACTIONS]), np.log(fits), 1)[0])
    pages = [_needed(space, x, codes, codebook, queries, min(p, n)) for p in PAGES]
    growth = float(np.polyfit(np.log(PAGES), np.log(pages), 1)[0])
    return Calibration(fits[-1], n, len(queries), min(max(slope + EXPONENT_MARGIN, EXPONENT_RANGE[0]), EXPONENT_RANGE[1]), fits, pages, min(max(growth, 0.0), 1.0), int(1_000 * (time.perf_counter() - began)))


class Rescored:
    """Scores by raw L2 distance the rows whose code is at most ``bounds`` from a query; the others are no candidates."""

    columns = ("code", "vector")

    def __init__(self, matrix: np.ndarray, codebook: np.ndarray, bounds: np.ndarray):
        self.matrix, self.codebook, self.bounds = np.asarray(matrix, float), codebook, bounds

    def __len__(self) -> int:
        return len(self.matrix)

    def opened(self) -> Rescored:
        """One for a task, with the table of distances to centroids, which is large and would stay in the worker with the broadcast."""
        own = Rescored(self.matrix, self.codebook, self.bounds)
        own.by_code = AsymmetricDistance(self.matrix, self.codebook)
        return own

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        near = self.by_code.scores(batch)
        q, c = np.nonzero(near <= self.bounds[:, None])
        values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        near.fill(np.inf)
        for i in range(0, len(q), PAIRS):
            at = slice(i, i + PAIRS)
            near[q[at], c[at]] = pair_distances("l2", self.matrix[q[at]], values[c[at]])
        return near


def code_bounds(coded: DataFrame, matrix: np.ndarray, codebook: np.ndarray, fetch: int, n: int, sample: np.ndarray) -> np.ndarray:
    """For each query a distance by code within which ``fetch`` of the n rows lie at least, and few more (infinite: all).

    Tasks count rows by distance in BINS, laid by a sample of codes around where the bound must be; only counts are shuffled. Where the
    sample misleads, the bound is looser, never tighter.
    """
    if fetch >= n or not len(matrix):
        return np.full(len(matrix), np.inf)
    share = fetch / n
    batch = pa.RecordBatch.from_pydict({"code": pa.array([c.tobytes() for c in sample], pa.binary())})
    parts = [np.quantile(AsymmetricDistance(matrix[i : i + 256], codebook).scores(batch), [share / 2, min(1.0, 2 * share)], axis=1).T for i in range(0, len(matrix), 256)]
    low, high = np.concatenate(parts).T
    edges = low[:, None] + np.maximum(high - low, 1e-9)[:, None] * np.linspace(0, 1, BINS)[None]
    shared = coded.sparkSession.sparkContext.broadcast((np.asarray(matrix, float), codebook, edges))
    pieces = -(-len(matrix) // PIECE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, codebook, edges = shared.value
        scorer, counts, width = AsymmetricDistance(matrix, codebook), np.zeros(len(matrix) * (BINS + 1), np.int64), (edges[:, -1] - edges[:, 0]) / (BINS - 1)
        step = max(1, CELLS // len(matrix))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                near = scorer.scores(batch.slice(at, step))
                q, c = np.nonzero(near <= edges[:, -1:])
                d = near[q, c]
                place = np.clip(np.ceil((d - edges[q, 0]) / width[q]), 0, BINS - 1).astype(np.int64)
                place += d > edges[q, place]  # rounding: a row counts below an edge only if it is
                counts += np.bincount(q * (BINS + 1) + place, minlength=len(counts))
        counts = counts.reshape(len(matrix), -1)
        held = [counts[i * PIECE : (i + 1) * PIECE].tobytes() for i in range(pieces)]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "counts": pa.array(held, pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in group.column("counts").to_pylist())
        return pa.table({"piece": pa.array([group.column("piece")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    found = coded.select("code").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    below = np.concatenate([np.frombuffer(r.counts, np.int64).reshape(-1, BINS + 1) for r in sorted(found, key=lambda r: r.piece)]).cumsum(1)[:, :BINS]
    enough = below >= fetch
    return np.where(enough.any(1), edges[np.arange(len(matrix)), enough.argmax(1)], np.inf)
