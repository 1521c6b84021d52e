"""Approximate search by cells: vectors are assigned to the nearest of some centres, a query reads its nearest cells only."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import block_distances
from .quantize import assign, code_rows, kmeans, reconstruct_block

#: Vectors that cell centres are fitted on at most.
SAMPLE = 50_000
#: The share of true neighbours that calibrated probes find in the sample, and sample vectors that are asked at most.
RECALL, QUERIES = 0.95, 512
#: Page lengths that probes are calibrated for.
PAGES = (10, 100)


def cell_count(n: int, m: int) -> int:
    """About sqrt(n) cells, more for a larger m (the graph degree in other engines), and at least 20 vectors in each."""
    return max(1, min(int(math.sqrt(max(1, n)) * m / 16), n // 20 or 1, 4096))


def fit_cells(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    x = np.asarray(sample, float)
    return kmeans(x, min(cells, len(x)), seed)


def fit_cells_in_task(sample: DataFrame, cells: int, space: str, codebook: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """fit_cells() and calibrate_probes() for each of PAGES, in one task over a bounded sample (seq, vector, or code where that is null).

    The driver holds the centres and those numbers only.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        column = group.column("vector").combine_chunks()
        x = reconstruct_block(code_rows(group.column("code").combine_chunks()), codebook) if column.null_count else column.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        centres = fit_cells(x, cells)
        rows = [*centres.tolist(), [float(calibrate_probes(space, x, centres, k)) for k in PAGES]]
        return pa.table({"place": pa.array(range(len(rows)), pa.int32()), "numbers": pa.array(rows, pa.list_(pa.float64()))})

    found = sample.select(F.lit(0).alias("all"), "seq", "vector", "code").groupBy("all").applyInArrow(run, "place int, numbers array<double>").collect()
    *centres, needed = [r.numbers for r in sorted(found, key=lambda r: r.place)]
    return np.array(centres), [int(n) for n in needed]


def probes(queries: np.ndarray, centres: np.ndarray, ef: int, n: int, needed: Sequence[int] = (), k: int = 10) -> np.ndarray:
    """For each query the cells that it reads (bool): the nearest, as many as hold about ``ef`` of n vectors, and as the sample shows a page of k to need."""
    least = needed[min(sum(k > page for page in PAGES), len(needed) - 1)] if needed else 1
    return nearest_cells(queries, centres, min(len(centres), max(least, math.ceil(ef / max(1.0, n / len(centres))))))


def nearest_cells(queries: np.ndarray, centres: np.ndarray, each: int) -> np.ndarray:
    """For each query its ``each`` nearest cells (bool)."""
    out = np.zeros((len(queries), len(centres)), bool)
    np.put_along_axis(out, _order(queries, centres)[:, :each], True, 1)
    return out


def _order(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (centres**2).sum(1) - 2 * np.asarray(queries, float) @ centres.T
    return np.argsort(d, axis=1, kind="stable")


def calibrate_probes(space: str, sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many cells a query must read so that RECALL of the k true neighbours of sample vectors, without themselves, is found.

    A sample is thinner than its table and so its neighbours lie farther off: for the whole table the number errs on the side of more.
    """
    x = np.asarray(sample, float)
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centres)
    cells = assign(x, centres)[0]
    asked = np.arange(0, len(x), max(1, len(x) // QUERIES))[:QUERIES]
    places = []
    for i in range(0, len(asked), 64):
        part = asked[i : i + 64]
        far = block_distances(space, x[part], x)
        far[np.arange(len(part)), part] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = np.argsort(_order(x[part], centres), axis=1)
        places.append(np.take_along_axis(order, cells[near], 1).ravel())
    places = np.sort(np.concatenate(places))
    return int(places[math.ceil(RECALL * len(places)) - 1]) + 1


__all__ = ["assign", "calibrate_probes", "cell_count", "fit_cells", "fit_cells_in_task", "nearest_cells", "probes"]
