"""Neighbour lists with a diversity rule: of a row's nearest neighbours those that no kept nearer one stands in front of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.metrics import block_distances
from .topk import topk


def spread(space: str, scores: np.ndarray, vectors: np.ndarray, m: int) -> list[int]:
    """Up to m places of candidates (nearest first): each is nearer to the row than to every candidate kept before it."""
    between = block_distances(space, vectors, vectors)
    kept: list[int] = []
    for i in range(len(scores)):
        if len(kept) == m:
            break
        if all(between[i, j] >= scores[i] for j in kept):
            kept.append(i)
    return kept


def neighbour_lists(rows: DataFrame, queries: DataFrame, space: str, candidates: int, m: int) -> DataFrame:
    """qid, id, score, place: for each query (qid, query) up to ``m`` of its ``candidates`` nearest rows (id, vector) but itself."""
    near = topk(rows, queries, space, candidates + 1)
    near = near.filter("qid <> id").filter(f"rank <= {candidates + 1}")
    met = near.join(rows.select("id", "vector"), "id")
    kinds = dict(met.dtypes)

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank").slice(0, candidates)
        x = np.array(group.column("vector").to_pylist(), float)
        kept = spread(space, group.column("score").to_numpy(), x, m)
        taken = group.take(pa.array(kept, pa.int64()))
        return pa.table({"qid": taken.column("qid"), "id": taken.column("id"), "score": taken.column("score"), "place": pa.array(range(1, len(kept) + 1), pa.int32())})

    return met.groupBy("qid").applyInArrow(choose, f"qid {kinds['qid']}, id {kinds['id']}, score double, place int")
