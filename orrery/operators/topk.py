"""Exact top-k nearest neighbours of a stated set of queries among all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import block_distances, distance, norm, pair_distances

#: Queries that are broadcast at once; more are answered block by block.
QUERY_BLOCK = 4096
#: Cells of a distance matrix that a task holds at once.
CELLS = 1_000_000
#: Rows that a task holds before it lets go of those that are no candidates.
STORED = 20_000
#: Places of a vector that native scoring lays out as columns at most.
FLAT = 256
#: Pairs whose exact distances are taken at once, and how far scores of blocks may be off, relatively.
PAIRS, NOISE = 20_000, 1e-9


def best(scored: DataFrame, k: int, digits: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k best of each qid by (score, id), with their rank. Spark limits each partition to k rows a query before its shuffle."""
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits) + F.lit(0.0))
    order = Window.partitionBy("qid").orderBy("score", "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "score", *keep)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    queries = queries.select("qid", "query")
    few = queries.take(QUERY_BLOCK + 1)
    rows = iter(few) if len(few) <= QUERY_BLOCK else queries.toLocalIterator()
    while held := list(islice(rows, QUERY_BLOCK)):
        yield [r.qid for r in held], np.array([r.query for r in held], float)


class Pool:
    """Running best of a block of queries: candidates no worse than each query's k-th, ties included.

    Scores of a block of rows come from matrix products, whose last digits depend on the block's shape; those of candidates are
    summed once more, pair by pair (``exactly``), so that a page does not depend on how rows lie in files.
    """

    def __init__(self, n: int, k: int, slack: float):
        self.k, self.slack = k, slack
        self.bar = np.full(n, np.inf)
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def _limit(self) -> np.ndarray:
        return self.bar + self.slack + NOISE * (1 + np.abs(self.bar))

    def add(self, scores: np.ndarray, rows: np.ndarray, exactly: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """scores: queries x rows (infinite: not a candidate); rows: their numbers; exactly: scores of single pairs."""
        if scores.shape[1] > self.k:
            self.bar = np.minimum(self.bar, np.partition(scores, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero((scores <= self._limit()[:, None]) & np.isfinite(scores))
        found = exactly(q, c) if exactly and len(q) else scores[q, c]
        self.held = tuple(np.concatenate(x) for x in zip(self.held, (q, found, rows[c]), strict=True))
        if len(self.held[0]) > 4 * self.k * len(self.bar) + 10_000:
            self.prune()

    def prune(self) -> None:
        q, s, r = self.held
        order = np.lexsort((s, q))
        q, s, r = q[order], s[order], r[order]
        first = np.searchsorted(q, np.arange(len(self.bar)))
        place = np.arange(len(q)) - first[q]
        at = q[place == self.k - 1]
        self.bar[at] = np.minimum(self.bar[at], s[place == self.k - 1])
        stay = s <= self._limit()[q]
        self.held = q[stay], s[stay], r[stay]


class Exact:
    """Scores whole vectors against a block of queries."""

    columns = ("vector",)

    def __init__(self, space: str, matrix: np.ndarray, unit: bool = False):
        self.space, self.matrix, self.unit = space, np.asarray(matrix, float), unit

    def __len__(self) -> int:
        return len(self.matrix)

    def _values(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return block_distances(self.space, self.matrix, self._values(batch), self.unit)

    def exactly(self, batch: pa.RecordBatch, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        values = self._values(batch)
        parts = [pair_distances(self.space, self.matrix[q[i : i + PAIRS]], values[c[i : i + PAIRS]], self.unit) for i in range(0, len(q), PAIRS)]
        return np.concatenate(parts)


class Probed:
    """Another scorer over the rows whose cell a query probes (probes: queries x cells)."""

    def __init__(self, scorer: Exact, probes: np.ndarray):
        self.scorer, self.probes, self.columns = scorer, probes, (*scorer.columns, "cell")

    def __len__(self) -> int:
        return len(self.scorer)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.where(self.probes[:, batch.column("cell").to_numpy()], self.scorer.scores(batch), np.inf)

    def exactly(self, batch: pa.RecordBatch, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.scorer.exactly(batch, q, c)


class Store:
    """The rows that a pool may still need, by number: whatever a batch brings, less from time to time what no query holds any more."""

    def __init__(self, pool: Pool):
        self.pool, self.tables, self.numbers = pool, [], []
        self.rows, self.limit = 0, STORED

    def add(self, part: pa.RecordBatch, numbers: np.ndarray) -> None:
        self.tables.append(pa.Table.from_batches([part]))
        self.numbers.append(numbers)
        self.rows += len(numbers)
        if self.rows > self.limit:
            self.compact()

    def compact(self) -> tuple[pa.Table, np.ndarray]:
        """The rows held, in the order of their numbers."""
        self.pool.prune()
        alive = np.unique(self.pool.held[2])
        table = pa.concat_tables(self.tables).take(pa.array(np.searchsorted(np.concatenate(self.numbers), alive)))
        self.tables, self.numbers, self.rows = [table], [alive], len(alive)
        self.limit = max(STORED, 2 * len(alive))
        return table, alive


def scored_topk(rows: DataFrame, ids: list, scorer: Exact, k: int, qid: str, digits: int | None = None, keep: tuple[str, ...] = (), ranked: bool = True) -> DataFrame:
    """qid, rank, id, score of a block of queries (ids, in the scorer's order) by any scorer over the rows' columns that it names.

    ``keep`` names columns of the rows that come along, so that a page needs no second scan; a task holds those of candidates only.
    Not ``ranked``: every row is wanted (k is their number at least), so none is held back and there is no rank to sort them by in one task.
    """
    shared = rows.sparkSession.sparkContext.broadcast((ids, scorer))
    slack = 0.0 if digits is None else 1.1 * 10.0**-digits
    kinds = dict(rows.dtypes)

    def one(part: pa.RecordBatch, qid: Any, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches([part]).take(pa.array(np.flatnonzero(np.isfinite(scores))))
        columns = [pa.array([qid] * met.num_rows), met.column("id"), pa.array(scores[np.isfinite(scores)]), *(met.column(c) for c in keep)]
        yield from pa.table(columns, ["qid", "id", "score", *keep]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scorer = shared.value
        scorer = scorer.opened() if hasattr(scorer, "opened") else scorer
        pool, start = Pool(len(ids), k, slack), 0
        store = Store(pool)
        step = max(1, CELLS // max(1, len(ids)))
        refined = isinstance(scorer.scorer if isinstance(scorer, Probed) else scorer, Exact)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if not ranked:
                    scores = scorer.scores(part)
                    for q in range(len(ids)):
                        yield from one(part, ids[q], scores[q])
                    continue
                numbers = np.arange(start, start + part.num_rows)
                exactly = (lambda q, c, part=part: scorer.exactly(part, q, c)) if refined else None
                pool.add(scorer.scores(part), numbers, exactly)
                store.add(part.select(["id", *keep]), numbers)
                start += part.num_rows
        if start:
            table, alive = store.compact()
            q, s, r = pool.held
            for i in range(0, len(q), 50_000):
                part = slice(i, i + 50_000)
                met = table.take(pa.array(np.searchsorted(alive, r[part]))).combine_chunks()
                columns = [pa.array([ids[j] for j in q[part].tolist()]), met.column("id"), pa.array(s[part]), *(met.column(c) for c in keep)]
                yield from pa.table(columns, ["qid", "id", "score", *keep]).combine_chunks().to_batches()

    columns = dict.fromkeys(["id", *scorer.columns, *keep])
    schema = f"qid {qid}, id {kinds['id']}, score double" + "".join(f", {c} {kinds[c]}" for c in keep)
    found = rows.select(*columns).mapInArrow(run, schema)
    return best(found, k, digits, keep) if ranked else found


def topk(rows: DataFrame, queries: DataFrame, space: str, k: int, digits: int | None = None, native: bool = False) -> DataFrame:
    """qid, rank, id, score: for each query (qid, query) its k nearest rows (id, vector) by (score, id).

    The queries are sent to every task in blocks of QUERY_BLOCK; each task keeps a running best for each query over its rows,
    so what is shuffled is k rows for each query and task. ``digits`` rounds scores before they are ranked. ``native`` scores by Spark
    expressions instead of matrix products (same result, without Python), for up to QUERY_BLOCK queries.
    """
    if k <= 0:
        rows, k = rows.limit(0), 1
    if native:
        if (n := queries.count()) > QUERY_BLOCK:
            raise ValueError(f"{n} queries; native scoring takes up to {QUERY_BLOCK}")
        first = rows.select(F.size("vector")).first()
        if space == "cosine" and first and 0 < first[0] <= FLAT:
            return best(_flat_cosine(rows, queries, first[0]), k, digits)
        pairs = rows.select("id", "vector").crossJoin(F.broadcast(queries.select("qid", "query")))
        return best(pairs.select("qid", "id", distance(space, F.col("query"), F.col("vector")).alias("score")), k, digits)
    qid = dict(queries.dtypes)["qid"]
    found = [scored_topk(rows, ids, Exact(space, matrix), k, qid, digits) for ids, matrix in _query_blocks(queries)]
    if not found:
        return best(rows.select(F.lit(None).cast(qid).alias("qid"), "id", F.lit(0.0).alias("score")).limit(0), k, digits)
    return reduce(DataFrame.unionByName, found)


def _flat_cosine(rows: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """qid, id, score of all pairs, summed in the order of distance(); a column for each place, so that pairs run as compiled code, and norms once a vector."""
    flat = lambda df, name, key, p: df.select(key, norm(F.col(name)).alias(f"{p}norm"), *(F.coalesce(F.get(name, F.lit(i)).cast("double"), F.lit(0.0)).alias(f"{p}{i}") for i in range(dim)))
    pairs = flat(rows, "vector", "id", "r").crossJoin(F.broadcast(flat(queries, "query", "qid", "q")))
    dot = reduce(lambda total, i: total + F.col(f"q{i}") * F.col(f"r{i}"), range(dim), F.lit(0.0))
    scale = F.col("qnorm") * F.col("rnorm")
    cosine = F.when(scale > 0, F.try_divide(dot, scale)).otherwise(0.0)
    return pairs.select("qid", "id", F.greatest(F.lit(0.0), 1 - cosine).alias("score"))


def native_topk(rows: DataFrame, queries: DataFrame, space: str, k: int, digits: int | None = None) -> DataFrame:
    """topk() by Spark expressions for any number of queries: in ranges of qid of QUERY_BLOCK queries each."""
    starts = sorted(r.qid for r in queries.select("qid").collect())[::QUERY_BLOCK]
    if len(starts) <= 1:
        return topk(rows, queries, space, k, digits, native=True)
    ends = [F.col("qid") < s for s in starts[1:]] + [F.lit(True)]
    found = [topk(rows, queries.filter((F.col("qid") >= s) & end), space, k, digits, native=True) for s, end in zip(starts, ends, strict=True)]
    return reduce(DataFrame.unionByName, found)
