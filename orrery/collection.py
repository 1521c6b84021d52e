"""A collection of records (id, vector, metadata): immutable Parquet segments, searched and filtered through Spark plans."""

from __future__ import annotations

import functools
import json
import logging
import math
import os
import threading
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.filters import StoredField, always, bound, condition, names, parse, selection
from .functions.metrics import distance, vector_error
from .functions.values import stored
from .operators.ivf import PAGES, SAMPLE, cell_count, fit_cells_in_task, probes
from .operators.quantize import AsymmetricDistance, ReconstructedDistance, assign, code_rows, encode_block, reconstruct_block, train
from .operators.rerank import Calibration, calibrate, fetch_count
from .operators.topk import QUERY_BLOCK, Exact, Probed, best, scored_topk
from .plans.config import MAX_EF_SEARCH, MAX_EXPECTED, MAX_M, MAX_TOP_K, MIN_M, Config, Quantization, _whole, check, fixed_bytes
from .plans.workspace import Workspace
from .sources import storage
from .sources.ingest import AddResult, check_vector, records, row_schema, stored_rows

log = logging.getLogger("orrery")
INPUT = "ordinal long, id string, vector array<float>, json string"
#: A filtered search of a quantised collection scores up to so many matches by the raw metric.
EXACT_MATCHES = 5_000
#: Names that a plan lists as literals at most; more are joined.
LISTED = 500
#: Dead rows that are sent to every task of a read (16 bytes each); beyond them the segments that hold most are rewritten. Tables of dead rows at most.
MOST_DEAD, DEAD_TABLES = 4_000_000, 64
#: Vectors that a codebook is fitted on at most, whatever training_size says.
MOST_TRAINING = 1_000_000
#: Bytes that a saved file has about, as its digest is taken in memory; rows of a saved codebook or table of cells at most.
FILE_BYTES, MOST_NUMBERS = 256 << 20, 200_000


@dataclass(frozen=True)
class Segment:
    """A written table of records, and the row numbers that it may hold: from first up to, without, end."""

    path: str
    first: int
    end: int


@dataclass(frozen=True)
class State:
    """Everything that a read depends on. A change swaps the whole, so a reader sees all of it or nothing."""

    segments: tuple[Segment, ...] = ()
    dead: tuple[str, ...] = ()
    stranded: int = 0
    count: int = 0
    codebook: np.ndarray | None = None
    active: bool = False
    calibration: Calibration | None = None
    cells: np.ndarray | None = None
    probes: tuple[int, ...] = ()


def exclusive(method: Callable) -> Callable:
    """One change at a time; reads go on meanwhile, on the state that they started with."""

    @functools.wraps(method)
    def run(self: Collection, *args: Any, **more: Any) -> Any:
        with self._lock:
            return method(self, *args, **more)

    return run


class Collection:
    """Made by VectorDatabase.create() or load(). Methods that answer with Python objects collect their own result only.

    Threads may read and change a collection together: every read works on one immutable state, changes wait for each other.
    """

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self._space = Workspace(spark)
        self._lock = threading.RLock()
        self._state = State()
        self._seq = self._row = self._generated = 0
        self._index_metadata: dict[str, str] = {}
        self._warned = False

    # -- configuration ---------------------------------------------------------------------------------------------

    dim = property(lambda self: self.config.dim)
    space = property(lambda self: self.config.space)
    m = property(lambda self: self.config.m)
    ef_construction = property(lambda self: self.config.ef_construction)
    expected_size = property(lambda self: self.config.expected_size)
    indexed_fields = property(lambda self: list(self.config.indexed_fields))

    def get_space(self) -> str:
        return self.config.space

    # -- the live records ------------------------------------------------------------------------------------------

    @property
    def records(self) -> DataFrame:
        """Every live record: row_id, id, seq, vector, code, cell, json, fields (and declared)."""
        return self._rows(self._state)

    def _rows(self, state: State) -> DataFrame:
        """A state's live records. Its dead rows are few (MOST_DEAD), so they are sent to the scan and no record is shuffled."""
        schema = row_schema(self.config.indexed_fields)
        if not state.segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(s.path for s in state.segments))
        return rows.join(F.broadcast(self._dead_rows(state)), "row_id", "left_anti") if state.dead else rows

    def _dead_rows(self, state: State) -> DataFrame:
        return self.spark.read.schema("row_id long").parquet(*state.dead)

    def _field(self, rows: DataFrame, name: str) -> StoredField:
        declared = self.config.indexed_fields
        if name in declared:
            return StoredField(rows["declared"][f"f{declared.index(name)}"])
        return StoredField(rows["fields"][F.lit(name)] if name else rows["fields"][F.lit("")])

    def _condition(self, rows: DataFrame, wanted: Mapping | None) -> tuple[DataFrame, bool]:
        """The matching rows, and whether a filter narrows them."""
        node = parse(wanted)
        if always(node):
            return rows, False
        if self.config.indexed_fields and not self._warned and (other := names(node) - set(self.config.indexed_fields)):
            self._warned = True
            log.warning("Filter on undeclared field(s) %s reads every record's metadata; declare them in indexed_fields", sorted(other))
        known = set(self.config.indexed_fields)
        found = rows
        if known and selection(node, known) == "narrowed":
            # What declared fields alone rule out, as a condition of its own that reaches the scan; Catalyst draws it from an AND only.
            found = found.filter(condition(bound(node, known, True), lambda name: self._field(rows, name)))
        return found.filter(condition(node, lambda name: self._field(rows, name))), True

    def explain_filter(self, filter: Mapping | None) -> dict[str, Any]:
        """What a filter reads: "selection" (exact, narrowed or whole, by declared fields alone), "declared" and "undeclared" fields."""
        node, known = parse(filter), set(self.config.indexed_fields)
        return {"selection": selection(node, known), "declared": sorted(names(node) & known), "undeclared": sorted(names(node) - known)}

    def count_bounds(self, filter: Mapping | None) -> tuple[int, int]:
        """The fewest and the most records that can match, from declared fields alone: metadata of other fields is not read."""
        node, known, state = parse(filter), set(self.config.indexed_fields), self._state
        rows = self._rows(state)
        holds = [condition(bound(node, known, upper), lambda name: self._field(rows, name)) for upper in (False, True)]
        low, high = rows.agg(*(F.count(F.when(h, 1)) for h in holds)).first()
        return low, high

    def frame(self, filter: Mapping | None = None) -> DataFrame:
        """id, seq, vector, json of the records that match, as a DataFrame."""
        return self._condition(self.records, filter)[0].select("id", "seq", "vector", "json")

    def _marked(self, state: State, rows: DataFrame) -> tuple[State, int]:
        """The state with rows (row_id) dead, and their number; where dead rows get too many, segments are rewritten without them."""
        path = self._space.write(rows.select("row_id"))
        n = self.spark.read.parquet(path).count()
        if not n:
            return state, 0
        state = replace(state, dead=(*state.dead, path), stranded=state.stranded + n, count=state.count - n)
        return (self._relieved(state) if state.stranded > MOST_DEAD or len(state.dead) > DEAD_TABLES else state), n

    def _relieved(self, state: State) -> State:
        """The state with its segments of most dead rows rewritten until half of MOST_DEAD is left, and one table of dead rows."""
        starts = sorted(state.segments, key=lambda s: s.first)
        dead = self._dead_rows(state)
        place = F.size(F.filter(F.array(*(F.lit(s.first) for s in starts)), lambda first: first <= F.col("row_id")))
        held = {r.place: r["count"] for r in dead.groupBy(place.alias("place")).count().collect()}
        left, fresh = sum(held.values()), {}
        for place in sorted(held, key=held.get, reverse=True):
            if left <= MOST_DEAD // 2:
                break
            segment = starts[place - 1]
            rows = self.spark.read.schema(row_schema(self.config.indexed_fields)).parquet(segment.path)
            inside = dead.filter((F.col("row_id") >= segment.first) & (F.col("row_id") < segment.end))
            fresh[segment] = replace(segment, path=self._space.write(self._clustered(rows.join(inside, "row_id", "left_anti")), "id"))
            left -= held[place]
        for segment in fresh:
            dead = dead.filter((F.col("row_id") < segment.first) | (F.col("row_id") >= segment.end))
        return replace(state, segments=tuple(fresh.get(s, s) for s in state.segments), dead=(self._space.write(dead),) if left else (), stranded=left)

    def _clustered(self, rows: DataFrame, whole: bool = False) -> DataFrame:
        """Rows ordered by the declared fields, so that conditions on them skip row groups; ``whole``: and dealt over files by the first."""
        fields = [F.col(f"declared.f{i}.{part}") for i in range(len(self.config.indexed_fields)) for part in ("kind", "num", "text")]
        if not fields:
            return rows
        return (rows.repartitionByRange(*fields[:3]) if whole else rows).sortWithinPartitions(*fields)

    def _named(self, ids: list[str]) -> tuple[DataFrame, Column | None]:
        return self.spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, place long"), F.col("id").isin(ids) if len(ids) <= LISTED else None

    def _by_ids(self, ids: list[str]) -> DataFrame:
        rows = self.records
        frame, listed = self._named(ids)
        return rows.filter(listed) if listed is not None else rows.join(frame.select("id").distinct(), "id", "left_semi")

    # -- adding ----------------------------------------------------------------------------------------------------

    @exclusive
    def add(self, data: Any, overwrite: bool = True) -> AddResult:
        """Add one record, lists of records or of columns, or a matrix; DataFrames go to add_frame()."""
        if isinstance(data, DataFrame):
            return self.add_frame(data, overwrite)
        good, errors = records(data, self.dim)
        shape = (len(good) + len(errors), self.dim) if isinstance(data, np.ndarray) or isinstance(data, dict) and any(isinstance(data.get(k), np.ndarray) for k in ("vectors", "embeddings", "values")) else (len(good), self.dim) if good else None
        if not good:
            return AddResult(0, len(errors), errors, shape, [])
        rows = []
        for i, (name, vector, metadata) in enumerate(good):
            rows.append((i, name if name is not None else self._next_name(), vector, json.dumps(metadata, ensure_ascii=False)))
        columns = list(zip(*rows, strict=True))
        table = pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.float32())), pa.array(columns[3], pa.string())], ["ordinal", "id", "vector", "json"])
        seen: set[str] = set()
        again = [r[1] for r in rows if r[1] in seen or seen.add(r[1])]
        taken, inserted = self._insert(self.spark.createDataFrame(table), overwrite, len(rows))
        bad = errors + [f"Vector {i}: Vector with ID '{i}' already exists" for i in [*again, *taken]]
        refused = set(taken)
        ids = list(dict.fromkeys(r[1] for r in rows if r[1] not in refused))
        more = self._maybe_train()
        return AddResult(inserted, len(bad), bad + more, shape, ids)

    def _next_name(self) -> str:
        self._generated += 1
        return f"vec_{self._generated}"

    @exclusive
    def add_frame(self, df: DataFrame, overwrite: bool = True, most_errors: int = 1_000) -> AddResult:
        """Add the rows of a DataFrame with vector, and if there are such columns id and metadata (JSON text, map or struct).

        Rows are checked, numbered and written where they are; only counts and up to ``most_errors`` error texts come back. A
        null id is generated. The ids of the result stay empty, as they can be as many as the rows.
        """
        kinds = dict(df.dtypes)
        text = F.lit("{}") if "metadata" not in kinds else F.coalesce(F.col("metadata") if kinds["metadata"] == "string" else F.to_json("metadata"), F.lit("{}"))
        name = F.col("id").cast("string") if "id" in kinds else F.lit(None).cast("string")
        checked = df.select(name.alias("id"), F.col("vector").cast("array<float>").alias("vector"), text.alias("json")).withColumn("error", vector_error(F.col("vector"), self.dim))
        rows, n = self._numbered(checked)
        bad = rows.filter("error is not null")
        errors = [f"Vector {r.id}: {r.error}" for r in bad.select("id", "error").limit(most_errors).collect()]
        n_bad = len(errors) if len(errors) < most_errors else bad.count()
        if n == n_bad:
            return AddResult(0, n_bad, errors, (n_bad, self.dim), [])
        rows = rows.filter("error is null").drop("error")
        rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("vec_"), F.col("ordinal") + 1 + self._generated)))
        self._generated += n
        taken, inserted = self._insert(rows, overwrite, n, most_errors)
        errors += [f"Vector {i}: Vector with ID '{i}' already exists" for i in taken]
        return AddResult(inserted, n - inserted, errors + self._maybe_train(), (n, self.dim), [])

    def _numbered(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """The rows, written, with a dense ordinal in the order of partitions and of rows in them (files come back in another order)."""
        marked = self.spark.read.parquet(self._space.write(rows.withColumn("mark", F.monotonically_increasing_id())))
        part = F.shiftright("mark", 33)
        counts = sorted(map(tuple, marked.groupBy(part.alias("part")).count().collect()))
        start, total = [], 0
        for p, n in counts:
            start.append((p, total))
            total += n
        starts = self.spark.createDataFrame(start, "part long, start long")
        ordinal = F.col("start") + F.col("mark").bitwiseAND(F.lit(2**33 - 1))
        return marked.withColumn("part", part).join(F.broadcast(starts), "part").select(ordinal.alias("ordinal"), *rows.columns), total

    def _insert(self, rows: DataFrame, overwrite: bool, n: int, most: int | None = None) -> tuple[list[str], int]:
        """Write rows (INPUT) as a segment; of an id that comes twice the first row. The ids refused for being there, and the rows inserted."""
        ids = rows.select("id", "ordinal")
        several = ids.groupBy("id").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).filter("n > 1")
        if not several.isEmpty():  # only then do rows meet their later namesakes, by a number that none shares
            rows = rows.join(ids.join(several, "id").filter("ordinal > first").select("ordinal"), "ordinal", "left_anti")
        state = self._state
        refused: list[str] = []
        there = self._rows(state).select("row_id", "id") if state.segments else None
        if there is not None and not overwrite:
            known = rows.select("id").join(there.select("id"), "id", "left_semi")
            refused = [r.id for r in (known.limit(most) if most else known).collect()]
            rows = rows.join(there.select("id"), "id", "left_anti")
        keep = not (state.active and self.config.quantization.storage_mode == "quantized_only")
        based = rows.select((F.col("ordinal") + self._row).alias("row_id"), "id", (F.col("ordinal") + self._seq + 1).alias("seq"), "vector", "json")
        made = stored_rows(based, self.space, self.config.indexed_fields, state.codebook if state.active else None, state.cells, keep)
        path = self._space.write(self._clustered(made), "id")
        inserted = self.spark.read.parquet(path).count()
        if there is not None and overwrite:
            state, _ = self._marked(state, there.join(self.spark.read.parquet(path).select("id"), "id", "left_semi"))
        self._state = replace(state, segments=(*state.segments, Segment(path, self._row, self._row + n)), count=state.count + inserted)
        self._row += n
        self._seq += n
        return refused, inserted

    # -- search ----------------------------------------------------------------------------------------------------

    def search(self, vector: Any, filter: Mapping | None = None, top_k: int = 10, ef_search: int | None = None, return_vector: bool = False, rerank: int | None = None) -> Any:
        """The page of one query (list of dicts), or of each of a batch (list of lists), nearest first.

        Metadata and vectors come along with the candidates, so that records are scanned once. For what is exact, and on which scale
        scores are, see search_matrix().
        """
        batch = isinstance(vector, np.ndarray) and vector.ndim == 2 or isinstance(vector, (list, tuple)) and len(vector) > 0 and isinstance(vector[0], (list, tuple, np.ndarray))
        if isinstance(vector, (list, tuple, np.ndarray)) and len(vector) == 0:
            raise ValueError("Batch cannot be empty" if getattr(vector, "ndim", 1) == 2 else "Search vector cannot be empty")
        queries = [check_vector(v, self.dim, f"Vector {i} in batch" if batch else "Search vector") for i, v in enumerate(vector if batch else [vector])]
        state = self._state
        page = self._search(state, np.array(queries, np.float32), filter, top_k, ef_search, rerank, ("json", "vector", "code") if return_vector else ("json",))
        out: list[list[dict]] = [[] for _ in queries]
        if page is not None:
            for r in page.orderBy("qid", "rank").collect():
                hit = {"id": r.id, "score": r.score, "metadata": json.loads(r.json)}
                if return_vector:
                    hit["vector"] = self._vector(r)
                out[r.qid].append(hit)
        return out if batch else out[0]

    def _vector(self, row: Any) -> np.ndarray:
        if row.vector is not None:
            return np.array(row.vector, np.float32)
        return reconstruct_block(np.frombuffer(bytes(row.code), np.uint8)[None], self._state.codebook)[0].astype(np.float32)

    def search_matrix(self, queries: np.ndarray, filter: Mapping | None = None, top_k: int = 10, ef_search: int | None = None, rerank: int | None = None, digits: int | None = None) -> DataFrame | None:
        """qid (row of the matrix), rank, id, score as a DataFrame; None for an empty page.

        Exact over the matching records, unless cells were built (rebuild()) and ef_search is below the record count: then a query
        reads as many cells as hold ef_search vectors, but no fewer than held 95 % of the neighbours of a sample. A
        quantised collection scores codes (squared L2), rescores a calibrated number of candidates on raw vectors where it keeps
        them, and scores a filter's matches, up to EXACT_MATCHES, by the raw metric; so the scale of its scores depends on how many
        records the filter leaves. ``digits`` rounds scores before they are ranked. ef_search and rerank may be as large as the collection.
        """
        return self._search(self._state, queries, filter, top_k, ef_search, rerank, digits=digits)

    def _search(self, state: State, queries: np.ndarray, filter: Mapping | None, top_k: int, ef_search: int | None, rerank: int | None, keep: tuple[str, ...] = (), digits: int | None = None) -> DataFrame | None:
        _whole("top_k", top_k, 0, MAX_TOP_K)
        if ef_search is not None:
            _whole("ef_search", ef_search, 1, max(MAX_EF_SEARCH, state.count))
        if rerank is not None:
            _whole("rerank", rerank, 0, max(MAX_TOP_K, state.count))
        rows, narrowed = self._condition(self._rows(state), filter)
        if top_k == 0 or not state.count:
            return None
        queries = np.asarray(queries, np.float32)
        if self.space == "cosine":
            norm = np.sqrt((queries * queries).sum(1, keepdims=True))
            queries = np.where(norm > 0, queries / np.where(norm > 0, norm, 1), queries)
        found = []
        for start in range(0, len(queries), QUERY_BLOCK):
            part = queries[start : start + QUERY_BLOCK]
            found.append(self._search_block(state, rows, narrowed, list(range(start, start + len(part))), part, top_k, ef_search, rerank, keep, digits))
        return reduce(DataFrame.unionByName, found)

    def _search_block(self, state: State, rows: DataFrame, narrowed: bool, ids: list[int], part: np.ndarray, k: int, ef: int | None, rerank: int | None, keep: tuple[str, ...], digits: int | None) -> DataFrame:
        near = state.cells is not None and ef is not None and ef < state.count

        def run(scorer: Any, rows: DataFrame, k: int, keep: tuple[str, ...] = keep, digits: int | None = digits, ranked: bool = True) -> DataFrame:
            if near:
                mask = probes(part, state.cells, ef, state.count, state.probes, k)
                rows = rows.filter(F.col("cell").isin([int(c) for c in np.flatnonzero(mask.any(0))]))
                scorer = Probed(scorer, mask)
            return scored_topk(rows, ids, scorer, k, "long", digits, keep, ranked)

        if not state.active:
            return run(Exact(self.space, part, unit=True), rows, k)
        raw = self.config.quantization.storage_mode == "quantized_with_raw"
        exact = Exact(self.space, part, unit=True) if raw else ReconstructedDistance(self.space, part, state.codebook)
        if narrowed and rows.limit(EXACT_MATCHES + 1).count() <= EXACT_MATCHES:
            return run(exact, rows, k)
        by_code = AsymmetricDistance(part, state.codebook)
        if not raw or rerank == 0:
            return run(by_code, rows, k)
        fetch = fetch_count(k, state.count, rerank, state.calibration)
        # Where as many are fetched as there are records, all are candidates, however they rank.
        return self._rescored(run(by_code, rows, fetch, (), None, fetch < state.count), rows, ids, part, k, keep, digits)

    def _rescored(self, candidates: DataFrame, rows: DataFrame, ids: list[int], part: np.ndarray, k: int, keep: tuple[str, ...], digits: int | None) -> DataFrame:
        """The candidates' raw distances, by expressions over the join of candidates, raw vectors and queries."""
        asked = self.spark.createDataFrame(pa.table({"qid": pa.array(ids, pa.int64()), "query": pa.array(part.tolist(), pa.list_(pa.float32()))}))
        met = candidates.select("qid", "id").join(rows.select(*dict.fromkeys(["id", "vector", *keep])), "id").join(F.broadcast(asked), "qid")
        return best(met.select("qid", "id", distance(self.space, F.col("query"), F.col("vector"), unit=True).alias("score"), *keep), k, digits, keep)

    # -- counting, listing, lookup ---------------------------------------------------------------------------------

    def count(self, filter: Mapping | None = None) -> int:
        state = self._state
        rows, narrowed = self._condition(self._rows(state), filter)
        return rows.count() if narrowed else state.count

    def __len__(self) -> int:
        return self._state.count

    def get_vector_count(self) -> int:
        return self._state.count

    def list(self, number: int = 10, offset: int = 0, after: str | None = None) -> list[tuple[str, dict]]:
        """(id, metadata) in arrival order, from an offset or after an id."""
        if after is not None and offset:
            raise ValueError("list() takes offset or after, not both")
        if number < 0 or offset < 0:
            raise ValueError("number and offset must not be negative")
        rows = self.records.select("id", "seq", "json")
        if after is not None:
            at = rows.filter(F.col("id") == after).select("seq").first()
            if at is None:
                raise KeyError(after)
            rows = rows.filter(F.col("seq") > at.seq)
        rows = rows.orderBy("seq").offset(offset).limit(number)
        return [(r.id, json.loads(r.json)) for r in rows.collect()]

    def get_records(self, ids: Any, return_vector: bool = True, strict: bool = False) -> list[dict]:
        """Records by id in the order asked, as often as asked; missing ones are left out, or with strict a KeyError."""
        wanted = [ids] if isinstance(ids, str) else ids
        if not isinstance(wanted, (list, tuple)) or not all(isinstance(i, str) for i in wanted):
            raise TypeError("ids must be a string or a list of strings")
        if not wanted:
            return []
        rows = self._by_ids(list(wanted)).select("id", "json", *(["vector", "code"] if return_vector else []))
        found = {r.id: r for r in rows.collect()}
        if strict and (missing := sorted(set(wanted) - found.keys())):
            raise KeyError(f"{len(missing)} record(s) not found: {missing[:10]}")
        return [{"id": i, "metadata": json.loads(found[i].json)} | ({"vector": self._vector(found[i])} if return_vector else {}) for i in wanted if i in found]

    def contains(self, id: str) -> bool:
        return self.records.filter(F.col("id") == id).limit(1).count() > 0

    __contains__ = contains

    # -- removing and changing -------------------------------------------------------------------------------------

    @exclusive
    def remove_point(self, id: str) -> bool:
        return self._remove(self.records.filter(F.col("id") == id)) > 0

    def _remove(self, rows: DataFrame) -> int:
        self._state, n = self._marked(self._state, rows)
        return n

    @exclusive
    def remove_points(self, ids: list[str]) -> list[str]:
        """The ids that were not there, in the order given, once each."""
        if isinstance(ids, str) or not all(isinstance(i, str) for i in ids):
            raise TypeError("ids must be a list of strings")
        ids = list(dict.fromkeys(ids))
        if not ids:
            return []
        rows = self._by_ids(ids).select("row_id", "id")
        there = {r.id for r in rows.collect()}
        if there:
            self._remove(rows)
        return [i for i in ids if i not in there]

    @exclusive
    def remove_where(self, filter: Mapping) -> int:
        node = parse(filter)
        if always(node):
            raise ValueError("This filter matches every record; use clear() to remove them all")
        return self._remove(self._condition(self.records, filter)[0])

    @exclusive
    def delete(self, ids: Any = None, where: Mapping | None = None) -> int:
        if (ids is None) == (where is None):
            raise ValueError("delete() takes ids or where, and not both")
        if where is not None:
            return self.remove_where(where)
        wanted = [ids] if isinstance(ids, str) else ids
        if not isinstance(wanted, (list, tuple)) or not all(isinstance(i, str) for i in wanted):
            raise TypeError("delete(ids=) expects a string or a list of strings")
        return len(set(wanted)) - len(self.remove_points(list(wanted)))

    @exclusive
    def update_metadata(self, id: str, metadata: dict) -> bool:
        """Replace one record's metadata; its vector and place stay."""
        if not isinstance(metadata, dict):
            raise TypeError("metadata must be a dictionary")
        return self.update_frame(self.spark.createDataFrame([(id, json.dumps(stored(metadata), ensure_ascii=False))], "id string, metadata string")) > 0

    @exclusive
    def update_frame(self, df: DataFrame) -> int:
        """Replace the metadata (JSON text) of every record that df (id, metadata) names; how many there were."""
        rows = self.records
        met = rows.join(df.select("id", F.col("metadata").alias("new")).dropDuplicates(["id"]), "id")
        plain = met.select("row_id", "id", "seq", "vector", "code", "cell", F.col("new").alias("json"))
        base = self._row
        staged, n = self._numbered(plain)
        if not n:
            return 0
        fresh = stored_rows(staged.select((F.col("ordinal") + base).alias("row_id"), "id", "seq", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), self.dim)).alias("vector"), "json"), "l2", self.config.indexed_fields, None, None, True)
        kept = staged.select("id", "vector", "code", "cell")
        joined = fresh.drop("vector", "code", "cell").join(kept, "id").select("row_id", "id", "seq", "vector", "code", "cell", "json", "fields", *(["declared"] if self.config.indexed_fields else []))
        path = self._space.write(self._clustered(joined), "id")
        state, _ = self._marked(self._state, staged.select("row_id"))
        self._state = replace(state, segments=(*state.segments, Segment(path, base, base + n)), count=state.count + n)
        self._row += n
        return n

    @exclusive
    def clear(self) -> int:
        """Remove every record; configuration, index metadata and a trained codebook stay, generated ids are not issued again."""
        n, self._seq = self._state.count, 0
        self._state = replace(self._state, segments=(), dead=(), stranded=0, count=0, cells=None, probes=())
        return n

    @exclusive
    def add_metadata(self, metadata: Mapping[str, str]) -> None:
        self._index_metadata.update({str(k): str(v) for k, v in metadata.items()})

    def get_metadata(self, key: str) -> str | None:
        return self._index_metadata.get(key)

    def get_all_metadata(self) -> dict[str, str]:
        return dict(self._index_metadata)

    # -- maintenance -----------------------------------------------------------------------------------------------

    @exclusive
    def compact(self) -> int:
        """Rewrite the live records without the dead ones; how many those were (0: nothing to do)."""
        n = self._state.stranded
        if n:
            self._state = self._rewritten(self._clustered(self.records, whole=True))
        return n

    def _rewritten(self, rows: DataFrame, **more: Any) -> State:
        """The state with rows, which hold all live records, in one segment."""
        return replace(self._state, segments=(Segment(self._space.write(rows, "id"), 0, self._row),), dead=(), stranded=0, **more)

    @exclusive
    def rebuild(self, m: int | None = None, expected_size: int | None = None, ef_construction: int | None = None) -> int:
        """Fit cells for approximate search and rewrite the records by cell, so that a query's cells are few files; how many records."""
        if m is None and expected_size is None and ef_construction is None:
            raise ValueError("rebuild() takes at least one of m, expected_size and ef_construction")
        if m is not None:
            self.config.m = _whole("m", m, MIN_M, MAX_M)
        if expected_size is not None:
            self.config.expected_size = _whole("expected_size", expected_size, 1, MAX_EXPECTED)
        if ef_construction is not None:
            self.config.ef_construction = _whole("ef_construction", ef_construction, 1, 4096)
        state = self._state
        if not state.count:
            return 0
        rows = self._rows(state)
        sample = rows.orderBy(F.xxhash64("seq")).limit(SAMPLE).select("seq", "vector", "code")
        cells, needed = fit_cells_in_task(sample, cell_count(state.count, self.config.m), self.space, state.codebook)
        shared = self.spark.sparkContext.broadcast((cells, state.codebook))

        def run(batches: Any) -> Any:
            cells, codebook = shared.value
            for batch in batches:
                if batch.num_rows:
                    column = batch.column("vector")
                    x = reconstruct_block(code_rows(batch.column("code")), codebook) if column.null_count else column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    at = batch.schema.get_field_index("cell")
                    yield batch.set_column(at, "cell", pa.array(assign(np.asarray(x, float), cells)[0].astype(np.int32)))

        placed = rows.mapInArrow(run, rows.schema)
        self._state = self._rewritten(placed.repartitionByRange("cell").sortWithinPartitions("cell"), cells=cells, probes=tuple(needed))
        return state.count

    def shrink_to_fit(self) -> int:
        """Nothing is held in memory between calls."""
        return 0

    # -- quantisation ----------------------------------------------------------------------------------------------

    def _maybe_train(self) -> list[str]:
        q = self.config.quantization
        if q is None or self._state.active or self._state.count < q.training_size:
            return []
        try:
            self._train(q)
        except (ValueError, np.linalg.LinAlgError) as e:  # reported, and not counted among the records' errors
            log.warning("Training failed: %s", e)
            return [f"Training failed: {e}"]
        return []

    def _train(self, q: Quantization) -> None:
        """Fit the codebook on the first training_size records by arrival (of more than MOST_TRAINING a seeded draw), then encode all."""
        codebook, calibration = self._state.codebook, self._state.calibration
        if codebook is None:
            sample = self.records.orderBy("seq").limit(q.training_size).select("seq", "vector")
            most = min(q.max_training_vectors or MOST_TRAINING, MOST_TRAINING)
            if most < q.training_size:
                sample = sample.orderBy(F.xxhash64("seq")).limit(most)
            sample = self.spark.read.parquet(self._space.write(sample))
            codebook = train(sample, q.subvectors, q.bits)
            if q.storage_mode == "quantized_with_raw":
                rows = sample.orderBy("seq").limit(10_000).collect()
                calibration = calibrate(self.space, np.array([r.vector for r in rows], np.float32), codebook)
        shared = self.spark.sparkContext.broadcast(codebook)
        keep = q.storage_mode == "quantized_with_raw"

        def run(batches: Any) -> Any:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    batch = batch.set_column(batch.schema.get_field_index("code"), "code", pa.array([c.tobytes() for c in encode_block(x, shared.value)], pa.binary()))
                    if not keep:
                        batch = batch.set_column(batch.schema.get_field_index("vector"), batch.schema.field("vector").with_nullable(True), pa.nulls(batch.num_rows, batch.schema.field("vector").type))
                    yield batch

        rows = self.records
        self._state = self._rewritten(rows.mapInArrow(run, rows.schema), codebook=codebook, calibration=calibration, active=True)

    def has_quantization(self) -> bool:
        return self.config.quantization is not None

    def can_use_quantization(self) -> bool:
        return self._state.codebook is not None

    def is_quantized(self) -> bool:
        return self._state.active

    def is_training_ready(self) -> bool:
        q = self.config.quantization
        return q is not None and (self._state.codebook is not None or self._state.count >= q.training_size)

    def training_vectors_needed(self) -> int:
        q = self.config.quantization
        return 0 if q is None or self._state.codebook is not None else max(0, q.training_size - self._state.count)

    def get_training_progress(self) -> float:
        q = self.config.quantization
        return 0.0 if q is None else 100.0 if self._state.codebook is not None else min(100.0, 100.0 * self._state.count / q.training_size)

    def get_storage_mode(self) -> str:
        q = self.config.quantization
        if q is None:
            return "raw_only"
        if self._state.active:
            return "quantized_active"
        if self._state.codebook is not None:
            return "raw_trained_not_rebuilt"
        return "raw_ready_for_training" if self._state.count >= q.training_size else "raw_collecting_for_training"

    @exclusive
    def rebuild_with_quantization(self) -> bool:
        """Encode every record by the trained codebook, where that has not happened; whether the collection is quantised."""
        if self._state.codebook is not None and not self._state.active:
            self._train(self.config.quantization)
        return self._state.active

    def get_quantization_info(self) -> dict | None:
        q = self.config.quantization
        if q is None:
            return None
        info = {"type": "pq", "subvectors": q.subvectors, "bits": q.bits, "training_size": q.training_size, "storage_mode": q.storage_mode, "is_trained": self._state.codebook is not None, "compression_ratio": 4 * self.dim / q.subvectors}
        if q.max_training_vectors is not None:
            info["max_training_vectors"] = q.max_training_vectors
        if self._state.codebook is not None:
            info |= {"memory_mb": fixed_bytes(self.dim, q.subvectors, q.bits) / 2**20, "total_centroids": q.subvectors * q.centroids, "sdc_memory_mb": 4 * q.subvectors * math.comb(q.centroids, 2) / 2**20}
        return info

    # -- introspection ---------------------------------------------------------------------------------------------

    def get_stats(self) -> dict[str, str]:
        """Fixed keys; ``index_type`` is cells once rebuild() has made them, else exact, and ``graph_nodes`` counts stored rows, dead ones too."""
        state, q = self._state, self.config.quantization
        n, trained = state.count, state.codebook is not None
        raw = 0 if state.active and q.storage_mode == "quantized_only" else n
        codes = n if state.active else 0
        mb = lambda b: f"{b / 2**20:.2f}"
        k = q.centroids if q else 0
        book = 4 * k * self.dim if trained else 0
        table = 4 * q.subvectors * math.comb(k, 2) if trained else 0
        cells = 0 if state.cells is None else 8 * state.cells.size
        parts = [cells, 4 * raw * self.dim, codes * (q.subvectors if q else 0), book, table, 0]
        out = {
            "dimension": self.dim, "space": self.space, "m": self.m, "ef_construction": self.ef_construction, "expected_size": self.expected_size, "index_type": "exact" if state.cells is None else "cells",
            "total_vectors": n, "graph_nodes": n + state.stranded, "stranded_graph_nodes": state.stranded, "raw_vectors_stored": raw, "quantized_codes_stored": codes,
            "storage_mode": q.storage_mode if q else "raw_only", "storage_mode_description": self.get_storage_mode(), "storage_strategy": "parquet_segments", "thread_safety": "immutable_snapshots",
            "graph_memory_mb": mb(parts[0]), "raw_vectors_memory_mb": mb(parts[1]), "quantized_codes_memory_mb": mb(parts[2]), "codebook_memory_mb": mb(parts[3]), "sdc_table_memory_mb": mb(parts[4]), "index_bookkeeping_memory_mb": mb(parts[5]), "total_memory_mb": mb(sum(parts)),
            "quantization_type": "pq" if q else "none", "segments": len(state.segments),
        }
        if q:
            out |= {"raw_vectors_retained": "all_records" if q.storage_mode == "quantized_with_raw" else "none_once_trained", "quantization_active": str(state.active).lower(), "quantization_trained": str(trained).lower(), "quantization_compression_ratio": f"{4 * self.dim / q.subvectors:.1f}x", "quantization_training_size": q.training_size, "training_progress": f"{self.get_training_progress():.1f}", "training_vectors_needed": self.training_vectors_needed(), "training_threshold_reached": str(n >= q.training_size).lower(), "rerank_default_fetch": fetch_count(10, n, None, state.calibration), "rerank_calibrated": str(state.calibration is not None).lower()}
        if c := state.calibration:
            out |= {"rerank_calibration_fetch": c.fetch, "rerank_calibration_records": c.records, "rerank_calibration_queries": c.queries, "rerank_calibration_target_recall": 0.99, "rerank_calibration_exponent": f"{c.exponent:.3f}", "rerank_calibration_fit_fetches": ",".join(map(str, c.fit_fetches)), "rerank_calibration_pages": "1,10,100", "rerank_calibration_page_fetches": ",".join(map(str, c.page_fetches)), "rerank_calibration_page_exponent": f"{c.page_exponent:.3f}", "rerank_calibration_ms": c.millis}
        return {k: str(v) for k, v in out.items()}

    def info(self) -> str:
        state, q = self._state, self.config.quantization
        mode = f", quantization=pq({q.subvectors}x{q.bits}, {self.get_storage_mode()})" if q else ""
        index = "exact" if state.cells is None else f"cells({len(state.cells)})"
        return f"Collection(dim={self.dim}, space={self.space}, m={self.m}, ef_construction={self.ef_construction}, expected_size={self.expected_size}, vectors={state.count}, index={index}{mode})"

    __repr__ = info

    def get_performance_info(self) -> dict[str, str]:
        """What searches and changes cost, under fixed keys."""
        out = {"search_speedup_expected": "a block of queries costs one pass over the records", "search_bottleneck": "one Spark job for each call", "benefits": "distributed scan, running top-k in every task, filters below the scan", "insertion_path": "one Parquet segment for each add; removals are marked and sent to the scan"}
        if q := self.config.quantization:
            out |= {"quantization_compression": f"{4 * self.dim / q.subvectors:.1f}x", "quantization_accuracy_impact": "lost recall comes back where candidates are rescored" if q.storage_mode == "quantized_with_raw" else "lost recall stays, as raw vectors are not kept"}
        return out

    def benchmark_concurrent_reads(self, query_count: int = 20, max_threads: int | None = None) -> dict[str, float]:
        """Seconds and queries a second of single searches, one after another and from so many threads at once."""
        rng = np.random.default_rng(0)
        queries = rng.standard_normal((query_count, self.dim)).astype(np.float32)
        threads = max(1, min(max_threads or query_count, query_count, os.cpu_count() or 1))
        began = time.perf_counter()
        for q in queries:
            self.search(q, top_k=10)
        one = time.perf_counter() - began
        began = time.perf_counter()
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(lambda q: self.search(q, top_k=10), queries))
        many = time.perf_counter() - began
        return {"sequential_time": one, "sequential_qps": query_count / one, "parallel_time": many, "parallel_qps": query_count / many, "speedup": one / many, "threads_used": float(threads)}

    # -- persistence -----------------------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Write the live records, the codebook and the state; an earlier save at the path is replaced whole."""
        with self._lock:
            state, q = self._state, self.config.quantization
            manifest = {
                "config": asdict(self.config), "count": state.count, "seq": self._seq, "row": self._row, "generated": self._generated, "index_metadata": dict(self._index_metadata), "active": state.active,
                "calibration": state.calibration.to_json() if state.calibration else None, "has_quantization": q is not None, "probes": list(state.probes),
            }
        tables = {"records": self._rows(state)}
        for name, array in (("codebook", state.codebook), ("cells", state.cells)):
            if array is not None:
                manifest[f"{name}_shape"] = list(array.shape)
                tables[name] = self.spark.createDataFrame(pa.table({"place": pa.array(range(array.reshape(-1, array.shape[-1]).shape[0]), pa.int64()), "numbers": pa.array(array.reshape(-1, array.shape[-1]).tolist(), pa.list_(pa.float64()))})).coalesce(1)
        storage.save(self.spark, path, tables, manifest, rows_a_file=max(1_000, FILE_BYTES // (4 * self.dim + 1_024)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        """A saved collection, once its files, its records and its numbers have been checked; raises what is wrong with them."""
        manifest, tables = storage.load(spark, path)
        wrong = lambda what: ValueError(f"{path}: {what}")
        try:
            given = manifest["config"]
            q = given.pop("quantization")
            config = check(**{k: given[k] for k in ("dim", "space", "m", "expected_size", "indexed_fields")}, ef_construction=max(given["ef_construction"], 1))
            config.quantization = Quantization(**q) if q else None
            count, seq, row, generated, active = (manifest[k] for k in ("count", "seq", "row", "generated", "active"))
            index_metadata, calibration = manifest["index_metadata"], Calibration(**manifest["calibration"]) if manifest["calibration"] else None
            shapes = {name: tuple(manifest[f"{name}_shape"]) for name in ("codebook", "cells") if name in tables}
        except (KeyError, TypeError, AttributeError) as e:
            raise wrong(f"the manifest lacks something or holds another type ({e})") from e
        if q and config.space == "dot":
            raise wrong("a collection in the dot space cannot be quantized")
        if any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in (count, seq, row, generated)) or count > row:
            raise wrong("the manifest's counters are not whole numbers that fit each other")
        if not isinstance(active, bool) or active and (config.quantization is None or "codebook" not in tables):
            raise wrong("the collection is said to be quantized and has no codebook")
        self = cls(spark, config)
        arrays: dict[str, np.ndarray | None] = {"codebook": None, "cells": None}
        for name, shape in shapes.items():
            values = np.array([r.numbers for r in tables[name].orderBy("place").limit(MOST_NUMBERS).collect()], float)
            fits = shape == (config.quantization.subvectors, config.quantization.centroids, config.dim // config.quantization.subvectors) if name == "codebook" and config.quantization else len(shape) == 2 and shape[1:] == (config.dim,)
            if not fits or values.size != math.prod(shape) or not np.isfinite(values).all():
                raise wrong(f"the {name} has another shape than its collection, or numbers that are not finite")
            arrays[name] = values.reshape(shape).astype(np.float32) if name == "codebook" else values.reshape(shape)
        needed = manifest.get("probes", [])
        if arrays["cells"] is not None and not (isinstance(needed, list) and len(needed) in (0, len(PAGES)) and all(isinstance(n, int) and 0 < n <= len(arrays["cells"]) for n in needed)):
            raise wrong("the probes do not fit the cells")
        if arrays["codebook"] is not None and not arrays["codebook"].any():
            raise wrong("the codebook is all zeros")
        # A later save at the same path replaces that folder, so a loaded collection works on its own copy; copying checks every record.
        rows = self.spark.read.schema(row_schema(config.indexed_fields)).parquet(f"{path.rstrip('/')}/records")
        copy = self._space.write(rows.withColumn("vector", _checked(rows, config, active, arrays["cells"])), "id")
        found = spark.read.parquet(copy).agg(F.count("*").alias("n"), F.count("id").alias("named"), F.count(F.when(F.col("vector").isNull() & F.col("code").isNull(), 1)).alias("empty"), F.coalesce(F.max("row_id"), F.lit(-1)).alias("row"), F.coalesce(F.max("seq"), F.lit(0)).alias("seq")).first()
        if (found.n, found.named, found.empty) != (count, count, 0):
            raise wrong(f"the records do not fit the manifest ({found.n} rows, {count} expected, {found.n - found.named} without an id, {found.empty} without a vector)")
        if found.row >= max(row, 1) or found.seq > max(seq, 1):
            raise wrong("a record's number lies beyond the manifest's counters")
        self._state = State((Segment(copy, 0, row),) if count else (), (), 0, count, arrays["codebook"], active, calibration, arrays["cells"], tuple(needed))
        self._seq, self._row, self._generated, self._index_metadata = seq, row, generated, index_metadata
        return self


def _checked(rows: DataFrame, config: Config, active: bool, cells: np.ndarray | None) -> Column:
    """The vectors of rows, where reading them raises for one that is not a vector of the collection, or for a code or cell that cannot be."""
    vector, code, cell = rows["vector"], rows["code"], rows["cell"]
    wrong = F.when(vector.isNotNull(), vector_error(vector, config.dim))
    if active:
        wrong = F.coalesce(wrong, F.when(code.isNull() | (F.length(code) != config.quantization.subvectors), F.lit("a code of another length")))
    if cells is not None:
        wrong = F.coalesce(wrong, F.when((cell < 0) | (cell >= len(cells)), F.lit("a cell that is not there")))
    return F.when(wrong.isNull(), vector).otherwise(F.raise_error(F.concat(F.lit("The records are damaged: "), wrong)).cast("array<float>"))


HNSWIndex = Collection
