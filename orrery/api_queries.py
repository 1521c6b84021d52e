"""Registered queries about the interface itself: what calls answer, refuse and leave behind, as tables that SQL states by rule or case."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import VectorDatabase
from .operators.ivf import cell_count
from .operators.rerank import Calibration, fetch_count
from .plans.config import default_subvectors, default_training_size
from .plans.workspace import Workspace
from .queries import _customers, _left, query
from .sources.storage import Folder


def outcome(call: Callable[[], Any]) -> str:
    """ok, or the name of the error that a call raises."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            call()
        except (ValueError, TypeError, KeyError, RuntimeError, FileNotFoundError) as e:
            return type(e).__name__
    return "ok"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of stated cases."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in r) + ')' for r in rows)}) v({columns})"


def _outcomes(name: str, cases: dict[str, tuple[str, Callable[[SparkSession], Any]]]) -> None:
    """A query of what each case's call gives, beside SQL of what it must give."""
    sql = values("what, outcome", [(what, expected) for what, (expected, _) in cases.items()])
    query(name, sql)(lambda spark, d: spark.createDataFrame([(what, outcome(lambda call=call: call(spark))) for what, (_, call) in cases.items()], "what string, outcome string"))


def _create(spark: SparkSession, **parameters: Any) -> Any:
    return VectorDatabase(spark).create(**parameters)


_outcomes("create_checks", {
    "plain": ("ok", lambda s: _create(s, dim=4)),
    "space in capitals": ("ok", lambda s: _create(s, dim=4, space="L1")),
    "no dim": ("TypeError", lambda s: _create(s)),
    "dim 0": ("RuntimeError", lambda s: _create(s, dim=0)),
    "dim too large": ("RuntimeError", lambda s: _create(s, dim=65_537)),
    "largest dim": ("ok", lambda s: _create(s, dim=65_536)),
    "dim a text": ("TypeError", lambda s: _create(s, dim="4")),
    "unknown space": ("RuntimeError", lambda s: _create(s, dim=4, space="hamming")),
    "m 1": ("RuntimeError", lambda s: _create(s, dim=4, m=1)),
    "m 256": ("ok", lambda s: _create(s, dim=4, m=256, ef_construction=600)),
    "m 257": ("RuntimeError", lambda s: _create(s, dim=4, m=257)),
    "ef_construction 0": ("RuntimeError", lambda s: _create(s, dim=4, ef_construction=0)),
    "ef_construction too large": ("RuntimeError", lambda s: _create(s, dim=4, ef_construction=4_097)),
    "expected_size 0": ("RuntimeError", lambda s: _create(s, dim=4, expected_size=0)),
    "unknown type": ("ValueError", lambda s: _create(s, dim=4, index_type="flat")),
    "unknown argument": ("TypeError", lambda s: _create(s, dim=4, colour="red")),
    "fields a text": ("ValueError", lambda s: _create(s, dim=4, indexed_fields="ab")),
    "33 fields": ("ValueError", lambda s: _create(s, dim=4, indexed_fields=[f"f{i}" for i in range(33)])),
    "32 fields": ("ok", lambda s: _create(s, dim=4, indexed_fields=[f"f{i}" for i in range(32)])),
    "a field twice": ("ValueError", lambda s: _create(s, dim=4, indexed_fields=["a", "a"])),
    "a group as a field": ("ValueError", lambda s: _create(s, dim=4, indexed_fields=["$or"])),
    "an empty field": ("ValueError", lambda s: _create(s, dim=4, indexed_fields=[""])),
})


@query("create_defaults", "SELECT e AS expected_size, CASE WHEN e <= 25000 THEN 16 ELSE 32 END AS m, 200 AS ef_construction, 'cosine' AS space, 0 AS fields FROM (VALUES (1), (10000), (25000), (25001), (90000)) v(e)")
def q_defaults(spark: SparkSession, d: str) -> DataFrame:
    made = [_create(spark, dim=8, expected_size=e) for e in (1, 10_000, 25_000, 25_001, 90_000)]
    return spark.createDataFrame([(c.expected_size, c.m, c.ef_construction, c.space, len(c.indexed_fields)) for c in made], "expected_size int, m int, ef_construction int, space string, fields int")


@query("selection_warnings", "SELECT m, ef, ef <= 2 * m AS warned FROM range(2, 257, 18) r(m), (VALUES (20), (200), (400)) v(ef)")
def q_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for m in range(2, 257, 18):
        for ef in (20, 200, 400):
            with warnings.catch_warnings(record=True) as seen:
                warnings.simplefilter("always")
                _create(spark, dim=4, m=m, ef_construction=ef)
            rows.append((m, ef, any(issubclass(w.category, UserWarning) for w in seen)))
    return spark.createDataFrame(rows, "m long, ef int, warned boolean")


#: Every accepted form of add(): the call's argument, and the records (id, metadata as JSON) that it leaves.
_FORMS: dict[str, tuple[Any, list[tuple[str, str]]]] = {
    "one object": ({"id": "a", "values": [1, 0], "metadata": {"n": 1}}, [("a", '{"n": 1}')]),
    "one object with vector": ({"id": "a", "vector": [1, 0]}, [("a", "{}")]),
    "one object without id": ({"values": [1, 0], "metadata": {"t": [1, "x", None]}}, [("vec_1", '{"t": [1, "x", null]}')]),
    "list of objects": ([{"id": "a", "values": [1, 0], "metadata": {"n": 1.5}}, {"id": "b", "vector": [0, 1], "metadata": "note"}, {"vector": [1, 1], "metadata": 5}], [("a", '{"n": 1.5}'), ("b", '{"text": "note"}'), ("vec_1", '{"value": 5}')]),
    "parallel lists": ({"ids": ["a", "b"], "embeddings": [[1, 0], [0, 1]], "metadatas": [{"n": 1}, {}]}, [("a", '{"n": 1}'), ("b", "{}")]),
    "parallel lists, values": ({"ids": ["a", "b"], "values": [[1, 0], [0, 1]]}, [("a", "{}"), ("b", "{}")]),
    "parallel NumPy": ({"ids": ["a", "b"], "vectors": np.eye(2, dtype=np.float32), "metadatas": [{"n": True}, {"n": None}]}, [("a", '{"n": true}'), ("b", '{"n": null}')]),
    "matrix": (np.eye(2), [("vec_1", "{}"), ("vec_2", "{}")]),
    "list of lists": ([[1.0, 0.0], [0.0, 1.0]], [("vec_1", "{}"), ("vec_2", "{}")]),
    "one vector": ([1.0, 0.0], [("vec_1", "{}")]),
    "an id twice": ({"ids": ["a", "a"], "vectors": [[1, 0], [0, 1]], "metadatas": [{"n": 1}, {"n": 2}]}, [("a", '{"n": 1}')]),
}


@query("add_forms", values("form, id, metadata", [(form, i, m) for form, (_, left) in _FORMS.items() for i, m in left]))
def q_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for form, (data, _) in _FORMS.items():
        index = _create(spark, dim=2, space="l2")
        index.add(data)
        rows += [(form, i, json.dumps(m)) for i, m in index.list(10)]
    return spark.createDataFrame(rows, "form string, id string, metadata string")


#: Records that add() refuses one by one: inserted and errors.
_BAD: dict[str, tuple[Any, int, int]] = {
    "too short": ([{"id": "a", "values": [1]}, {"id": "b", "values": [1, 2]}], 1, 1),
    "not finite": (np.array([[np.nan, 1], [1, np.inf], [1, 1]]), 1, 2),
    "no vector": ([{"id": "a"}, {"id": "b", "values": [1, 2]}], 1, 1),
    "an id twice": ({"ids": ["a", "a", "b"], "vectors": [[1, 2], [3, 4], [5, 6]]}, 2, 1),
    "no vectors at all": ({"ids": ["a"], "other": 1}, 0, 1),
    "nothing": ([], 0, 0),
    "matrix of another width": (np.ones((2, 3)), 0, 1),
}


@query("add_errors", values("what, inserted, errors", [(what, n, bad) for what, (_, n, bad) in _BAD.items()]))
def q_bad(spark: SparkSession, d: str) -> DataFrame:
    found = [(what, _create(spark, dim=2).add(data)) for what, (data, _, _) in _BAD.items()]
    return spark.createDataFrame([(what, r.total_inserted, r.total_errors) for what, r in found], "what string, inserted int, errors int")


_outcomes("add_checks", {
    "nothing": ("ValueError", lambda s: _create(s, dim=2).add(None)),
    "a number": ("TypeError", lambda s: _create(s, dim=2).add(5)),
    "no vector": ("ValueError", lambda s: _create(s, dim=2).add({"id": "a"})),
    "fewer vectors than ids": ("ValueError", lambda s: _create(s, dim=2).add({"ids": ["a", "b"], "vectors": [[1, 2]]})),
    "fewer metadatas": ("ValueError", lambda s: _create(s, dim=2).add({"vectors": [[1, 2], [3, 4]], "metadatas": [{}]})),
    "ids a text": ("TypeError", lambda s: _create(s, dim=2).add({"ids": "ab", "vectors": [[1, 2], [1, 2]]})),
})


@query("generated_ids", "SELECT 'vec_' || n AS id FROM range(4, 9) r(n) UNION ALL SELECT 'vec_' || (8 + row_number() OVER ()) FROM customer WHERE c_custkey % 30 = 0")
def q_generated(spark: SparkSession, d: str) -> DataFrame:
    """Generated ids go on where they were, after clear() and in frames without ids."""
    index = _create(spark, dim=1, space="l2")
    index.add([[1.0], [2.0], [3.0]])
    index.clear()
    index.add([[1.0], [2.0], [3.0], [4.0], [5.0]])
    index.add_frame(spark.read.parquet(f"{d}/customer.parquet").filter("c_custkey % 30 = 0").select(F.array(F.lit(1.0)).alias("vector")))
    return index.frame().select("id")


def _few(spark: SparkSession, **more: Any) -> Any:
    index = _create(spark, dim=2, space="l2", **more)
    index.add({"ids": ["a", "b", "c"], "vectors": [[1, 0], [0, 1], [2, 2]], "metadatas": [{"n": 1}, {"n": 2}, {}]})
    return index


_outcomes("search_checks", {
    "plain": ("ok", lambda s: _few(s).search([1, 0])),
    "empty": ("ValueError", lambda s: _few(s).search([])),
    "empty batch": ("ValueError", lambda s: _few(s).search(np.zeros((0, 2)))),
    "too short": ("ValueError", lambda s: _few(s).search([1])),
    "not finite": ("ValueError", lambda s: _few(s).search([1, float("nan")])),
    "one of a batch too long": ("ValueError", lambda s: _few(s).search([[1, 0], [1, 0, 0]])),
    "a text": ("ValueError", lambda s: _few(s).search("ab")),
    "longest page": ("ok", lambda s: _few(s).search([1, 0], top_k=65_536)),
    "page too long": ("ValueError", lambda s: _few(s).search([1, 0], top_k=65_537)),
    "negative page": ("ValueError", lambda s: _few(s).search([1, 0], top_k=-1)),
    "ef_search 0": ("ValueError", lambda s: _few(s).search([1, 0], ef_search=0)),
    "ef_search too large": ("ValueError", lambda s: _few(s).search([1, 0], ef_search=131_073)),
    "page not a number": ("TypeError", lambda s: _few(s).search([1, 0], top_k="5")),
})


def _deep(levels: int) -> dict:
    return {"n": 1} if levels == 0 else {"$and": [_deep(levels - 1)]}


_outcomes("filter_checks", {
    "ten levels": ("ok", lambda s: _few(s).count(_deep(10))),
    "eleven levels": ("ValueError", lambda s: _few(s).count(_deep(11))),
    "unknown operator": ("ValueError", lambda s: _few(s).count({"n": {"near": 1}})),
    "a group of one mapping": ("ValueError", lambda s: _few(s).count({"$or": {"n": 1}})),
    "a negation of a list": ("ValueError", lambda s: _few(s).count({"$not": [{"n": 1}]})),
    "a branch that is no mapping": ("ValueError", lambda s: _few(s).count({"$and": [1]})),
    "presence of a number": ("ValueError", lambda s: _few(s).count({"n": {"exists": 1}})),
    "presence": ("ok", lambda s: _few(s).count({"n": {"is_null": False}})),
    "no mapping": ("TypeError", lambda s: _few(s).count([1])),
    "remove by a filter of every record": ("ValueError", lambda s: _few(s).remove_where({})),
    "remove by another such": ("ValueError", lambda s: _few(s).remove_where({"$not": {"$or": []}})),
    "delete by nothing": ("ValueError", lambda s: _few(s).delete()),
    "delete by both": ("ValueError", lambda s: _few(s).delete(ids="a", where={"n": 1})),
    "list by both": ("ValueError", lambda s: _few(s).list(1, offset=1, after="a")),
    "list after nobody": ("KeyError", lambda s: _few(s).list(1, after="z")),
    "strict records": ("KeyError", lambda s: _few(s).get_records(["a", "z"], strict=True)),
    "rebuild by nothing": ("ValueError", lambda s: _few(s).rebuild()),
})


@query("default_subvectors", """
WITH t AS (SELECT dim, least(greatest(round_even(dim / 32.0, 0), 8), 192) AS target FROM range(1, 1025) r(dim)),
c AS (SELECT dim, d, abs(d - target) AS off, d < 8 AS small FROM t, range(1, 193) s(d) WHERE dim % d = 0)
SELECT dim, d::INTEGER AS subvectors FROM c QUALIFY row_number() OVER (PARTITION BY dim ORDER BY small, off, d DESC) = 1""")
def q_subvectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(dim, default_subvectors(dim)) for dim in range(1, 1025)], "dim long, subvectors int")


@query("default_training_size", "SELECT bits::INTEGER AS bits, least(greatest(20 * 2 ** bits, 10000), 200000)::BIGINT AS size FROM range(1, 9) r(bits)")
def q_training_size(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(b, default_training_size(b)) for b in range(1, 9)], "bits int, size long")


def _quantized(spark: SparkSession, dim: int = 8, space: str = "cosine", **config: Any) -> Any:
    return _create(spark, dim=dim, space=space, quantization_config={"type": "pq", **config})


_outcomes("quantization_checks", {
    "defaults": ("ok", lambda s: _quantized(s)),
    "another type": ("ValueError", lambda s: _create(s, dim=8, quantization_config={"type": "scalar"})),
    "no mapping": ("ValueError", lambda s: _create(s, dim=8, quantization_config=[1])),
    "dot": ("ValueError", lambda s: _quantized(s, space="dot")),
    "no divisor": ("ValueError", lambda s: _quantized(s, subvectors=3)),
    "more subvectors than dimensions": ("ValueError", lambda s: _quantized(s, subvectors=16)),
    "no bits": ("ValueError", lambda s: _quantized(s, bits=0)),
    "nine bits": ("ValueError", lambda s: _quantized(s, bits=9)),
    "small training": ("ValueError", lambda s: _quantized(s, training_size=999)),
    "fewer vectors than training": ("ValueError", lambda s: _quantized(s, training_size=2_000, max_training_vectors=1_000)),
    "unknown mode": ("ValueError", lambda s: _quantized(s, storage_mode="raw")),
    "raw kept": ("ok", lambda s: _quantized(s, storage_mode="quantized_with_raw")),
})


@query("quantization_states", """
WITH n AS (SELECT 'empty' AS stage, 0 AS n UNION ALL SELECT 'before', 600 UNION ALL SELECT 'after', 1000)
SELECT stage, n AS records, n >= 1000 AS trained, greatest(1000 - n, 0) AS needed, least(100.0, n / 10.0)::DOUBLE AS progress, CASE WHEN n >= 1000 THEN 'quantized_active' ELSE 'raw_collecting_for_training' END AS mode, CASE WHEN n >= 1000 THEN n ELSE 0 END AS codes, CASE WHEN n >= 1000 THEN 0 ELSE n END AS raw FROM n
UNION ALL SELECT 'cleared', 0, true, 0, 100.0, 'quantized_active', 0, 0""")
def q_states(spark: SparkSession, d: str) -> DataFrame:
    """The states of a quantised collection that drops raw vectors: collecting, trained at 1,000 records, cleared."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        index = _quantized(spark, 4, "l2", subvectors=2, bits=2, training_size=1_000)
    x = np.random.default_rng(1).standard_normal((1_000, 4)).astype(np.float32)
    rows = []

    def note(stage: str) -> None:
        s = index.get_stats()
        rows.append((stage, len(index), index.is_quantized() and index.can_use_quantization(), index.training_vectors_needed(), index.get_training_progress(), index.get_storage_mode(), int(s["quantized_codes_stored"]), int(s["raw_vectors_stored"])))

    note("empty")
    index.add(x[:600])
    note("before")
    index.add(x[600:])
    note("after")
    index.clear()
    note("cleared")
    return spark.createDataFrame(rows, "stage string, records int, trained boolean, needed int, progress double, mode string, codes int, raw int")


@query("fetch_rules", """
WITH g AS (SELECT k, n, f FROM (VALUES (1), (10), (50), (300)) a(k), (VALUES (5), (900), (20000), (5000000)) b(n), (VALUES (NULL), (1), (5)) c(f))
SELECT k, n, f AS factor, CASE WHEN f IS NULL THEN least(greatest(n // 50, greatest(250, 5 * k)), greatest(n, k)) ELSE least(k * f, greatest(n, k)) END AS fetch,
  least(least(greatest(floor(1.75 * 120 * (n / 10000.0) ** 0.6 + 0.5), 250), greatest(n // 4, 250)), greatest(n, 10))::BIGINT AS calibrated FROM g""")
def q_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by a caller's factor, by the fixed rule, and (for a page of 10) by a calibration of 120 at 10,000 records that grows by the power 0.6."""
    c = Calibration(120, 10_000, 512, 0.6, [60, 80, 100, 120], [40, 120, 400])
    rows = [(k, n, f, fetch_count(k, n, f, None), fetch_count(10, n, None, c)) for k in (1, 10, 50, 300) for n in (5, 900, 20_000, 5_000_000) for f in (None, 1, 5)]
    return spark.createDataFrame(rows, "k int, n int, factor int, fetch int, calibrated long")


@query("cell_counts", "SELECT n, m, greatest(1, least(least(floor(sqrt(greatest(1, n)) * m / 16), CASE WHEN n // 20 = 0 THEN 1 ELSE n // 20 END), 4096))::INTEGER AS cells FROM (VALUES (1), (19), (500), (51282), (90000000)) a(n), (VALUES (2), (16), (64)) b(m)")
def q_cells(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, m, cell_count(n, m)) for n in (1, 19, 500, 51_282, 90_000_000) for m in (2, 16, 64)], "n int, m int, cells int")


_SELECTIONS = {
    "exact": ({"a": 1, "$not": {"b": {"gt": 2}}}, "exact", "a,b", ""),
    "narrowed": ({"a": 1, "x": 2}, "narrowed", "a", "x"),
    "narrowed branches": ({"$or": [{"a": 1, "x": 2}, {"b": 3, "y": 4}]}, "narrowed", "a,b", "x,y"),
    "whole": ({"$or": [{"a": 1}, {"x": 2}]}, "whole", "a", "x"),
    "whole by negation": ({"$not": {"a": 1, "x": 2}}, "whole", "a", "x"),
    "undeclared": ({"x": 1}, "whole", "", "x"),
    "no filter": ({}, "exact", "", ""),
}


@query("filter_selections", values("what, selection, declared, undeclared", [(what, *rest) for what, (_, *rest) in _SELECTIONS.items()]))
def q_selections(spark: SparkSession, d: str) -> DataFrame:
    index = _create(spark, dim=1, indexed_fields=["a", "b"])
    found = [(what, index.explain_filter(wanted)) for what, (wanted, *_) in _SELECTIONS.items()]
    return spark.createDataFrame([(what, e["selection"], ",".join(e["declared"]), ",".join(e["undeclared"])) for what, e in found], "what string, selection string, declared string, undeclared string")


@query("collection_counts", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 = 0) AS gone FROM customer)
SELECT (n - gone)::BIGINT AS total_vectors, n::BIGINT AS graph_nodes, gone::BIGINT AS stranded_graph_nodes, (n - gone)::BIGINT AS raw_vectors_stored, 0::BIGINT AS quantized_codes_stored, 2::BIGINT AS dimension, (n - gone)::BIGINT AS length, (n - gone)::BIGINT AS counted FROM c""")
def q_counts(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    index.remove_points([str(k) for k in range(0, len(index), 10)])
    stats = index.get_stats()
    names = ["total_vectors", "graph_nodes", "stranded_graph_nodes", "raw_vectors_stored", "quantized_codes_stored", "dimension"]
    return spark.createDataFrame([(*(int(stats[n]) for n in names), len(index), index.count())], ", ".join(f"{n} long" for n in [*names, "length", "counted"]))


#: Metadata values as they are given and as they come back (JSON text).
_VALUES = [("whole", 7, "7"), ("fraction", 2.5, "2.5"), ("text", "é x", '"é x"'), ("truth", True, "true"), ("nothing", None, "null"), ("list", [1, "a", None], '[1, "a", null]'), ("mapping", {"k": {"z": 1}}, '{"k": {"z": 1}}'), ("pair", (1, 2), '"(1, 2)"'), ("not a number", float("nan"), '"NaN"'), ("infinite", float("-inf"), '"-inf"')]


@query("metadata_values", values("name, stored", [(name, text) for name, _, text in _VALUES]))
def q_metadata(spark: SparkSession, d: str) -> DataFrame:
    index = _create(spark, dim=1, space="l2")
    index.add({"id": "a", "vector": [1], "metadata": {name: value for name, value, _ in _VALUES}})
    return spark.createDataFrame([(name, json.dumps(value, ensure_ascii=False)) for name, value in index.get_records("a")[0]["metadata"].items()], "name string, stored string")


@query("index_metadata", values("name, value", [("owner", "you"), ("rows", "5")]) + " UNION ALL SELECT 'records', count(*)::VARCHAR FROM customer")
def q_index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What was noted on a collection, read from its copy that was saved and loaded; and the saved manifest's count."""
    index, path = _customers(spark, d), Workspace(spark).path()
    index.add_metadata({"owner": "me", "rows": 5})
    index.add_metadata({"owner": "you"})
    index.save(path)
    db = VectorDatabase(spark)
    again = db.load(path)
    assert again.get_metadata("owner") == "you" and again.get_metadata("none") is None
    return spark.createDataFrame([*again.get_all_metadata().items(), ("records", str(db.get_index_info(path)["count"]))], "name string, value string")


def _saved(spark: SparkSession, change: Callable[[Folder, str], None]) -> Any:
    """A small collection saved, its folder changed, and loaded."""
    path, folder = Workspace(spark).path(), Folder(spark)
    _few(spark).save(path)
    change(folder, path)
    return VectorDatabase(spark).load(path)


def _manifest(**more: Any) -> Callable[[Folder, str], None]:
    def change(folder: Folder, path: str) -> None:
        known = json.loads(folder.read(f"{path}/manifest.json", 1 << 20))
        folder.write(f"{path}/manifest.json", json.dumps(known | more))

    return change


_outcomes("load_checks", {
    "as saved": ("ok", lambda s: _saved(s, lambda f, p: None)),
    "nothing there": ("FileNotFoundError", lambda s: VectorDatabase(s).load(Workspace(s).path())),
    "no manifest": ("FileNotFoundError", lambda s: _saved(s, lambda f, p: f.delete(f"{p}/manifest.json"))),
    "manifest no JSON": ("ValueError", lambda s: _saved(s, lambda f, p: f.write(f"{p}/manifest.json", "{"))),
    "another version": ("ValueError", lambda s: _saved(s, _manifest(format_version="2.0.0"))),
    "a later minor version": ("ok", lambda s: _saved(s, _manifest(format_version="1.9.0"))),
    "no records": ("FileNotFoundError", lambda s: _saved(s, lambda f, p: f.delete(f"{p}/records"))),
    "another count": ("ValueError", lambda s: _saved(s, _manifest(count=4, row=9))),
    "negative count": ("ValueError", lambda s: _saved(s, _manifest(count=-3))),
    "counters too small": ("ValueError", lambda s: _saved(s, _manifest(seq=1))),
    "a table outside": ("ValueError", lambda s: _saved(s, _manifest(tables=["records", "../x"]))),
    "broken off between its renames": ("ok", lambda s: _saved(s, lambda f, p: f.rename(p, f"{p}.old"))),
})


@query("concurrent_changes", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, c_mktsegment AS segment FROM customer WHERE c_custkey NOT BETWEEN 1 AND 6 UNION ALL SELECT -n, n, 'NEW' FROM range(1, 7) r(n)")
def q_concurrent(spark: SparkSession, d: str) -> DataFrame:
    """Six threads that add a record and remove another, at once."""
    from concurrent.futures import ThreadPoolExecutor

    index = _customers(spark, d)

    def change(n: int) -> None:
        index.add({"id": str(-n), "vector": [0, n], "metadata": {"c_mktsegment": "NEW"}})
        index.remove_point(str(n))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(change, range(1, 7)))
    return _left(index)


_PAGE = """
WITH q AS (SELECT c_nationkey::FLOAT::DOUBLE AS a, c_acctbal::FLOAT::DOUBLE AS b FROM customer WHERE c_custkey = 40),
s AS (SELECT c_custkey::VARCHAR AS id, round(sqrt((c_nationkey::FLOAT::DOUBLE - a) ** 2 + (c_acctbal::FLOAT::DOUBLE - b) ** 2), 4) AS score FROM customer, q WHERE {})
SELECT id, score FROM s ORDER BY score, id LIMIT 10"""


@query("collection_topk_cells", _PAGE.format("c_mktsegment <> 'BUILDING'"))
def q_topk_cells(spark: SparkSession, d: str) -> DataFrame:
    """A filtered search of a collection with cells that reads as many as hold all records but one."""
    index = _customers(spark, d, indexed_fields=["c_mktsegment"])
    index.rebuild(m=16)
    asked = index.get_records("40")[0]["vector"]
    return index.search_matrix(asked[None], {"c_mktsegment": {"ne": "BUILDING"}}, 10, ef_search=len(index) - 1, digits=4).select("id", "score")


@query("collection_topk_rescored", _PAGE.format("TRUE"))
def q_topk_rescored(spark: SparkSession, d: str) -> DataFrame:
    """A quantised collection that keeps raw vectors, asked to rescore as many candidates as it has records."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        index = _customers(spark, d, quantization_config={"type": "pq", "subvectors": 2, "bits": 4, "training_size": 1_000, "storage_mode": "quantized_with_raw"})
    asked = index.get_records("40")[0]["vector"]
    return index.search_matrix(asked[None], None, 10, rerank=len(index), digits=4).select("id", "score")
