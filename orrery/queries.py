"""Registered queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.filters import bound_condition, parse, where
from .functions.metrics import SPACES, norm, normalise, vector_error
from .functions.values import json_field
from .operators.graph import neighbour_lists
from .operators.ivf import assign, calibrate_probes, cell_count, fit_cells, nearest_cells
from .operators.quantize import AsymmetricDistance, encode, encode_block, reconstruct, symmetric_distance, train
from .operators.rerank import Rescored, calibrate, code_bounds, fetch_count
from .operators.topk import Exact, Probed, native_topk, scored_topk, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return rows.filter(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("vector").alias("query"))


def hashed(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows, drawn by a hash of the id: no prefix, where ids follow labels or time."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def _distance_sql(space: str) -> str:
    return {
        "cosine": "greatest(0.0, 1 - list_dot_product(q, e) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))))",
        "l2": "list_distance(q, e)",
        "l1": "list_sum(list_transform(list_zip(q, e), lambda p: abs(p[1] - p[2])))",
        "dot": "1 - list_dot_product(q, e)",
    }[space]


def _topk_sql(space: str, k: int = 10, rows: str = "TRUE", queries: str = "vec_id % 20 = 0") -> str:
    return f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id AS qid, e AS q FROM v WHERE {queries}),
d AS (SELECT qid, vec_id AS id, round({_distance_sql(space)}, {DIGITS}) + 0.0 AS score FROM q, v WHERE {rows})
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score, id)::INTEGER AS rank, id, score FROM d
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, id) <= {k}"""


def _register_topk() -> None:
    for space in SPACES:
        query(f"topk_{space}", _topk_sql(space))(lambda spark, d, space=space: topk(vectors(spark, d), asked(vectors(spark, d)), space, 10, DIGITS))
    query("topk_cosine_native", _topk_sql("cosine"))(lambda spark, d: native_topk(vectors(spark, d).repartition(spark.sparkContext.defaultParallelism), asked(vectors(spark, d)), "cosine", 10, DIGITS))
    one = lambda rows: rows.filter(F.col("id") == 7).select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    query("topk_single", _topk_sql("l2", 25, queries="vec_id = 7"))(lambda spark, d: topk(vectors(spark, d), one(vectors(spark, d)), "l2", 25, DIGITS))
    filters = {
        "eq": ({"label": 3}, "label = 3"),
        "ne": ({"label": {"ne": 3}}, "label <> 3"),
        "range": ({"label": {"gte": 2, "lt": 6.5}}, "label >= 2 AND label < 6.5"),
        "in": ({"label": {"in": [0, 1, 2]}}, "label IN (0, 1, 2)"),
        "nin": ({"label": {"nin": [0, 1, 2]}}, "label NOT IN (0, 1, 2)"),
        "and_or_not": ({"$or": [{"label": {"lte": 1}}, {"$and": [{"id": {"gt": 100}}, {"$not": {"label": {"in": [4, 5]}}}]}]}, "(label <= 1 OR (vec_id > 100 AND NOT label IN (4, 5)))"),
        "none": ({"label": {"eq": "3"}}, "FALSE"),
    }
    for name, (wanted, sql) in filters.items():
        query(f"topk_filtered_{name}", _topk_sql("cosine", rows=sql))(lambda spark, d, wanted=wanted: topk(where(vectors(spark, d), wanted), asked(vectors(spark, d)), "cosine", 10, DIGITS))


_register_topk()

#: Filters on typed columns: name -> (table, filter, SQL condition, columns returned).
FILTERS = {
    "contains": ("documents", {"text": {"contains": "tion"}}, "contains(text, 'tion')", ["doc_id"]),
    "startswith": ("pages", {"url": {"startswith": "https://"}}, "starts_with(url, 'https://')", ["page_id", "url"]),
    "endswith": ("pages", {"url": {"endswith": "#top"}}, "ends_with(url, '#top')", ["page_id", "url"]),
    "equality": ("documents", {"lang": "fr", "source": {"ne": "src0"}}, "lang = 'fr' AND source <> 'src0'", ["doc_id", "lang", "source"]),
    "numbers": ("customer", {"c_acctbal": {"gt": 1000, "lte": 5000.5}, "c_nationkey": {"nin": [1, 2.0, 3]}}, "c_acctbal > 1000 AND c_acctbal <= 5000.5 AND c_nationkey NOT IN (1, 2, 3)", ["c_custkey", "c_acctbal"]),
    "groups": ("orders", {"$or": [{"o_orderstatus": "P"}, {"$not": {"o_totalprice": {"lt": 300000}}}], "o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}}, "(o_orderstatus = 'P' OR NOT o_totalprice < 300000) AND o_orderpriority IN ('1-URGENT', '2-HIGH')", ["o_orderkey"]),
    "scan": ("lineitem", {"l_returnflag": "R", "l_quantity": {"gte": 10, "lt": 20}, "l_discount": {"gt": 0.05}}, "l_returnflag = 'R' AND l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05", ["l_orderkey", "l_linenumber"]),
    "empty_and": ("supplier", {"$and": []}, "TRUE", ["s_suppkey"]),
    "empty_or": ("supplier", {"$or": []}, "FALSE", ["s_suppkey"]),
}
for _name, (_table, _wanted, _sql, _columns) in FILTERS.items():
    query(f"filter_{_name}", f"SELECT {', '.join(_columns)} FROM {_table} WHERE {_sql}")(lambda spark, d, t=_table, w=_wanted, c=_columns: where(table(spark, d, t), w).select(*c))
    query(f"count_{_name}", f"SELECT count(*) AS n FROM {_table} WHERE {_sql}")(lambda spark, d, t=_table, w=_wanted: where(table(spark, d, t), w).agg(F.count("*").alias("n")))


def typed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the words of their names, two each."""
    return table(spark, d, "part").withColumn("words", F.split("p_name", " "))


PART_SQL = "SELECT p_partkey FROM part WHERE {}"
query("filter_any", PART_SQL.format("list_has_any(string_split(p_name, ' '), ['red', 'gear', 'none'])"))(lambda spark, d: where(typed_parts(spark, d), {"words": {"any": ["red", "gear", "none"]}}).select("p_partkey"))
query("filter_all", PART_SQL.format("list_has_all(string_split(p_name, ' '), ['red', 'gear'])"))(lambda spark, d: where(typed_parts(spark, d), {"words": {"all": ["red", "gear"]}}).select("p_partkey"))
query("filter_array_contains", PART_SQL.format("list_contains(string_split(p_name, ' '), 'bolt')"))(lambda spark, d: where(typed_parts(spark, d), {"words": {"contains": "bolt"}}).select("p_partkey"))
query("filter_missing", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality <> 1")(
    lambda spark, d: where(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), {"$or": [{"quality": {"is_missing": True}}, {"quality": {"ne": 1}}]}).select("doc_id")
)


#: Events, of which every third has no key at all and every fifth of the others a null.
EVENTS_SQL = """SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' WHEN event_id % 5 = 0 THEN '{"k": null}' ELSE props END AS props FROM events) WHERE """


def _events(spark: SparkSession, d: str, wanted: dict) -> DataFrame:
    props = F.when(F.col("event_id") % 3 == 0, F.lit("{}")).when(F.col("event_id") % 5 == 0, F.lit('{"k": null}')).otherwise(F.col("props"))
    events = table(spark, d, "events").withColumn("props", props)
    return events.filter(bound_condition(parse(wanted), lambda n: json_field(F.col("props"), n))).select("event_id")


for _name, _wanted, _sql in (
    ("json_range", {"k": {"gte": 20, "lt": 60.5}}, "json_extract(props, '$.k')::DOUBLE >= 20 AND json_extract(props, '$.k')::DOUBLE < 60.5"),
    ("json_exists", {"k": {"exists": True}}, "json_extract(props, '$.k') IS NOT NULL"),
    ("json_is_missing", {"k": {"is_missing": True}}, "json_extract(props, '$.k') IS NULL"),
    ("json_is_null", {"k": {"is_null": True}}, "json_type(props, '$.k') = 'NULL'"),
    ("json_not_null", {"k": {"is_null": False}}, "coalesce(json_type(props, '$.k'), 'x') <> 'NULL'"),
    ("json_equal", {"k": {"in": [1, 2.0, "3"]}}, "json_extract(props, '$.k')::DOUBLE IN (1, 2)"),
):
    query(f"filter_{_name}", EVENTS_SQL + _sql)(lambda spark, d, w=_wanted: _events(spark, d, w))


@query("normalise", "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def q_normalise(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.transform("vector", lambda x: x * 2)
    return vectors(spark, d).select("id", F.round(norm(normalise(doubled)), 4).alias("norm"))


@query("validate_vectors", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'Vector dimension mismatch: expected 64, got 63' WHEN vec_id % 5 = 0 THEN 'Vector contains invalid value at index 3 (must be finite)' END AS error FROM embeddings")
def q_validate(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 63)).when(F.col("id") % 5 == 0, F.concat(F.slice("vector", 1, 3), F.array(F.lit(float("nan")).cast("float")), F.slice("vector", 5, 60))).otherwise(F.col("vector"))
    return vectors(spark, d).select("id", vector_error(v, 64).alias("error"))


# -- collections: the relation that a call leaves or answers -------------------------------------------------------


def _customers(spark: SparkSession, d: str, space: str = "l2", also: tuple[Column, ...] = (), **more: object):
    """A collection of the customers: a vector of two columns, the others (and ``also``) as metadata, in the order of the key."""
    from .database import VectorDatabase

    index = VectorDatabase(spark).create(dim=2, space=space, **more)
    rows = table(spark, d, "customer").orderBy("c_custkey")
    index.add_frame(rows.select(F.col("c_custkey").cast("string").alias("id"), F.array(F.col("c_nationkey").cast("float"), F.col("c_acctbal").cast("float")).alias("vector"), F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment", *also)).alias("metadata")))
    return index


def _page(spark: SparkSession, page: list[tuple[str, dict]]) -> DataFrame:
    return spark.createDataFrame([(n + 1, i, m["c_name"]) for n, (i, m) in enumerate(page)], "place int, id string, c_name string")


_LIST = "SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS place, c_custkey::VARCHAR AS id, c_name FROM (SELECT * FROM customer {} ORDER BY c_custkey LIMIT {}{})"
query("list_offset", _LIST.format("", 20, " OFFSET 30"))(lambda spark, d: _page(spark, _customers(spark, d).list(20, offset=30)))
query("list_after", _LIST.format("WHERE c_custkey > 77", 15, ""))(lambda spark, d: _page(spark, _customers(spark, d).list(15, after="77")))


@query("get_records", "SELECT place::INTEGER AS place, c_custkey::VARCHAR AS id, c_name FROM (VALUES (1, 9), (2, 3), (3, 9), (4, 120)) w(place, k) JOIN customer ON c_custkey = k")
def q_get_records(spark: SparkSession, d: str) -> DataFrame:
    found = _customers(spark, d).get_records(["9", "3", "9", "nobody", "120"], return_vector=False)
    return _page(spark, [(r["id"], r["metadata"]) for r in found])


def _left(index) -> DataFrame:
    return index.frame().select(F.col("id").cast("long").alias("id"), F.round(F.element_at("vector", 2).cast("double"), 2).alias("second"), F.get_json_object("json", "$.c_mktsegment").alias("segment"))


@query("remove_where", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, c_mktsegment AS segment FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 0)")
def q_remove_where(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d, indexed_fields=["c_mktsegment"])
    index.remove_where({"c_mktsegment": "BUILDING", "c_acctbal": {"lt": 0}})
    return _left(index)


@query("upsert", "SELECT c_custkey AS id, round((CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE c_acctbal END)::FLOAT::DOUBLE, 2) AS second, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1, 2.5, 'NEW'")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    fresh = table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"), F.lit("{}").alias("metadata"))
    index.add_frame(fresh)
    index.add({"id": "-1", "vector": [0, 2.5], "metadata": {"c_mktsegment": "NEW"}})
    return _left(index)


@query("update_metadata", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer")
def q_update(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    index.update_frame(table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit(json.dumps({"c_mktsegment": "MOVED"})).alias("metadata")))
    return _left(index)


@query("delete_and_compact", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (1, 2, 3)")
def q_delete(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    index.delete(ids=["1", "2", "3", "none"])
    index.compact()
    return _left(index)


@query("add_without_overwrite", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, c_mktsegment AS segment FROM customer UNION ALL SELECT -c_custkey, 1, 'NEW' FROM customer WHERE c_custkey % 4 = 0")
def q_add_new(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    key = F.col("c_custkey").cast("string")
    fresh = table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.explode(F.array(key, F.concat(F.lit("-"), key))).alias("id"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"), F.lit('{"c_mktsegment": "NEW"}').alias("metadata"))
    index.add_frame(fresh, overwrite=False)
    return _left(index)


@query("clear_and_add", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, NULL::VARCHAR AS segment FROM customer WHERE c_custkey % 6 = 0")
def q_clear(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    index.clear()
    index.add_frame(table(spark, d, "customer").filter("c_custkey % 6 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit(0.0).cast("float"), F.col("c_acctbal").cast("float")).alias("vector")))
    return _left(index)


@query("contains", "SELECT k::VARCHAR AS id, k IN (SELECT c_custkey FROM customer WHERE c_custkey <> 4) AS there FROM (VALUES (3), (4), (100), (-1)) v(k)")
def q_contains(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    index.remove_point("4")
    return spark.createDataFrame([(i, i in index) for i in ("3", "4", "100", "-1")], "id string, there boolean")


@query("remove_points", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey >= 120 UNION ALL SELECT -k, 0, 'MISSING' FROM range(1, 4) r(k)")
def q_remove_points(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d)
    missing = index.remove_points([str(k) for k in range(0, 120, 3)] + ["-1", "-2", "-3", "-2"])
    return _left(index).unionByName(spark.createDataFrame([(int(i), 0.0, "MISSING") for i in missing], "id long, second double, segment string"))


#: Customers whose segment every fourth lacks and every fifth of the others has as null, declared and not.
_PRESENCE = """
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'null' ELSE c_mktsegment END AS s FROM customer),
w(condition, id) AS (
  SELECT 'exists', id FROM c WHERE s <> 'missing' UNION ALL SELECT 'is_missing', id FROM c WHERE s = 'missing' UNION ALL SELECT 'is_null', id FROM c WHERE s = 'null'
  UNION ALL SELECT 'not_null', id FROM c WHERE s <> 'null' UNION ALL SELECT 'ne', id FROM c WHERE s NOT IN ('missing', 'BUILDING'))
SELECT condition, id FROM w"""


def _presence(spark: SparkSession, d: str, **more: object) -> DataFrame:
    from .database import VectorDatabase

    segment = F.when(F.col("c_custkey") % 4 == 0, F.lit("{}")).when(F.col("c_custkey") % 5 == 0, F.lit('{"s": null}')).otherwise(F.to_json(F.struct(F.col("c_mktsegment").alias("s"))))
    index = VectorDatabase(spark).create(dim=1, space="l2", **more)
    index.add_frame(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit(1.0)).alias("vector"), segment.alias("metadata")))
    found = [({"exists": True}, "exists"), ({"is_missing": True}, "is_missing"), ({"is_null": True}, "is_null"), ({"is_null": False}, "not_null"), ({"ne": "BUILDING"}, "ne")]
    return reduce(DataFrame.union, [index.frame({"s": wanted}).select(F.lit(name).alias("condition"), F.col("id").cast("long").alias("id")) for wanted, name in found])


query("presence_declared", _PRESENCE)(lambda spark, d: _presence(spark, d, indexed_fields=["s"]))
query("presence_undeclared", _PRESENCE)(lambda spark, d: _presence(spark, d))


@query("stream_upsert", "SELECT c_custkey AS id, round((CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END)::FLOAT::DOUBLE, 2) AS second, CASE WHEN c_custkey % 3 = 0 THEN 'STREAMED' ELSE c_mktsegment END AS segment FROM customer")
def q_stream(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of a file stream, upserted into a collection."""
    from .plans.workspace import Workspace
    from .streaming.upsert import stream_into

    index = _customers(spark, d)
    place = Workspace(spark)
    changed = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit(0.0).cast("float"), (-F.col("c_acctbal")).cast("float")).alias("vector"), F.lit('{"c_mktsegment": "STREAMED"}').alias("metadata"))
    stream = spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 1).parquet(place.write(changed.repartition(2)))
    stream_into(stream, index, place.path(), availableNow=True).awaitTermination()
    return _left(index)


#: Customers by a condition of a declared and an undeclared field, in branches that the declared one narrows.
_MIXED = {"$or": [{"c_mktsegment": "BUILDING", "c_acctbal": {"lt": 1000}}, {"c_mktsegment": "MACHINERY", "$not": {"c_acctbal": {"lt": 5000}}}]}


@query("narrowed_filter", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 1000 OR c_mktsegment = 'MACHINERY' AND NOT c_acctbal < 5000")
def q_narrowed(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d, indexed_fields=["c_mktsegment"]).frame(_MIXED).select(F.col("id").cast("long").alias("id"))


@query("count_bounds", "SELECT 0::BIGINT AS fewest, count(*) AS most FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q_bounds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([_customers(spark, d, indexed_fields=["c_mktsegment"]).count_bounds(_MIXED)], "fewest long, most long")


@query("collection_topk_batch", """
WITH v AS (SELECT c_custkey::VARCHAR AS id, c_custkey % 20 = 0 AS asks, row_number() OVER (ORDER BY c_custkey) AS n, c_nationkey::FLOAT::DOUBLE AS a, c_acctbal::FLOAT::DOUBLE AS b FROM customer),
s AS (SELECT q.id AS asked, v.id, round(abs(v.a - q.a) + abs(v.b - q.b), 4) AS score FROM v q, v WHERE q.asks)
SELECT asked, id, score FROM s QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score, id) <= 5""")
def q_collection_batch(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, asked of a collection in one batch (L1)."""
    rows = _customers(spark, d, space="l1")
    asking = rows.frame().filter(F.col("id").cast("long") % 20 == 0).orderBy("seq").select("id", "vector").collect()
    found = rows.search_matrix(np.array([r.vector for r in asking]), top_k=5, digits=4)
    names = spark.createDataFrame([(n, r.id) for n, r in enumerate(asking)], "qid long, asked string")
    return found.join(F.broadcast(names), "qid").select("asked", "id", "score")


@query("rebuild_and_search", """
WITH c AS (SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, c_mktsegment AS segment, c_nationkey::FLOAT::DOUBLE AS a, c_acctbal::FLOAT::DOUBLE AS b FROM customer WHERE c_custkey % 11 <> 0),
s AS (SELECT id, round(sqrt((c.a - q.a) ** 2 + (c.b - q.b) ** 2), 4) AS score FROM c, (SELECT a, b FROM c WHERE id = 40) q),
p AS (SELECT id, row_number() OVER (ORDER BY score, id::VARCHAR)::INTEGER AS rank, score FROM s QUALIFY row_number() OVER (ORDER BY score, id::VARCHAR) <= 100)
SELECT id, second, segment, rank, score FROM c LEFT JOIN p USING (id)""")
def q_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Records after cells were fitted and the files dealt by them, some removed before and some after; and the page of customer 40, by cells."""
    index = _customers(spark, d, also=(F.pmod("c_custkey", F.lit(22)).alias("of_22"),))
    index.remove_points([r.id for r in index.frame({"of_22": 0}).select("id").collect()])
    index.rebuild(m=16)
    index.remove_where({"of_22": 11})
    left = _left(index)
    if not (asked := index.get_records("40")):
        return left.withColumn("rank", F.lit(None).cast("int")).withColumn("score", F.lit(None).cast("double"))
    # By cells, as many as hold all records but one, so that the page is the exact one.
    page = index.search_matrix(asked[0]["vector"][None], None, 100, ef_search=max(1, len(index) - 1), digits=4)
    return left.join(F.broadcast(page.select(F.col("id").cast("long").alias("id"), "rank", "score")), "id", "left")


@query("save_and_load", "SELECT c_custkey AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS second, c_mktsegment AS segment FROM customer")
def q_save(spark: SparkSession, d: str) -> DataFrame:
    from .database import VectorDatabase
    from .plans.workspace import Workspace

    path = Workspace(spark).path()
    _customers(spark, d).save(path)
    return _left(VectorDatabase(spark).load(path))


@query("collection_topk_filtered", """
WITH q AS (SELECT c_nationkey::FLOAT::DOUBLE AS a, c_acctbal::FLOAT::DOUBLE AS b FROM customer WHERE c_custkey = 5),
s AS (SELECT c_custkey::VARCHAR AS id, round(sqrt((c_nationkey::FLOAT::DOUBLE - a) ** 2 + (c_acctbal::FLOAT::DOUBLE - b) ** 2), 4) AS score FROM customer, q WHERE c_mktsegment = 'BUILDING')
SELECT id, score FROM s ORDER BY score, id LIMIT 10""")
def q_collection_topk(spark: SparkSession, d: str) -> DataFrame:
    index = _customers(spark, d, indexed_fields=["c_mktsegment"])
    query_vector = index.get_records("5")[0]["vector"]
    return index.search_matrix(query_vector[None], {"c_mktsegment": "BUILDING"}, 10, digits=4).select("id", "score")


# -- quantisation and approximate search ---------------------------------------------------------------------------

SUBVECTORS, CENTROIDS = 8, 16


def _fixed_codebook(spark: SparkSession, d: str) -> np.ndarray:
    """A codebook that SQL can name too: the parts of the vectors of ids below CENTROIDS."""
    rows = vectors(spark, d).filter(F.col("id") < CENTROIDS).orderBy("id").collect()
    return np.array([r.vector for r in rows], np.float32).reshape(CENTROIDS, SUBVECTORS, -1).transpose(1, 0, 2).copy()


_CODES = f"""
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT id, s, e[s * 8 + 1 : s * 8 + 8] AS part FROM v, range(0, {SUBVECTORS}) r(s)),
c AS (SELECT id AS c, s, part AS centre FROM p WHERE id < {CENTROIDS}),
near AS (SELECT p.id, p.s, c.c, row_number() OVER (PARTITION BY p.id, p.s ORDER BY list_distance(part, centre), c.c) AS place FROM p JOIN c ON p.s = c.s),
codes AS (SELECT id, s, c FROM near WHERE place = 1)"""


@query("pq_encode", f"WITH {_CODES} SELECT id, string_agg(c::VARCHAR, ',' ORDER BY s) AS code FROM codes GROUP BY id")
def q_encode(spark: SparkSession, d: str) -> DataFrame:
    coded = encode(vectors(spark, d), _fixed_codebook(spark, d))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(SUBVECTORS)), lambda i: F.conv(F.hex(F.substring("code", i, F.lit(1))), 16, 10))
    return coded.select("id", F.array_join(numbers, ",").alias("code"))


@query("pq_reconstruct", f"WITH {_CODES}, flat AS (SELECT codes.id, codes.s, centre FROM codes JOIN c ON codes.c = c.c AND codes.s = c.s) SELECT id, round(sum(list_sum(centre)), 4) + 0.0 AS total FROM flat GROUP BY id")
def q_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    book = _fixed_codebook(spark, d)
    made = reconstruct(encode(vectors(spark, d), book), book)
    return made.select("id", (F.round(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double")), 4) + F.lit(0.0)).alias("total"))


_ADC = f"""WITH {_CODES},
q AS (SELECT id AS qid, s, part AS qpart FROM p WHERE id % 20 = 0),
lut AS (SELECT qid, q.s, c.c, list_distance(qpart, centre) ** 2 AS d2 FROM q JOIN c ON q.s = c.s),
d AS (SELECT qid, codes.id, round(sum(d2), {DIGITS}) AS score FROM lut JOIN codes ON lut.s = codes.s AND lut.c = codes.c GROUP BY qid, codes.id)"""


def _adc(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, np.ndarray, list]:
    book = _fixed_codebook(spark, d)
    queries = asked(vectors(spark, d)).orderBy("qid").collect()
    ids, matrix = [r.qid for r in queries], np.array([r.query for r in queries], float)
    return scored_topk(encode(vectors(spark, d), book), ids, AsymmetricDistance(matrix, book), k, "long", DIGITS), matrix, ids


query("adc_topk", f"{_ADC} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score, id)::INTEGER AS rank, id, score FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, id) <= 10")(lambda spark, d: _adc(spark, d, 10)[0])


@query("rerank_topk", f"""{_ADC}, f AS (SELECT qid, id FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, id) <= 50),
r AS (SELECT f.qid, f.id, round(list_distance(a.e, b.e), {DIGITS}) AS score FROM f JOIN v a ON a.id = f.qid JOIN v b ON b.id = f.id)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score, id)::INTEGER AS rank, id, score FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, id) <= 10""")
def q_rerank(spark: SparkSession, d: str) -> DataFrame:
    from .functions.metrics import distance
    from .operators.topk import best

    candidates, _, _ = _adc(spark, d, fetch_count(10, 1_000_000, 5, None))
    rows = vectors(spark, d)
    met = candidates.select("qid", "id").join(rows.select("id", "vector"), "id").join(asked(rows), "qid")
    return best(met.select("qid", "id", distance("l2", F.col("query"), F.col("vector")).alias("score")), 10, DIGITS)


#: Vectors, drawn by a hash of the id, that the trained codebook, its calibration and the bins of candidates see at most, and queries that are asked at once.
TRAIN_SAMPLE, CALIBRATE_SAMPLE, BIN_SAMPLE, RESCORE_BLOCK = 20_000, 10_000, 2_000, 2_048


@query("rerank_topk_trained")
def q_rerank_trained(spark: SparkSession, d: str) -> DataFrame:
    """L2 top-10 of the stated query set by codes of a trained codebook, rescored on raw vectors; the fetch is calibrated and grows with the rows.

    Of each query the candidates are the rows within the distance by code that holds as many as the fetch. They are rescored where they
    lie, so no candidate is shuffled: only counts, and the ten best of each task.
    """
    from .operators.topk import best
    from .plans.workspace import Workspace

    rows = vectors(spark, d)
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("id"), "id")
    book = train(drawn.limit(TRAIN_SAMPLE).select(F.col("id").alias("seq"), "vector"), SUBVECTORS, 8 if n >= 256 else 4)
    sample = np.array([r.vector for r in drawn.limit(CALIBRATE_SAMPLE).collect()], np.float32)
    fetch = fetch_count(10, n, None, calibrate("l2", sample, book))
    near = encode_block(sample[:BIN_SAMPLE], book)
    queries = asked(rows).orderBy("qid").collect()
    # Written, so that rows are encoded once for all blocks of queries.
    spread = rows if rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else rows.repartition(spark.sparkContext.defaultParallelism, "id")
    coded = spark.read.parquet(Workspace(spark).write(encode(spread, book, ("vector",))))
    found = best(rows.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score")).limit(0), 10, DIGITS)
    for i in range(0, len(queries), RESCORE_BLOCK):
        part = queries[i : i + RESCORE_BLOCK]
        matrix = np.array([r.query for r in part], float)
        bounds = code_bounds(coded, matrix, book, fetch, n, near)
        found = found.unionByName(scored_topk(coded, [r.qid for r in part], Rescored(matrix, book, bounds), 10, "long", DIGITS))
    return found


@query("symmetric_distance", f"WITH {_CODES}, t AS (SELECT a.s, a.c AS ca, b.c AS cb, list_distance(a.centre, b.centre) ** 2 AS d2 FROM c a JOIN c b ON a.s = b.s) SELECT x.id AS id, round(sum(d2), {DIGITS}) AS to_first FROM codes x JOIN codes y ON x.s = y.s AND y.id = 20 JOIN t ON t.s = x.s AND t.ca = x.c AND t.cb = y.c GROUP BY x.id")
def q_symmetric(spark: SparkSession, d: str) -> DataFrame:
    book = _fixed_codebook(spark, d)
    first = encode_block(np.array([vectors(spark, d).filter("id = 20").first().vector]), book)
    shared = spark.sparkContext.broadcast((book, first))

    def run(batches):
        from .operators.quantize import code_rows

        for batch in batches:
            if batch.num_rows:
                far = symmetric_distance(code_rows(batch.column("code")), shared.value[1], shared.value[0])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(far)], names=["id", "to_first"])

    return encode(vectors(spark, d), book).mapInArrow(run, "id long, to_first double").select("id", F.round("to_first", DIGITS).alias("to_first"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with their cell, the centres, and the sample that these are fitted on."""
    rows = vectors(spark, d)
    n = rows.count()
    sample = np.array([r.vector for r in rows.orderBy(F.xxhash64("id")).limit(50_000).orderBy("id").collect()])
    centres = fit_cells(sample, cell_count(n, 16))
    shared = spark.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                yield batch.append_column("cell", pa.array(assign(x, shared.value)[0].astype(np.int32)))

    return rows.select("id", "vector").mapInArrow(run, "id long, vector array<float>, cell int"), centres, sample


def _ivf(spark: SparkSession, d: str, every: bool) -> DataFrame:
    """Cosine top-10 over every cell, or over as many nearest ones as the sample shows to hold RECALL of the true neighbours."""
    rows, centres, sample = _cells(spark, d)
    queries = asked(vectors(spark, d)).orderBy("qid").collect()
    ids, matrix = [r.qid for r in queries], np.array([r.query for r in queries], float)
    mask = nearest_cells(matrix, centres, len(centres) if every else calibrate_probes("cosine", sample, centres, 10))
    return scored_topk(rows, ids, Probed(Exact("cosine", matrix), mask), 10, "long", DIGITS)


query("ivf_topk_all", _topk_sql("cosine"))(lambda spark, d: _ivf(spark, d, True))
query("ivf_topk_few")(lambda spark, d: _ivf(spark, d, False))


@query("pq_train")
def q_train(spark: SparkSession, d: str) -> DataFrame:
    """The mean squared error of each subvector after training on all vectors."""
    rows = vectors(spark, d)
    book = train(rows.select(F.col("id").alias("seq"), "vector"), SUBVECTORS, 4)
    made = reconstruct(encode(rows, book), book).withColumnRenamed("vector", "made")
    error = F.aggregate(F.zip_with("vector", "made", lambda a, b: (a - b).cast("double") * (a - b).cast("double")), F.lit(0.0), lambda t, x: t + x)
    return rows.join(made, "id").agg(F.round(F.avg(error), 4).alias("error"), F.count("*").alias("n"))


@query("calibrate_fetch")
def q_calibrate(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    book = train(rows.select(F.col("id").alias("seq"), "vector"), SUBVECTORS, 4)
    sample = hashed(rows, 10_000).collect()
    c = calibrate("cosine", np.array([r.vector for r in sample], np.float32), book)
    return spark.createDataFrame([(c.fetch, c.records, c.queries, c.exponent, fetch_count(10, 10 * c.records, None, c))], "fetch int, records int, queries int, exponent double, fetch_at_ten_times int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered cosine top-10 of the stated query set among three labels."""
    rows = vectors(spark, sf_dir)
    found = topk(where(rows, {"label": {"in": [0, 1, 2]}}), asked(rows), "cosine", 10, DIGITS)
    return found.select("qid", "rank", F.col("id").alias("vec_id"), "score")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = _topk_sql("cosine", rows="label IN (0, 1, 2)").replace("rank, id, score FROM d", "rank, id AS vec_id, score FROM d")


@query("neighbour_lists", f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id AS qid, b.vec_id AS id, b.e AS e, {_distance_sql("cosine").replace("q, e", "a.e, b.e").replace("q, q", "a.e, a.e").replace("e, e)", "b.e, b.e)")} AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS n FROM d QUALIFY n <= 40),
before AS (SELECT x.qid, x.n, list(y.n) AS nearer FROM near x JOIN near y ON x.qid = y.qid AND y.n < x.n AND {_distance_sql("cosine").replace("q, e", "x.e, y.e").replace("q, q", "x.e, x.e").replace("e, e)", "y.e, y.e)")} < x.score GROUP BY x.qid, x.n),
pick(qid, n, kept) AS (
  SELECT DISTINCT qid, 0::BIGINT, []::BIGINT[] FROM near
  UNION ALL
  SELECT p.qid, c.n, CASE WHEN len(kept) < 16 AND NOT list_has_any(kept, coalesce(nearer, [])) THEN list_append(kept, c.n) ELSE kept END
  FROM pick p JOIN near c ON c.qid = p.qid AND c.n = p.n + 1 LEFT JOIN before b ON b.qid = c.qid AND b.n = c.n),
last AS (SELECT qid, unnest(kept) AS n, unnest(range(1, len(kept) + 1)) AS place FROM pick QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pick.n DESC) = 1)
SELECT qid, id, round(score, {DIGITS}) + 0.0 AS score, place::INTEGER AS place FROM last JOIN near USING (qid, n)""")
def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Diverse neighbour lists of the stated query set."""
    rows = vectors(spark, d)
    return neighbour_lists(rows, asked(rows), "cosine", 40, 16).withColumn("score", F.round("score", DIGITS) + F.lit(0.0))


from . import api_queries  # noqa: E402, F401 - registers its queries
