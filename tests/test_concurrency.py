"""Threads that read and change a collection together; tombstones; what a saved collection may not hold; logging."""

import json
import logging
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import VectorDatabase, collection, logs


@pytest.fixture(scope="module")
def db(spark):
    return VectorDatabase(spark)


def filled(db, n=300, **more):
    rng = np.random.default_rng(3)
    index = db.create(dim=4, space="l2", **more)
    x = rng.standard_normal((n, 4)).astype(np.float32)
    index.add({"ids": [f"r{i}" for i in range(n)], "vectors": x, "metadatas": [{"n": i, "even": i % 2 == 0} for i in range(n)]})
    return index, x


def test_reads_during_overwrites_see_every_record(db):
    """An overwrite swaps old rows for new ones at once: no search or count sees neither or both."""
    index, x = filled(db, 40)
    stop, wrong = threading.Event(), []

    def read():
        while not stop.is_set():
            page = index.search(x[0], top_k=40)
            if sorted(h["id"] for h in page) != sorted(f"r{i}" for i in range(40)):
                wrong.append(len(page))
            if index.count({"n": {"exists": True}}) != 40:
                wrong.append("count")

    with ThreadPoolExecutor(3) as pool:
        readers = [pool.submit(read) for _ in range(3)]
        for _ in range(4):
            index.add({"ids": [f"r{i}" for i in range(40)], "vectors": x, "metadatas": [{"n": i} for i in range(40)]})
        stop.set()
        for r in readers:
            r.result()
    assert wrong == [] and len(index) == 40


def test_changes_from_many_threads(db):
    index, _ = filled(db, 20)
    with ThreadPoolExecutor(6) as pool:
        added = list(pool.map(lambda k: index.add([[k, 0, 0, 0], [0, k, 0, 0]]).ids, range(6)))
        gone = list(pool.map(lambda k: index.remove_point(f"r{k}"), range(6)))
    assert len({i for ids in added for i in ids}) == 12 and all(gone)
    assert len(index) == index.count() == len(index.list(100)) == 20 + 12 - 6


def test_searches_shuffle_no_record_after_a_large_upsert(db, spark):
    index, x = filled(db)
    index.add({"ids": [f"r{i}" for i in range(200)], "vectors": x[:200] + 1})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.records.select("id", "vector")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert index.count() == 300


def test_many_dead_rows_are_rewritten(db, monkeypatch):
    monkeypatch.setattr(collection, "MOST_DEAD", 20)
    monkeypatch.setattr(collection, "DEAD_TABLES", 3)
    index, x = filled(db, 100, indexed_fields=["n"])
    index.add({"ids": [f"s{i}" for i in range(50)], "vectors": x[:50], "metadatas": [{"n": 1000 + i} for i in range(50)]})
    live = {f"r{i}" for i in range(100)} | {f"s{i}" for i in range(50)}
    for gone in ([f"r{i}" for i in range(0, 60, 2)], ["s1"], ["s2"], ["s3"], ["s4"], [f"s{i}" for i in range(10, 40)]):
        assert index.remove_points(gone) == []
        live -= set(gone)
        assert {i for i, _ in index.list(1000)} == live and len(index) == len(live)
        assert int(index.get_stats()["stranded_graph_nodes"]) <= 21
    assert index.count({"n": {"gte": 1000}}) == sum(i.startswith("s") for i in live)


def test_compaction_clusters_declared_fields(db):
    """After compact() the files hold separate ranges of the first declared field, so that a condition on it skips files."""
    index, x = filled(db, 300, indexed_fields=["n"])
    index.remove_point("r0")
    spark = index.spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the parts were large
    try:
        index.compact()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = index.records
    ranges = rows.groupBy(F.input_file_name().alias("file")).agg(F.min("declared.f0.num").alias("low"), F.max("declared.f0.num").alias("high")).orderBy("low").collect()
    assert len(ranges) > 1 and all(a.high <= b.low for a, b in zip(ranges, ranges[1:]))
    assert "PushedFilters" in rows._jdf.queryExecution().executedPlan().toString()
    assert index.count({"n": {"gte": 100, "lt": 110}}) == 10


def test_one_id_on_most_rows(db, spark):
    df = spark.range(2_000).select(F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"), F.array(F.col("id").cast("float")).alias("vector"))
    index = db.create(dim=1, space="l2")
    assert index.add_frame(df).total_inserted == 501
    assert index.get_records("hot")[0]["vector"].tolist() == [1.0]


def test_benchmark_uses_threads(db, monkeypatch):
    index, _ = filled(db, 50)
    seen = set()
    search = index.search
    monkeypatch.setattr(index, "search", lambda q, **more: seen.add(threading.get_ident()) or search(q, **more))
    got = index.benchmark_concurrent_reads(6, 3)
    assert got.keys() == {"sequential_time", "sequential_qps", "parallel_time", "parallel_qps", "speedup", "threads_used"}
    assert 1 <= got["threads_used"] <= 3 and len(seen) == got["threads_used"] + 1


def test_introspection_names_what_is_there(db):
    index, _ = filled(db, 100)
    assert index.get_stats()["index_type"] == "exact" and "exact" in index.info()
    index.rebuild(m=16)
    assert index.get_stats()["index_type"] == "cells" and "cells(" in repr(index)
    assert {"search_speedup_expected", "search_bottleneck", "benefits", "insertion_path"} <= index.get_performance_info().keys()


def damaged(path, change):
    manifest = json.loads((path / "manifest.json").read_text())
    change(manifest)
    (path / "manifest.json").write_text(json.dumps(manifest))
    for crc in path.glob(".manifest*.crc"):
        crc.unlink()


@pytest.mark.parametrize("change", [
    lambda m: m.update(count=7), lambda m: m.update(count=-1), lambda m: m.update(row=2), lambda m: m.update(seq=1), lambda m: m.update(row="x"), lambda m: m.pop("config"),
    lambda m: m["config"].update(dim=3), lambda m: m["config"].update(space="other"), lambda m: m.update(active=True), lambda m: m.update(cells_shape=[3, 9]), lambda m: m.update(tables=["../x"]),
    lambda m: m.update(files=[]), lambda m: m.update(format_version="9.0.0"), lambda m: m.update(calibration={"fetch": 1}), lambda m: m.update(tables=["cells"]),
])
def test_damaged_manifests_are_refused(db, tmp_path, change):
    index, _ = filled(db, 60)
    index.rebuild(m=16)
    index.save(str(tmp_path / "c"))
    assert len(db.load(str(tmp_path / "c"))) == 60
    damaged(tmp_path / "c", change)
    with pytest.raises((ValueError, FileNotFoundError, RuntimeError)):
        db.load(str(tmp_path / "c"))


def test_damaged_vectors_are_refused(db, spark, tmp_path):
    """Files with right digests whose records are not vectors of the collection."""
    from orrery.sources.storage import digests

    index, _ = filled(db, 30)
    path = tmp_path / "c"
    index.save(str(path))
    rows = spark.read.parquet(str(path / "records"))
    bad = rows.withColumn("vector", F.when(F.col("id") == "r7", F.array(F.lit(float("inf")).cast("float"), *[F.lit(0.0).cast("float")] * 3)).otherwise(F.col("vector")))
    bad.write.parquet(str(tmp_path / "bad"))
    for file in (path / "records").iterdir():
        file.unlink()
    for file in (tmp_path / "bad").glob("*.parquet"):
        file.rename(path / "records" / file.name)
    damaged(path, lambda m: m.update(files=digests(spark, str(path), ["records"])))
    with pytest.raises(Exception, match="damaged|invalid"):
        db.load(str(path))


def test_later_saves_leave_loaded_collections_alone(db, tmp_path):
    index, _ = filled(db, 30)
    index.save(str(tmp_path / "c"))
    loaded = db.load(str(tmp_path / "c"))
    index.remove_points([f"r{i}" for i in range(20)])
    index.save(str(tmp_path / "c"))
    assert len(loaded.list(100)) == 30 and len(db.load(str(tmp_path / "c")).list(100)) == 10


def test_several_vectors_without_any(db):
    got = db.create(dim=2).add({"ids": ["a"], "other": 1})
    assert (got.total_inserted, got.total_errors) == (0, 1) and "Missing vector data" in got.errors[0]


def test_environments(monkeypatch):
    for name in ("ENVIRONMENT", "PYTEST_CURRENT_TEST", *(v for names in logs.SIGNS.values() for v in names)):
        monkeypatch.delenv(name, raising=False)
    assert logs.environment() == "testing"  # pytest is loaded
    for variable, value, kind in (("CI", "1", "ci"), ("JPY_PARENT_PID", "3", "jupyter"), ("ENVIRONMENT", "prod", "production"), ("ENVIRONMENT", "dev", "development")):
        with monkeypatch.context() as m:
            m.setenv(variable, value)
            assert logs.environment() == kind
    assert logs._choice("warn", "X", logs.LEVELS, "INFO") == "WARNING"
    with pytest.raises(ValueError):
        logs._choice("loud", "X", logs.LEVELS, "INFO")


def test_file_logs_rotate_and_are_kept_in_number(tmp_path, monkeypatch):
    monkeypatch.setitem(logs._state, "ready", False)
    assert logs.init_file_logging(str(tmp_path), "x", "info", "human", keep=2, max_bytes=300)
    handler = logging.getLogger("orrery").handlers[-1]
    for i in range(60):
        logging.getLogger("orrery").info("line %s of the log", i)
    logging.getLogger("orrery").removeHandler(handler)
    handler.close()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.log", "x.log.1", "x.log.2"]


def test_lookups_by_id_have_bloom_filters(db):
    import duckdb

    index, _ = filled(db, 50)
    index.compact()
    for segment in index._state.segments:
        found = duckdb.sql(f"SELECT path_in_schema, bloom_filter_offset FROM parquet_metadata('{segment.path.removeprefix('file:')}/*.parquet')").fetchall()
        assert all((offset is not None) == (name == "id") for name, offset in found)
    assert "r7" in index and "nobody" not in index and index.get_records(["r7", "x"])[0]["id"] == "r7"
