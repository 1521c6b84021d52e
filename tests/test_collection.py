import json
import warnings

import numpy as np
import pytest

from orrery import AddResult, VectorDatabase
from orrery.functions.metrics import block_distances


@pytest.fixture(scope="module")
def db(spark):
    return VectorDatabase(spark)


#: The quick start, whose results must come out the same.
QUICK = [
    ("doc_001", [0.1, 0.2, 0.3, 0.1, 0.4, 0.2, 0.6, 0.7], {"author": "Alice"}),
    ("doc_002", [0.9, 0.1, 0.4, 0.2, 0.8, 0.5, 0.3, 0.9], {"author": "Bob"}),
    ("doc_003", [0.11, 0.21, 0.31, 0.15, 0.41, 0.22, 0.61, 0.72], {"author": "Alice"}),
    ("doc_004", [0.85, 0.15, 0.42, 0.27, 0.83, 0.52, 0.33, 0.95], {"author": "Bob"}),
    ("doc_005", [0.12, 0.22, 0.33, 0.13, 0.45, 0.23, 0.65, 0.71], {"author": "Alice"}),
]


def quick(db, **more):
    index = db.create(dim=8, **more)
    assert index.add([{"id": i, "values": v, "metadata": m} for i, v, m in QUICK]).total_inserted == 5
    return index


def test_quick_start(db):
    index = quick(db)
    hits = index.search(QUICK[0][1], top_k=2)
    assert [h["id"] for h in hits] == ["doc_001", "doc_003"]
    assert abs(hits[0]["score"]) < 1e-6 and abs(hits[1]["score"] - 0.000988) < 2e-6
    assert [h["id"] for h in index.search(QUICK[0][1], filter={"author": "Alice"}, top_k=5)] == ["doc_001", "doc_003", "doc_005"]
    pages = index.search([QUICK[0][1], QUICK[4][1]], filter={"author": "Alice"}, top_k=2)
    assert [[h["id"] for h in p] for p in pages][0] == ["doc_001", "doc_003"]
    assert index.search(QUICK[0][1], top_k=0) == []
    assert abs(np.linalg.norm(index.search(QUICK[1][1], top_k=1, return_vector=True)[0]["vector"]) - 1) < 1e-6


def test_dot_and_zero(db):
    index = db.create(dim=4, space="DOT")
    index.add({"ids": ["long", "unit"], "vectors": [[3.0, 0, 0, 0], [1.0, 0, 0, 0]]})
    assert [(h["id"], h["score"]) for h in index.search([1, 0, 0, 0])] == [("long", -2.0), ("unit", 0.0)]
    index = db.create(dim=2)
    index.add([[0.0, 0.0]])
    assert index.search([1, 0])[0]["score"] == 1.0 and index.search([0, 0])[0]["score"] == 1.0


@pytest.mark.parametrize("space", ["cosine", "l2", "l1", "dot"])
def test_brute_force(db, space):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 16)).astype(np.float32)
    index = db.create(dim=16, space=space)
    assert index.add({"ids": [f"r{i}" for i in range(200)], "embeddings": x}).vector_shape == (200, 16)
    queries = rng.standard_normal((7, 16)).astype(np.float32)
    want = block_distances(space, queries.astype(float), x.astype(float))
    for q, page in enumerate(index.search(queries, top_k=10)):
        assert [h["id"] for h in page] == [f"r{i}" for i in np.argsort(want[q], kind="stable")[:10]]
        assert np.allclose([h["score"] for h in page], np.sort(want[q])[:10], atol=1e-5)


def test_inputs(db):
    index = db.create(dim=2)
    r = index.add({"id": "a", "values": [1, 0], "vector": [0, 1], "metadata": {"n": 1}})
    assert isinstance(r, AddResult) and r.is_success() and r.summary() == "1 inserted, 0 errors" and r.ids == ["a"]
    assert index.add([{"id": "b", "vector": [0, 1], "metadata": "note"}, {"vector": [1, 1], "metadata": 5}, [2, 2], {"id": "bad", "vector": [1]}, {"id": "x"}]).total_errors == 2
    assert dict(index.list(10)) == {"a": {"n": 1}, "b": {"text": "note"}, "vec_1": {"value": 5}, "vec_2": {}}
    r = index.add({"ids": ["c", "c"], "vectors": [[1, 2], [3, 4]]})
    assert (r.total_inserted, r.total_errors) == (1, 1)
    assert index.get_records("c")[0]["vector"].tolist() == pytest.approx(np.array([1, 2]) / 5**0.5, abs=1e-6)
    r = index.add({"ids": ["a", "d"], "values": [[1, 2], [3, 4]]}, overwrite=False)
    assert (r.total_inserted, r.total_errors, r.ids) == (1, 1, ["d"]) and "already exists" in r.errors[0]
    for bad, error in (({"ids": ["a"], "vectors": [[1, 2], [1, 2]]}, ValueError), ({"ids": "ab", "vectors": [[1, 2], [1, 2]]}, TypeError), (None, ValueError), ({"id": "a"}, ValueError), (5, TypeError)):
        with pytest.raises(error):
            index.add(bad)
    assert index.add(np.array([[np.nan, 1], [1, 1]], np.float32)).total_errors == 1
    for bad in ([], [1], [1, float("inf")]):
        with pytest.raises(ValueError):
            index.search(bad)
    with pytest.raises(ValueError):
        index.search([1, 0], top_k=70_000)


def test_generated_ids_survive_clear(db):
    index = db.create(dim=2)
    index.add([[1, 2], [3, 4], [5, 6]])
    assert index.clear() == 3 and len(index) == 0 and index.search([1, 0]) == []
    assert index.add([[1, 2]]).ids == ["vec_4"]


def test_mutation_and_paging(db):
    index = db.create(dim=2, space="l2", indexed_fields=["n"])
    index.add({"ids": [f"p{i}" for i in range(6)], "vectors": [[i, 0] for i in range(6)], "metadatas": [{"n": i} for i in range(6)]})
    assert [i for i, _ in index.list(2, offset=1)] == ["p1", "p2"]
    assert index.remove_point("p0") and not index.remove_point("p0")
    assert [i for i, _ in index.list(2, after="p1")] == ["p2", "p3"] and [i for i, _ in index.list(2, offset=2)] == ["p3", "p4"]
    with pytest.raises(KeyError):
        index.list(2, after="p0")
    with pytest.raises(ValueError):
        index.list(2, offset=1, after="p1")
    assert index.remove_points(["p1", "zz", "zz"]) == ["zz"] and len(index) == 4 == index.count()
    assert index.update_metadata("p2", {"m": [1]}) and not index.update_metadata("zz", {})
    assert [i for i, _ in index.list(10)] == ["p2", "p3", "p4", "p5"] and index.list(1)[0][1] == {"m": [1]}
    assert index.count({"n": {"gte": 4}}) == 2 and index.count({"n": {"exists": False}}) == 1
    index.add({"id": "p3", "vector": [9, 0]})
    assert [i for i, _ in index.list(10)][-1] == "p3" and index.search([9, 0], top_k=1)[0]["id"] == "p3"
    with pytest.raises(ValueError):
        index.remove_where({})
    with pytest.raises(ValueError):
        index.remove_where({"$not": {"$or": []}})
    assert index.delete(where={"n": 4}) == 1 and index.delete(ids=["p5", "q"]) == 1
    assert index.get_stats()["stranded_graph_nodes"] == "6" and index.compact() == 6 and index.compact() == 0
    assert sorted(r["id"] for r in index.get_records(["p3", "p2", "nope"], return_vector=False)) == ["p2", "p3"]
    with pytest.raises(KeyError):
        index.get_records(["nope"], strict=True)
    assert "p2" in index and not index.contains("p4")
    index.add_metadata({"owner": "me"})
    assert index.get_metadata("owner") == "me" and index.get_all_metadata() == {"owner": "me"}


@pytest.mark.parametrize("mode", ["quantized_only", "quantized_with_raw"])
def test_quantisation(db, mode, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.15 * rng.standard_normal((1500, 16))).astype(np.float32)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        index = db.create(dim=16, quantization_config={"type": "pq", "subvectors": 8, "bits": 6, "training_size": 1000, "storage_mode": mode}, expected_size=20_000)
    index.add({"ids": [f"r{i}" for i in range(600)], "vectors": x[:600]})
    assert index.get_storage_mode() == "raw_collecting_for_training" and index.training_vectors_needed() == 400
    index.add({"ids": [f"r{i}" for i in range(600, 1500)], "vectors": x[600:], "metadatas": [{"n": i} for i in range(600, 1500)]})
    assert index.get_storage_mode() == "quantized_active" and index.is_quantized()
    queries = x[:30] + 0.01
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [set(np.argsort(r, kind="stable")[:10]) for r in block_distances("cosine", queries.astype(float), x.astype(float))]
    recall = lambda pages: np.mean([len({int(h["id"][1:]) for h in p} & w) / 10 for p, w in zip(pages, want, strict=True)])
    assert recall(index.search(queries)) > (0.95 if mode == "quantized_with_raw" else 0.35)
    assert recall(index.search(queries, rerank=0)) < 0.95
    found = index.search(queries[0], filter={"n": {"lt": 700}}, return_vector=True)
    assert all(abs(h["score"] - max(0, 1 - h["vector"] @ (queries[0] / np.linalg.norm(queries[0])))) < 1e-4 for h in found)
    if mode == "quantized_with_raw":
        assert np.allclose(index.get_records("r3")[0]["vector"], unit[3], atol=1e-6)
        assert int(index.get_stats()["rerank_default_fetch"]) >= 250
    index.add({"id": "late", "vector": x[0].tolist()})
    assert index.update_metadata("r1", {"k": 1}) and index.count() == 1501
    before = index.search(queries, top_k=5)
    index.save(str(tmp_path / "saved"))
    again = db.load(str(tmp_path / "saved"))
    assert again.search(queries, top_k=5) == before and again.get_stats() | {"segments": ""} == index.get_stats() | {"segments": "", "stranded_graph_nodes": "0", "graph_nodes": "1501"}


def test_persistence(db, tmp_path):
    index = quick(db, indexed_fields=["author"])
    index.add_metadata({"owner": "x"})
    path = str(tmp_path / "c")
    index.save(path)
    index.remove_point("doc_001")
    index.save(path)
    again = db.load(path)
    assert db.get_index_info(path)["count"] == 4
    assert again.list(10) == index.list(10) and again.get_all_metadata() == {"owner": "x"} and again.indexed_fields == ["author"]
    assert again.add([[1.0] * 8]).ids == ["vec_1"]
    file = next((tmp_path / "c" / "records").glob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    for crc in (tmp_path / "c" / "records").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="damaged"):
        db.load(path)
    (tmp_path / "c" / "manifest.json").unlink()
    with pytest.raises(FileNotFoundError):
        db.load(path)


def test_interrupted_save(db, tmp_path):
    index = quick(db)
    index.save(str(tmp_path / "c"))
    (tmp_path / "c").rename(tmp_path / "c.old")
    assert len(db.load(str(tmp_path / "c"))) == 5


def test_cells(db):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 8))
    x = (centres[rng.integers(0, 30, 2000)] + 0.2 * rng.standard_normal((2000, 8))).astype(np.float32)
    index = db.create(dim=8, space="l2")
    index.add({"ids": [str(i) for i in range(2000)], "vectors": x})
    exact = index.search(x[:40], top_k=10)
    assert index.rebuild(m=16) == 2000
    share = lambda pages: np.mean([len({h["id"] for h in a} & {h["id"] for h in b}) / 10 for a, b in zip(pages, exact, strict=True)])
    few, more = share(index.search(x[:40], top_k=10, ef_search=50)), share(index.search(x[:40], top_k=10, ef_search=400))
    assert 0.3 < few <= more and more > 0.9
    assert index.search(x[:40], top_k=10, ef_search=2000) == exact
    index.add({"id": "new", "vector": x[0].tolist()})
    assert {h["id"] for h in index.search(x[0], top_k=2, ef_search=50)} == {"0", "new"}
    with pytest.raises(ValueError):
        index.rebuild()


def test_frames_and_streams(db, spark, tmp_path):
    from orrery.streaming.upsert import stream_into

    index = db.create(dim=2, space="l2")
    rows = [("a", [1.0, 2.0], '{"x": 1}'), ("b", [1.0], "{}"), (None, [3.0, 4.0], None), ("a", [9.0, 9.0], "{}"), ("n", [float("nan"), 1.0], "{}")]
    r = index.add_frame(spark.createDataFrame(rows, "id string, vector array<double>, metadata string"))
    assert (r.total_inserted, r.total_errors) == (2, 3)
    assert index.count({"x": 1}) == 1 and index.count() == 2
    spark.createDataFrame([("a", [7.0, 7.0], '{"x": 2}'), ("s", [8.0, 8.0], "{}")], "id string, vector array<double>, metadata string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, vector array<double>, metadata string").parquet(str(tmp_path / "in"))
    query = stream_into(stream, index, str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    assert index.count() == 3 and index.get_records("a")[0]["metadata"] == {"x": 2}


def test_create_checks(db):
    with pytest.raises(TypeError):
        db.create()
    for bad in ({"index_type": "flat", "dim": 2}, {"dim": 8, "quantization_config": {"type": "pq", "subvectors": 3}}, {"dim": 2, "indexed_fields": "ab"}, {"dim": 2, "indexed_fields": ["$or"]}):
        with pytest.raises(ValueError):
            db.create(**bad)
    for bad in ({"dim": 0}, {"dim": 2, "space": "x"}, {"dim": 2, "m": 1}):
        with pytest.raises(RuntimeError):
            db.create(**bad)
    with pytest.warns(UserWarning):
        db.create(dim=2, m=100, ef_construction=200)
    from orrery.plans.config import default_subvectors

    assert [default_subvectors(d) for d in (64, 128, 256, 768, 1536, 3072)] == [8, 8, 8, 24, 48, 96]
    assert db.available_index_types() == ["hnsw"] and db.create(dim=4, expected_size=30_000).m == 32


def test_values_round_trip(db):
    index = db.create(dim=1, space="l2")
    index.add({"id": "a", "vector": [1], "metadata": {"big": 2**70, "nan": float("nan"), "t": (1, 2), "deep": {"k": [1, None, {"z": 2.5}]}, "neg": float("-inf")}})
    got = index.get_records("a")[0]["metadata"]
    assert got == {"big": float(2**70), "nan": "NaN", "t": "(1, 2)", "deep": {"k": [1, None, {"z": 2.5}]}, "neg": "-inf"}
    assert json.dumps(got)
