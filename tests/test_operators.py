import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions.metrics import SPACES, block_distances, distance, normalise
from orrery.operators.ivf import cell_count, fit_cells, probes
from orrery.operators.quantize import AsymmetricDistance, assign, encode_block, kmeans, reconstruct_block, symmetric_distance, train
from orrery.operators.rerank import Calibration, calibrate, fetch_count, page_scale
from orrery.operators.topk import Pool, topk


@pytest.mark.parametrize("space", SPACES)
@pytest.mark.parametrize("n", [0, 1, 37])
def test_topk_with_ties(spark, space, n):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (n, 3)).astype(float)
    q = rng.integers(-2, 3, (5, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, query array<float>")
    scores = np.round(block_distances(space, q, x), 6) + 0.0 if n else np.zeros((5, 0))
    want = [(qi, r + 1, int(i), scores[qi, i]) for qi in range(5) for r, i in enumerate(np.lexsort((np.arange(n), scores[qi]))[:4])]
    for native in (False, True):
        got = sorted(map(tuple, topk(rows, queries, space, 4, 6, native).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert topk(rows, queries, space, 0).count() == 0 and topk(rows, queries.limit(0), space, 3).count() == 0


def test_topk_in_blocks(spark, monkeypatch):
    from orrery.operators import topk as module

    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    queries = rows.filter("id < 25").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    whole = sorted(map(tuple, topk(rows, queries, "l2", 5, 6).collect()))
    monkeypatch.setattr(module, "QUERY_BLOCK", 7)
    monkeypatch.setattr(module, "CELLS", 50)
    assert sorted(map(tuple, topk(rows, queries, "l2", 5, 6).collect())) == whole
    with pytest.raises(ValueError):
        topk(rows, queries, "l2", 5, native=True)


def test_pool_keeps_ties_and_prunes():
    rng = np.random.default_rng(0)
    scores = np.round(rng.random((3, 40_000)), 2)
    pool = Pool(3, 5, 0.0)
    for i in range(0, 40_000, 1000):
        pool.add(scores[:, i : i + 1000], np.arange(i, i + 1000))
    pool.prune()
    q, s, r = pool.held
    for j in range(3):
        bar = np.sort(scores[j])[4]
        assert sorted(r[q == j]) == np.flatnonzero(scores[j] <= bar).tolist()


def test_expressions_like_blocks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 20, 6)).astype(np.float32)
    a[3] = 0
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<float>, b array<float>")
    for space in SPACES:
        got = [r[0] for r in df.select(distance(space, F.col("a"), F.col("b"))).collect()]
        assert np.allclose(got, np.diag(block_distances(space, a.astype(float), b.astype(float))))
    unit = np.array([r[0] for r in df.select(normalise(F.col("a"))).collect()])
    assert np.allclose(np.delete(np.linalg.norm(unit, axis=1), 3), 1) and not unit[3].any()


def test_kmeans():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 5)) * 10
    x = centres[rng.integers(0, 8, 900)] + 0.1 * rng.standard_normal((900, 5))
    found = kmeans(x, 8)
    assert (kmeans(x, 8) == found).all()
    assert assign(x, found)[1] < 0.2
    assert kmeans(np.ones((5, 2)), 3).shape == (3, 2)


def test_codes(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, vector array<float>")
    book = train(df, 4, 4)
    assert (book == train(df.repartition(5), 4, 4)).all() and book.shape == (4, 16, 2)
    codes = encode_block(x, book)
    parts = x.reshape(400, 4, 2)
    for s in range(4):
        d = ((parts[:, s, None] - book[s]) ** 2).sum(2)
        assert (d[np.arange(400), codes[:, s]] <= d.min(1) + 1e-6).all()
    made = reconstruct_block(codes, book)
    batch = pa.RecordBatch.from_pydict({"code": pa.array([c.tobytes() for c in codes], pa.binary())})
    q = rng.standard_normal((3, 8))
    assert np.allclose(AsymmetricDistance(q, book).scores(batch), ((q[:, None] - made[None]) ** 2).sum(2), atol=1e-5)
    assert np.allclose(symmetric_distance(codes[:5], codes[5:9], book), ((made[:5, None] - made[None, 5:9]) ** 2).sum(2), atol=1e-5)


def test_fetch_rules():
    assert fetch_count(10, 1000, 3, None) == 30 and fetch_count(10, 5, 3, None) == 10
    assert fetch_count(10, 100_000, None, None) == 2000 and fetch_count(100, 1000, None, None) == 500
    c = Calibration(400, 10_000, 512, 0.5, [200, 280, 340, 400], [100, 400, 1600])
    assert page_scale(5, c) == 1 and page_scale(100, c) == pytest.approx(4) and page_scale(1000, c) <= 100
    assert fetch_count(10, 40_000, None, c) == 1400 and fetch_count(10, 900, None, c) == 250
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = np.stack([kmeans(x[:, i : i + 2].astype(float), 16) for i in range(0, 8, 2)]).astype(np.float32)
    measured = calibrate("cosine", x, book)
    assert 10 <= measured.fetch <= 1200 and 0.4 <= measured.exponent <= 1 and measured.page_fetches == sorted(measured.page_fetches)


def test_probes():
    centres = np.array([[0.0], [10.0], [20.0]])
    assert probes(np.array([[1.0], [19.0]]), centres, 1, 300).tolist() == [[True, False, False], [False, False, True]]
    assert probes(np.array([[1.0]]), centres, 300, 300).all()
    assert fit_cells(np.arange(50.0)[:, None], 4).shape == (4, 1) and cell_count(10_000, 16) == 100


def test_neighbour_lists(spark):
    from orrery.operators.graph import neighbour_lists

    rng = np.random.default_rng(9)
    x = rng.standard_normal((80, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = rows.filter("id < 6").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    got = {}
    for r in neighbour_lists(rows, queries, "l2", 20, 5).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append(r.id)
    d = block_distances("l2", x, x)
    for q in range(6):
        kept = []
        for i in [i for i in np.argsort(d[q]) if i != q][:20]:
            if len(kept) < 5 and all(d[i, j] >= d[q, i] for j in kept):
                kept.append(int(i))
        assert got[q] == kept


def test_cells_keep_their_recall_where_vectors_have_none(spark):
    """Vectors without clusters: a search by few candidates reads as many cells as its sample needs, and still not all."""
    from orrery import VectorDatabase

    rng = np.random.default_rng(9)
    x = rng.standard_normal((3_000, 16)).astype(np.float32)
    index = VectorDatabase(spark).create(dim=16)
    index.add({"ids": [str(i) for i in range(3_000)], "vectors": x})
    queries = x[::20] + 0.01
    exact = index.search_matrix(queries, top_k=10).collect()
    index.rebuild(m=16)
    found = index.search_matrix(queries, top_k=10, ef_search=20).collect()
    assert len({(r.qid, r.id) for r in found} & {(r.qid, r.id) for r in exact}) >= 0.9 * len(exact)
    assert index._state.probes[0] < len(index._state.cells)


def test_columns_come_along(spark, monkeypatch):
    """Kept columns belong to their rows, however often a task lets go of rows that are no candidates."""
    from orrery.operators import topk as module

    monkeypatch.setattr(module, "STORED", 50)
    rng = np.random.default_rng(10)
    x = rng.standard_normal((2_000, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), f"note {i}") for i, v in enumerate(x)], "id long, vector array<float>, note string").repartition(3)
    got = module.scored_topk(rows, ["a", "b"], module.Exact("l2", x[:2].astype(float)), 7, "string", keep=("note", "vector")).collect()
    assert len(got) == 14
    for r in got:
        assert r.note == f"note {r.id}" and np.allclose(r.vector, x[r.id])
    for q, name in enumerate("ab"):
        want = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:7].tolist()
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.qid == name] == want


def test_bounds_hold_the_fetch(spark):
    """Within a bound lie as many rows as are to be fetched, and few more, even where the sample that laid the bins misleads."""
    from orrery.operators.quantize import encode
    from orrery.operators.rerank import code_bounds

    rng = np.random.default_rng(11)
    x = rng.standard_normal((3_000, 8)).astype(np.float32)
    book = np.stack([kmeans(x[:, i : i + 2].astype(float), 16) for i in range(0, 8, 2)]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    codes, q = encode_block(x, book), x[:7].astype(float)
    table = ((q.reshape(7, 4, 1, 2) - book.astype(float)[None]) ** 2).sum(3)
    far = sum(table[:, i, :][:, codes[:, i]] for i in range(4))
    for sample, most in ((codes[::3], 330), (codes[:5], 3_000)):
        bounds = code_bounds(encode(rows, book, ("vector",)), q, book, 300, 3_000, sample)
        held = (far <= bounds[:, None]).sum(1)
        assert (held >= 300).all() and (held <= most).all()
    assert np.isinf(code_bounds(rows, q, book, 3_000, 3_000, codes)).all()


def test_native_scoring_of_many_queries(spark, monkeypatch):
    from orrery.operators import topk as module

    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 4)))], "id long, vector array<float>")
    queries = rows.filter("id < 25").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    whole = sorted(map(tuple, topk(rows, queries, "cosine", 5, 6).collect()))
    monkeypatch.setattr(module, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, module.native_topk(rows, queries, "cosine", 5, 6).collect())) == whole
