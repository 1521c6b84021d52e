"""Every registered query against its SQL in DuckDB, by columns, row counts and values."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(rows, columns, names):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "nan" if isinstance(v, float) and v != v else float(v) if isinstance(v, float) else v
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=str), [columns[i] for i in order]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = plain(df.collect(), df.columns, name)
    answer = duck.execute(ORACLES[name])
    want = plain(answer.fetchall(), [c[0] for c in answer.description], name)
    assert got[1] == want[1]
    assert got[0] == want[0]


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLES and not k.startswith("op") and k != "pipeline"))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    """The stated query set of 500 vectors, ten neighbours each."""
    assert entry.entry(spark).count() == 250


def test_approximate_recall(spark):
    rows = lambda name: {(r.qid, r.id) for r in QUERIES[name](spark, SF).collect()}
    exact = rows("topk_cosine")
    assert len(exact & rows("ivf_topk_few")) > 0.5 * len(exact)


def test_cells_find_nine_in_ten(spark):
    for d in (SF, "/root/testdata/sf0.1"):
        rows = lambda name: {(r.qid, r.id) for r in QUERIES[name](spark, d).collect()}  # noqa: B023, E731
        exact = rows("topk_cosine")
        assert len(exact & rows("ivf_topk_few")) >= 0.9 * len(exact)


def test_trained_rerank_finds_nine_in_ten(spark):
    for d in (SF, "/root/testdata/sf0.1"):
        rows = lambda name: {(r.qid, r.id) for r in QUERIES[name](spark, d).collect()}  # noqa: B023, E731
        exact = rows("topk_l2")
        assert len(exact & rows("rerank_topk_trained")) >= 0.9 * len(exact)


def test_calibration_sample_is_no_prefix(spark, monkeypatch):
    from orrery import queries

    seen = []
    monkeypatch.setattr(queries, "hashed", lambda rows, most, old=queries.hashed: seen.append([r.id for r in old(rows, 100).collect()]) or old(rows, most))
    queries.q_calibrate(spark, SF)
    assert len(seen[0]) == 100 and max(seen[0]) > 300


@pytest.mark.parametrize("name", ["collection_topk_rescored", "collection_topk_cells"])
def test_searches_beyond_the_fixed_limits(spark, duck, monkeypatch, name):
    """A collection of more records than the fixed limits can still be read whole."""
    from orrery import collection

    monkeypatch.setattr(collection, "MAX_TOP_K", 100)
    monkeypatch.setattr(collection, "MAX_EF_SEARCH", 100)
    test_like_sql(spark, duck, name)


def test_batch_ranks_rounded_scores(spark, duck, tmp_path):
    """Scores that are the same at four digits are ties, and go by id."""
    duck.execute("CREATE OR REPLACE TEMP TABLE near AS SELECT k AS c_custkey, 'x' AS c_name, 0 AS c_nationkey, b::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM (VALUES (0, 10.02), (1, 10.01), (2, 10.03), (3, 9.99), (4, 10.05), (5, 10.02), (6, 10.07), (7, 9.97), (8, 10.12), (9, 9.92)) v(k, b)")
    duck.execute(f"COPY near TO '{tmp_path}/customer.parquet'")
    df = QUERIES["collection_topk_batch"](spark, str(tmp_path))
    want = duck.execute(ORACLES["collection_topk_batch"].replace("FROM customer", "FROM near"))
    assert plain(df.collect(), df.columns, "")[0] == plain(want.fetchall(), [c[0] for c in want.description], "")[0]


def test_rebuild_removes_whatever_the_keys(spark, duck, tmp_path):
    """Keys beyond 20,000 and with gaps are removed before and after the rebuild too."""
    duck.execute(f"COPY (SELECT 30_000 + 3 * c_custkey AS c_custkey, * EXCLUDE c_custkey FROM customer) TO '{tmp_path}/customer.parquet'")
    df = QUERIES["rebuild_and_search"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.execute(ORACLES["rebuild_and_search"])
    assert plain(df.collect(), df.columns, "")[0] == plain(want.fetchall(), [c[0] for c in want.description], "")[0]


def test_rebuild_is_searched(spark, monkeypatch):
    """The page comes from a search by the cells that were made, after the removals."""
    from orrery.operators import topk

    seen = []
    monkeypatch.setattr(topk.Probed, "__init__", lambda self, *a, old=topk.Probed.__init__: seen.append(1) or old(self, *a))
    rows = QUERIES["rebuild_and_search"](spark, SF).filter("rank is not null").orderBy("rank").collect()
    assert seen and [r["rank"] for r in rows] == list(range(1, 101)) and rows[0].id == 40 and not any(r.id % 11 == 0 for r in rows)
