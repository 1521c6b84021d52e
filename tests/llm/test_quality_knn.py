import numpy as np
from pyspark.sql import functions as F

from orrery.llm.quality_knn import TERMS, TRIGRAMS, LatentVotes, quality_votes, term_counts, weigh

SF = "/root/testdata/sf0.01"


def test_counts():
    a = term_counts(["", "ab", "abc", "abcd", "Äbc", "x x x x\nx x x x", "日本語"])
    assert a.shape == (7, TERMS)
    assert a[:, :TRIGRAMS].sum(1).tolist() == [0, 0, 1, 2, 1, 13, 1]
    assert (a[2] == a[6]).all() and (a[2] != a[4]).any()
    assert a[5, TRIGRAMS] == 4 * 7 and a[5, TRIGRAMS + 1] == 7.5


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.02, (300, TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 300).astype(float)
    idf = rng.random(TERMS) + 0.1
    model = LatentVotes(idf, counts, labels, 40, 15, 8)
    queries = np.concatenate([rng.poisson(0.02, (50, TERMS)), np.zeros((1, TERMS))]).astype(np.float32)
    got = model.score(queries)
    for q, score in zip(queries[:-1], got, strict=False):
        v = weigh(q[None], model.idf)[0] @ model.basis
        cosines = model.latent @ (v / np.linalg.norm(v))
        near = np.argsort(-cosines)[:15]
        w = np.maximum(cosines[near], 0) ** 8
        assert abs(score - ((w * labels[near]).sum() + 0.5 * model.prior) / (w.sum() + 0.5)) < 1e-4
    assert got[-1] == model.prior


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_votes(docs, labels, (5, 0)).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    good, bad = "Some usual words in a line of text.", "AAA!! BBB!! AAA!! BBB!! AAA!! BBB!!"
    rows = [(i, good if i % 2 else bad, "x") for i in range(40)] + [(None, bad, "x"), (50, None, "x"), (51, "", "x"), (52, good * 20_000, None), (53, bad, "x"), (53, bad, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (0, None)], "doc_id long, quality int")
    got = quality_votes(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == by[53].predicted == 0 and by[52].predicted == 1 and by[50].score == by[51].score == 0.5
    assert quality_votes(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_votes(docs, labels.limit(0)).collect()} == {0.5}


def test_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(8)
    counts = rng.poisson(0.02, (300, TERMS)).astype(np.float32)
    counts[100:200] = counts[:100]  # ties
    model = LatentVotes(rng.random(TERMS) + 0.1, counts, rng.integers(0, 2, 300).astype(float), 40, 15, 8)
    queries = np.concatenate([counts[:90], counts[:90], rng.poisson(0.02, (60, TERMS)).astype(np.float32)])
    whole = model.score(queries)
    assert np.abs(whole - np.concatenate([model.score(q[None]) for q in queries])).max() < 1e-9
    assert np.abs(whole[:90] - whole[90:180]).max() < 1e-9
