import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm.toxicity import BlockMaxIndex, Vocabulary, count_terms, fit_toxicity, isotonic, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(8))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    terms, n = 60, 500
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.07)
    if seed % 2:
        dense = np.round(dense, 1)
    dense[rng.integers(0, n, 150)] = dense[0]
    dense[0, 5] += 0.5
    norms = np.sqrt((dense**2).sum(1))
    dense = dense[norms > 0] / norms[norms > 0, None]
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in dense]
    index = BlockMaxIndex(vectors, terms)
    for q in range(0, len(dense), 11):
        for k, without in ((1, -1), (10, -1), (25, q)):
            cosines = np.minimum(1.0, dense @ dense[q])
            order = [i for i in np.lexsort((np.arange(len(dense)), -np.round(cosines, 9))) if cosines[i] > 1e-12 and i != without][:k]
            ids, scores = index.nearest(*vectors[q], k, without)
            assert np.allclose(np.sort(scores), np.sort(cosines[order]))
            assert ids.tolist() == order


def test_blocks_are_skipped():
    vectors = [(np.array([i % 10]), np.array([1.0])) for i in sorted(range(5000), key=lambda i: i % 10)]
    index = BlockMaxIndex(vectors, 10)
    assert (index.bounds(np.array([3]), np.array([1.0])) > 0).sum() <= 10
    assert len(index.nearest(np.array([3]), np.array([1.0]), 25)[0]) == 25


def test_terms():
    assert count_terms("Idiots idiots a2b")["idi*"] == 2
    vocabulary = Vocabulary(["idiot*@1", "idiot*@2", "b@1"])
    assert vocabulary.count("Idiots idiot idiotic b") == [(0, 2), (1, 1), (2, 1)]
    assert vocabulary.count("") == []


def test_isotonic():
    x, y = isotonic(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels, (3, 1)).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "you idiot fool" if i % 2 else "fine day here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity(docs, x, (3, 1)).collect()) for x in (labels, wrong))
    assert a == b


def test_odd_rows(spark):
    rng = random.Random(1)
    bad = lambda: " ".join(rng.choice(["foo", "bar", "baz"]) for _ in range(5)) + " scumbag"
    rows = [(i, bad() if i % 3 == 0 else "foo bar baz", "s") for i in range(90)] + [(None, bad(), "s"), (200, None, "s"), (201, "", "s"), (202, "fine " * 100_000, "s"), (203, bad(), None), (203, bad(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)] + [(None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == by[203].predicted == 1 and by[200].predicted == by[202].predicted == 0
    assert by[200].score == by[201].score and by[203].evidence[0].toxic == 1
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert fit_toxicity(docs, labels.filter("toxic = 0")).prior < 0.5


def test_scores_against_dense_brute_force(spark):
    """Final scores, from dense cosines with every labelled vector, sorted by (cosine, place), squared-cosine votes and the calibration."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, (3, 1))
    vocabulary = Vocabulary(model.terms)
    rows = docs.collect()
    got = {r.doc_id: r for r in toxicity(docs, labels, (3, 1), model=model).collect()}

    def dense(counts):
        v = np.zeros(len(model.terms))
        for i, n in counts:
            v[i] = (1 + np.log(n)) * model.idf[i]
        return v / max(np.sqrt((v**2).sum()), 1e-300)

    text = {r.doc_id: r.text for r in rows}
    index = np.stack([dense(vocabulary.count(text[i])) for i in model.ids])
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert [known[i] for i in model.ids] == model.labels.tolist()
    for r in rows:
        counts = vocabulary.count(r.text)
        if not counts:
            assert got[r.doc_id].score == model.prior and got[r.doc_id].evidence == []
            continue
        cosines = np.round(index @ dense(counts), 9)
        near = [i for i in np.lexsort((np.arange(len(cosines)), -cosines))[: model.k] if cosines[i] > 0]
        weights = cosines[near] ** 2
        vote = (weights * model.labels[near]).sum() / weights.sum()
        assert abs(got[r.doc_id].score - np.interp(vote, *model.points)) < 1e-6
        assert [e.doc_id for e in got[r.doc_id].evidence] == [model.ids[i] for i in near[:3]]
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_every_document_with_words_has_evidence(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels, (3, 1)).collect()
    model = fit_toxicity(docs, labels, (3, 1))
    vocabulary = Vocabulary(model.terms)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(bool(r.evidence) == bool(vocabulary.count(text[r.doc_id])) for r in got)
    assert sum(not r.evidence for r in got) < 0.03 * len(got)
    assert any("@1" in t and "*" not in t for t in model.terms)


def test_search_in_batches_is_search_one_by_one():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w**2).sum())))
    index = BlockMaxIndex(vectors, 40)
    queries = [vectors[i] for i in range(0, 700, 9)] + [(np.zeros(0, int), np.zeros(0))]
    ids, cosines = index.search(queries, 25)
    for q, i, c in zip(queries, ids, cosines, strict=True):
        one, near = index.nearest(*q, 25)
        assert i[i >= 0].tolist() == one.tolist() and c[i >= 0].tolist() == near.tolist()
    assert (ids[-1] == -1).all()


def test_rows_of_one_labelled_id_are_bounded(spark):
    from orrery.llm.quality_rules import labelled_sample
    from orrery.llm.scratch import Scratch

    docs = spark.createDataFrame([(1, f"text {i // 2}") for i in range(4000)] + [(2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 300, None, Scratch(spark)).collect()
    assert 200 < len(rows) < 420 and len(set(rows)) == len(rows)
