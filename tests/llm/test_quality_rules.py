import random
import re

import numpy as np
import pytest

from orrery.llm.quality_rules import FEATURES, Trees, fit_trees, grow, measure, quality_rules, repeat_words

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


@pytest.mark.parametrize("seed", range(60))
def test_statistics(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "bb", " ", " ", "\n", "\t", "\x1c", " ", "é#", "|"]) for _ in range(rng.randrange(0, 400)))
    assert measure(text)[0] == brute(text)


def test_repeats_overlap():
    assert repeat_words(["a"] * 8) == 0
    assert repeat_words(["a"] * 9) == 9
    assert repeat_words(list("abcdefgh") * 2) == 16
    assert repeat_words(list("abcdefgh")) == 0


def test_monotone_and_flat():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * rng.random(3000) < 0.6).astype(float)
    trees = grow(x, y, [-1, 1, 0])
    assert (((trees.score(x) > 0.5) == (y > 0)).mean()) > 0.85
    at = np.repeat(rng.random((50, 3)), 40, 0)
    for j, sign in ((0, -1), (1, 1)):
        line = at.copy()
        line[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(trees.score(line).reshape(50, 40), axis=1) >= -1e-12).all()

    def walk(row, t):
        k = 0
        while k < trees.feature.shape[1]:
            k = 2 * k + 1 + (row[trees.feature[t, k]] > trees.threshold[t, k])
        return trees.leaf[t, k - trees.feature.shape[1]]

    want = [trees.start + sum(walk(row, t) for t in range(len(trees.feature))) for row in x[:50]]
    assert np.allclose(trees.score(x[:50]), 1 / (1 + np.exp(-np.array(want))))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = labels.filter("doc_id % 2 = 1")
    trees = fit_trees(docs, odd)
    assert isinstance(trees, Trees) and trees.feature.max() < len(FEATURES)
    got = quality_rules(docs, odd, trees=trees).join(labels.filter("doc_id % 2 = 0"), "doc_id").filter("not base_failed").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95


def test_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "x"), (1, good, "x"), (None, good, "y"), (2, None, "z"), (3, "", "z"), (4, "w " * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = quality_rules(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *brute(dict((a, b) for a, b, _ in rows)[r.doc_id]), r.base_failed) for r in got if r.doc_id != 4) == sorted((i is None, i or 0, *brute(t), len((t or "").split()) < 20) for i, t, _ in rows if i != 4)
    assert [(r.n_words, r.n_repeat_words, r.kept) for r in got if r.doc_id == 4] == [(100_000, 100_000, False)]
    assert all(r.kept for r in got if not r.base_failed)
    assert quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_verdicts_against_brute_force(spark):
    """kept and score of every document: statistics and features in plain Python, then a walk down every tree."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trees = fit_trees(docs, labels)
    got = {r.doc_id: r for r in quality_rules(docs, labels, trees=trees).collect()}
    for r in docs.collect():
        n, chars, symbols, dup, repeats = brute(r.text)
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", r.text), [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        per, share = 1 / max(1, n), 1 / max(1, chars)
        x = [np.log1p(n), chars * per, symbols * share, r.text.count("|") * share, sum(len(w) > 1 and w.isupper() for w in words) * per, r.text.count("!") * share, dup / max(1, len(lines)), repeats * per]
        x += [sum(a == b for a, b in zip(words, words[1:], strict=False)) * per, len(set(words)) * per, min(200.0, n / max(1, len(lines))), sum(w.isdigit() for w in words) * per]
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + (x[feature[k]] > threshold[k])
            total += leaf[k - len(feature)]
        score = 1 / (1 + np.exp(-total))
        failed = n < 20 or 100 * repeats > 30 * n
        assert got[r.doc_id].base_failed == failed and abs(got[r.doc_id].score - score) < 1e-9
        assert got[r.doc_id].kept == (not failed and score >= 0.5)
