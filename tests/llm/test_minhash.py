import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import minhash
from orrery.llm.components import connected_components
from orrery.llm.minhash import PERMUTATIONS, estimate, near_duplicates, pack_bits, shingle_set, signatures
from orrery.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    """Components over all pairs that share a shingle."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    together = {}
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                together[h[x], h[y]] = together.get((h[x], h[y]), 0) + 1
    for (x, y), n in together.items():
        if 100 * n >= percent * (len(sets[x][1]) + len(sets[y][1]) - n):
            parent[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))


def test_sets_and_estimates(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(50)}" for _ in range(400)]
    assert len(shingle_set(" ".join(words), 4)) == len(shingles(" ".join(words), 4))
    assert (shingle_set("A b\tÄ d", 4) == shingle_set("a B Ä\x0cD", 4)).all()
    assert (shingle_set("a Ä b d", 4) != shingle_set("a ä b d", 4)).all()
    assert len(shingle_set("a b", 4)) == 1 and len(shingle_set(" \n", 4)) == 0
    assert shingle_set("a b", 4)[0] != shingle_set("a b c", 4)[0]
    base = np.random.default_rng(0).integers(0, 2**64, 4000, np.uint64)
    for shared in (0.3, 0.8, 1.0):
        sets = []
        for k in range(40):
            own = np.random.default_rng(k + 1).integers(0, 2**64, int(1000 * (1 - shared)), np.uint64)
            sets.append(np.unique(np.r_[base[: int(1000 * shared)], own]))
        bits = [[int(x) for x in row.view(np.int64)] for row in pack_bits(signatures(sets))]
        df = spark.createDataFrame([(bits[i], bits[i + 1]) for i in range(39)], "a array<long>, b array<long>")
        got = [r[0] for r in df.select(estimate(F.col("a"), F.col("b"))).collect()]
        want = shared / (2 - shared)
        assert abs(np.mean(got) - want) < 0.03 and np.max(np.abs(np.array(got) - want)) < 6 * (1 / PERMUTATIONS) ** 0.5


@pytest.mark.parametrize("chunk", [1000, 3])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(40)}" for _ in range(rng.choice([3, 8, 30, 80]))]
        for _ in range(rng.choice([1, 4, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5)}"
            base = words if rng.random() < 0.4 else base  # chains: each copy is of a copy
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, 4).collect())) == brute(rows, 4, 80)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, near_duplicates(df, 4).collect())) == brute(rows, 4, 80)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(5, "a b c d e", "x"), (3, "A b c D e", "x"), (7, None, "x"), (8, "", None), (9, " \n", "x"), (10, "a b", "x"), (11, "a b", "x"), (12, "a b c", "x"), (None, "q r s t", "x"), (None, "q r s t", "x"), (20, long, "x"), (21, long + " end", "x"), (3, "A b c D e", "x"), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(map(tuple, near_duplicates(df, 4).collect()), key=str)
    want = [(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True), (None, 1, None, True), (None, 1, None, True), (None, 1, 10, False), (20, 99_997, 20, True), (21, 99_998, 20, False)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0), 4).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(200 + i, 300) for i in range(50)] + [(400, 400)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(200, 250), 300], 200)}


def brute_keep(rows, width, percent):
    """For each component of rows with an id: its smallest id, and the shingle sets of that id's rows in it."""
    sets = [(i, frozenset(shingles(t, width))) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    groups = {}
    for k, (i, s) in enumerate(sets):
        groups.setdefault(find(k) if s else ("empty", i), []).append((i, s))
    out = []
    for members in groups.values():
        least = min(i for i, _ in members)
        out.append((least, {s for i, s in members if i == least}))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_one_of_each_where_texts_share_ids(spark, seed):
    """Unlike texts under one id are kept apart: every component keeps exactly one row, whatever the order of rows."""
    rng = random.Random(seed)
    texts = []
    for g in range(14):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1])):
                words[rng.randrange(60)] = f"x{rng.randrange(9)}"
            texts.append(" ".join(words))
    rows = [(rng.randrange(8), t) for t in texts] + [(1, ""), (1, None), (70, " "), (71, "a b"), (71, "a b"), (71, "c d")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, set_size string, digest string").repartition(3)
    got = minhash.keep_one_of_each(df, 5, 80)
    assert got.columns == df.columns
    got = [(r.doc_id, frozenset(shingles(r.text, 5))) for r in got.collect()]
    want = brute_keep(rows, 5, 80)
    assert len(got) == len(want)
    for i, s in want:
        assert sum((i, one) in got for one in s) >= 1
    assert all(any(i == j and s in many for j, many in want) for i, s in got)
    assert sorted(map(tuple, near_duplicates(df, 5).collect())) == brute([(i, t) for i, t in rows], 5, 80)


def test_lost_texts(spark):
    """(1, A), (1, B), (3, B'): A and B stay under id 1, B' goes."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    for rows in ([(1, a), (1, b), (3, b + " end")], [(3, b + " end"), (1, b), (1, a)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, minhash.keep_one_of_each(df).collect())) == [(1, a), (1, b)]
