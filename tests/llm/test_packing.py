import random
from collections import defaultdict

import public_tokenizers as P
import pytest

from orrery.llm import packing
from orrery.llm.packing import best_fit, pack
from orrery.llm.wordpiece import token_counts

PATH = P.path("byte_bpe_50k.tiktoken")


def brute(pieces, capacity):
    """Plain best fit: of all compatible open bins the one with the least room, then the oldest."""
    bins, out = [], [None] * len(pieces)
    for k in sorted(range(len(pieces)), key=lambda k: -pieces[k][0]):
        n, s, c = pieces[k]
        fit = [(cap, b) for b, (cap, ss, cc) in enumerate(bins) if cap >= n and (s is None or s not in ss) and (c is None or c not in cc)]
        if fit:
            b = min(fit)[1]
        else:
            b = len(bins)
            bins.append([capacity, set(), set()])
        out[k] = (b, capacity - bins[b][0])
        bins[b][0] -= n
        bins[b][1].add(s)
        bins[b][2].add(c)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    pieces = [(rng.randrange(0, 101), rng.choice([None, "hot", "hot", *"abcdefgh"]), rng.choice([None, *range(200), 1, 1, 1])) for _ in range(300)]
    assert best_fit(pieces, 100) == brute(pieces, 100)


@pytest.mark.parametrize("size", [4000, 50])
def test_documents(spark, monkeypatch, size):
    monkeypatch.setattr(packing, "SHARD_ROWS", size)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.n_tokens for r in token_counts(df, PATH).collect()}
    source = {r.doc_id: r.source for r in df.collect()}
    text = {r.doc_id: " ".join(r.text.lower().split()) for r in df.collect()}
    rows = pack(df, PATH, 2048).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.bin_id].append(r)
    assert by.keys() == want.keys()
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.piece_start for r in pieces] == [2048 * r.piece for r in pieces]
        assert sum(r.piece_tokens for r in pieces) == want[i]
        assert all(r.piece_tokens == 2048 for r in pieces[:-1])
    for inside in bins.values():
        inside.sort(key=lambda r: (r.bin_offset, r.piece_tokens))
        end = 0
        for r in inside:
            assert r.bin_offset == end
            end += r.piece_tokens
        assert end <= 2048
        assert len({source[r.doc_id] for r in inside}) == len({text[r.doc_id] for r in inside}) == len(inside)


def test_odd_rows(spark):
    rows = [(1, "same words", "a", 1), (1, "same words", "b", 1), (2, "same  Words", None, 1), (None, "other", None, 1), (3, None, "a", 1), (4, "", None, 1), (5, "w " * 5000, "a", 1), (6, "q", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id long")
    got = pack(df, PATH, 1000).collect()
    assert sum(r.piece_tokens for r in got if r.doc_id == 5) == 5000 and len([r for r in got if r.doc_id == 5]) == 5
    assert len({r.bin_id for r in got if r.doc_id in (1, 2)}) == 3
    assert len([r for r in got if r.doc_id in (3, 4)]) == 2 and all(r.piece_tokens == 0 for r in got if r.doc_id in (3, 4))
    assert [r.piece_tokens for r in got if r.doc_id is None] == [1]
    assert pack(df.limit(0), PATH).count() == 0
    grouped = pack(df.withColumnRenamed("bin_id", "kin"), PATH, 1000, cluster="kin").collect()
    assert len({r.bin_id for r in grouped if r.doc_id != 6 and r.piece_tokens < 1000}) == len([r for r in grouped if r.doc_id != 6 and r.piece_tokens < 1000])


def test_bins_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    rows = df.collect()
    df = spark.createDataFrame(rows + rows[:30] + [rows[5]] * 100, df.schema)
    a, b = (sorted(map(tuple, pack(d, PATH, 2048).collect())) for d in (df, df.orderBy("text").repartition(7)))
    assert a == b
    assert len({r[4] for r in a if r[0] == rows[5].doc_id}) >= 101


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, "x", "a")], "doc_id long, text string, source string")
    got = pack(df, PATH, 2048).collect()
    assert sum(r.piece_tokens for r in got if r.doc_id == 1) == 400_000
    assert len({r.bin_id for r in got}) == len(got)
