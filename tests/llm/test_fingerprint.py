import hashlib
import random
import re

from pyspark.sql import functions as F

from orrery.llm import fingerprint as fp
from orrery.llm.fingerprint import INNER, K, _bucket, anchors, fingerprint, fingerprints, likeness, shift_votes

SF = "/root/testdata/sf0.01"


def test_closed_syncmers(spark):
    """The choice of anchors against plain loops over Spark's own hashes; windows hold one; positions and hashes are what the string says."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in (0, 1, 8, 9, 10, 40, 300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", anchors(F.col("text")).alias("a")).select("doc_id", "a", fingerprint(F.col("a")).alias("f")).collect()}
    words = sorted({w for t in texts for w in t.split()})
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {r.p: r.h for r in spark.createDataFrame([(f"{a} {b}", one[a], one[b]) for a in words for b in words], "p string, a long, b long").select("p", F.xxhash64("a", "b").alias("h")).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        inner = [pairs[f"{a} {b}"] for a, b in zip(w, w[1:], strict=False)]
        want = [j + 1 for j in range(len(w) - K + 1) if min(inner[j : j + INNER]) in (inner[j], inner[j + INNER - 1])] if len(w) >= K else [1] * bool(w)
        assert [a.at for a in got[i].a] == want
        assert all(b - a <= INNER for a, b in zip(want, want[1:], strict=False))
        gaps = [b - a for a, b in zip([1, *want], want, strict=False)]
        assert got[i].f == "".join(f"{g:x}{a.hash:08x}" for g, a in zip(gaps, got[i].a, strict=True))


def test_likeness_and_shift(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    rows = [(" ".join(words), " ".join(["new"] * 7 + words)), (" ".join(words), "other words"), ("", " "), ("", "a")]
    df = spark.createDataFrame(rows, "x string, y string").select(anchors(F.col("x")).alias("a"), anchors(F.col("y")).alias("b"))
    got = df.select(likeness(F.col("a"), F.col("b")).alias("l"), shift_votes(F.col("a"), F.col("b")).alias("s")).collect()
    assert got[0].l > 0.9 and max(got[0].s, key=got[0].s.get) == 7
    assert [r.l for r in got[1:]] == [0, 1, 0]


def test_buckets(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 100):
        bounds = sorted(rng.sample(range(1000), n))
        df = spark.range(0, 1001).withColumnRenamed("id", "doc_id")
        assert all(r.b == sum(x < r.doc_id for x in bounds) for r in df.select("doc_id", _bucket(bounds).alias("b")).collect())


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1] or ""), hashlib.sha256((r[1] or "").encode()).hexdigest()))


def check(got, rows):
    rows = order(rows)
    want = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (2_000, 37):
        monkeypatch.setattr(fp, "BUCKET_ROWS", size)
        got = fingerprints(docs).collect()
        check(got, rows)
    by, texts = {r.doc_id: r for r in got}, dict(rows)
    seen = {}
    for i, r in by.items():
        assert seen.setdefault(texts[i], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for i, r in by.items() if len(re.findall(r"\S+", texts[i])) > 200]
    assert sum(0.15 < r.near_edited < 0.7 for r in long) > 0.9 * len(long)
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, "one text é here"), (1, "one text é here"), (1, "else"), (None, "lost"), (None, None), (5, None), (6, ""), (7, "w " * 60_000), (8, "日本 語 \U0001f600 x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, next_text string")
    for size in (2_000, 2):
        monkeypatch.setattr(fp, "BUCKET_ROWS", size)
        check(fingerprints(df).collect(), rows)
    assert fingerprints(df.limit(0)).count() == 0
    one = fingerprints(df.filter("doc_id = 8")).first()
    assert one.near_next == 1 and one.n_chars == 8
    assert fingerprints(df.filter("doc_id is null")).count() == 2


def test_short_and_unspaced_texts_keep_anchors(spark):
    """Half of a text of any length is unchanged, in words or without spaces, and some of its anchors are."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (*range(1, 80), 200)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (3, 4, 5, 10, 15, 16, 17, 40, 900)]
    texts += [" ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(40)) for _ in range(70)), "\U0001f600\U0001f601\U0001f602 \U0001f603"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints(df).collect()}
    assert [i for i in got if not 0.05 < got[i].near_edited < 1] == []
    assert sum(got[i].near_edited > got[i].near_next for i in got) == len(got)


def test_short_documents_keep_anchors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = [r for r in fingerprints(docs).collect() if 0 < len(texts[r.doc_id].split()) <= 26 and r.n_chars > 2]
    assert short and all(r.near_edited > 0 for r in short)


def plain_likeness(a, b):
    """Of (at, hash) lists: of all pairs of equal anchors that stand next to each other by place, the commonest shift."""
    if not a and not b:
        return 1.0, {}
    places = {}
    for side, found in enumerate((a, b)):
        for at, h in found:
            places.setdefault(h, []).append((at, side))
    votes = {}
    for rows in places.values():
        rows.sort()
        for (p, x), (q, y) in zip(rows, rows[1:], strict=False):
            if x != y:
                d = q - p if x == 0 else p - q
                votes[d] = votes.get(d, 0) + 1
    n = max(votes.values(), default=0)
    return n / (len(a) + len(b) - n), votes


def test_positional_matching_against_plain_python(spark):
    rng = random.Random(12)
    make = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    rows = []
    for n in (0, 1, 5, 12, 40, 150, 400):
        base = make(n, 500)
        rows += [(base, base), (base, make(9, 500) + " " + base), (base + " " + make(n, 500), base), (base, make(n, 500)), (make(n, 2), make(n, 2)), (base + " " + base, base)]
    df = spark.createDataFrame(rows, "x string, y string").select(anchors(F.col("x")).alias("a"), anchors(F.col("y")).alias("b"))
    for r in df.select("a", "b", likeness(F.col("a"), F.col("b")).alias("l"), shift_votes(F.col("a"), F.col("b")).alias("s")).collect():
        want, votes = plain_likeness([tuple(x) for x in r.a], [tuple(x) for x in r.b])
        assert abs(r.l - want) < 1e-12 and (r.s or {}) == votes
        if r.a == r.b:
            assert r.l == 1


def test_passages_in_another_order_are_less_alike(spark):
    rng = random.Random(5)
    parts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(100)) for _ in range(6)]
    df = spark.createDataFrame([(" ".join(parts), " ".join(parts[::-1])), (" ".join(parts), "new " + " ".join(parts))], "x string, y string")
    other, same = (r.l for r in df.select(likeness(anchors(F.col("x")), anchors(F.col("y"))).alias("l")).collect())
    assert other < 0.2 and same > 0.9


def test_near_columns_on_documents(spark):
    """near_edited and near_next of the registered query against anchors compared in plain Python."""
    from orrery.llm.fingerprint import grain

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = order([(r.doc_id, r.text) for r in docs.collect()])
    pairs = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        pairs.append((doc_id, text, text[: len(text) - half] + after[:half], after))
    taken = spark.createDataFrame(pairs, "doc_id long, text string, edited string, next string").withColumn("g", grain(F.col("text")))
    found = {r.doc_id: r for r in taken.select("doc_id", *(anchors(F.col(c), F.col("g")).alias(c) for c in ("text", "edited", "next"))).collect()}
    for r in fingerprints(docs).collect():
        a, edited, after = ([tuple(x) for x in found[r.doc_id][c]] for c in ("text", "edited", "next"))
        assert abs(r.near_edited - plain_likeness(a, edited)[0]) < 1e-12
        assert abs(r.near_next - plain_likeness(a, after)[0]) < 1e-12


def test_hot_ids(spark, monkeypatch):
    """One id, and null, hold most rows, with texts of many lengths and many copies; the order and the copies' next ones are as in plain Python."""
    rng = random.Random(21)
    text = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 3, 10, 30])))
    rows = [(i, text()) for i in range(60)] + [(-9, "low"), (2**62, "high")]
    rows += [(7, text()) for _ in range(150)] + [(7, "same text here")] * 120 + [(None, text()) for _ in range(90)] + [(None, None)] * 60 + [(30, "b")] * 50
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, copies int")
    monkeypatch.setattr(fp, "BUCKET_ROWS", 5)
    for parts in (1_024, 4):
        monkeypatch.setattr(fp, "PARTS", parts)
        got = fingerprints(df.repartition(4)).collect()
        check(got, rows)
    least = [r for r in got if r.doc_id == 30 and r.n_chars == 1]
    assert len(least) == 50 and sum(r.near_next == 1 for r in least) >= 49


def test_edits_alone_need_no_anchors(spark):
    """Who wants the edited texts only pays for no word hashes."""
    from orrery.llm.fingerprint import fingerprints

    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(500)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    whole = fingerprints(docs)
    assert "split(" in plan(whole) and "split(" not in plan(whole.select("doc_id", "n_chars", "edited_sha256"))
