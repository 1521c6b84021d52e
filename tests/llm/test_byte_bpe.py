import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.byte_bpe import ByteBpe, bpe_ids, read_ranks

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
CODER = ByteBpe(RANKS, P.PATTERN)
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x1c\x1f\x85  'stmdlrev▁<unk>é"))))
def test_like_tiktoken(text):
    raw = CODER.encode([text])[0]
    assert ids(raw) == ORACLE.encode_ordinary(text)
    assert CODER.decode(raw) == text.encode()


def test_every_vocabulary_entry_and_long_words():
    texts = [b.decode() for b in CODER.ranks if b.decode("utf-8", "ignore").encode() == b] + ["a" * 50_000, "xy" * 20_000, "Ā" * 3000]
    for text, raw in zip(texts, CODER.encode(texts), strict=True):
        assert CODER.decode(raw) == text.encode()
    for text in texts[:3000] + texts[-3:]:
        assert ids(CODER.encode([text])[0]) == ORACLE.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "y"), (None, "ß", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe_ids(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        e = ORACLE.encode_ordinary(text or "")
        want.append((doc_id, len(e), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_ids(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).count() == 0


def test_bad_ranks():
    from orrery.llm.byte_bpe import serialise_model

    with pytest.raises(ValueError):
        serialise_model({b"a": 0, b"b": 2})


def test_very_long_texts_and_documents(spark):
    """A text of 200,000 words, one word of 300,000 characters, and a real table, through the registered path, as tiktoken has them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, " ".join(f"w{i}" for i in range(200_000))), (-2, "z" * 300_000)]
    got = {r.doc_id: r for r in bpe_ids(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for doc_id, text in rows:
        if doc_id == -2:  # the oracle takes time that grows with the square of a word
            assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
            continue
        e = ORACLE.encode_ordinary(text)
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(e), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest())
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
