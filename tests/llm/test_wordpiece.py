import random
import re

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.byte_bpe import parse_ranks, read_ranks
from orrery.llm.wordpiece import LongestMatch, token_counts, word_counts, word_vocabulary

PATH = P.path("byte_bpe_50k.tiktoken")
VOCABULARY = word_vocabulary(parse_ranks(read_ranks(PATH)))
LONGEST = max(map(len, VOCABULARY[0] | VOCABULARY[1]))


def greedy(word, starts, continuations):
    at = n = 0
    while at < len(word):
        pieces = continuations if at else starts
        end = next((e for e in range(min(len(word), at + LONGEST), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12), st.text("abcd", min_size=1, max_size=14).map(str.encode))
def test_small_vocabularies(starts, continuations, word):
    assert LongestMatch(starts, continuations).count(word) == greedy(word, starts, continuations)


def test_real_vocabulary():
    counts = word_counts(read_ranks(PATH))
    rng = random.Random(3)
    parts = [t.decode("utf-8", "ignore") for t in rng.sample(sorted(VOCABULARY[1]), 2000)]
    for _ in range(3000):
        word = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) or "x"
        assert counts[word] == greedy(word.encode(), *VOCABULARY)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in token_counts(df, PATH).collect()}
    for r in df.collect():
        counts = [greedy(w.encode(), *VOCABULARY) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens, got[r.doc_id].longest) == (len(counts), sum(counts), max(counts, default=0))


def test_odd_rows(spark):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, "é", 1), (2, None, None), (3, " \n", 1), (4, "a" * 300_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, token_counts(df, PATH).collect()), key=str)
    count = lambda w: greedy(w.encode(), *VOCABULARY)
    two = (1, 2, count("hello") + count("world"), max(count("hello"), count("world")))
    long = count("a" * 300_000)
    assert got == sorted([two, two, (None, 1, count("é"), count("é")), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, long, long)], key=str)
    assert token_counts(df.limit(0), PATH).count() == 0


def test_very_long_words_and_texts(spark):
    """Time grows with the length: a word of a million characters, and a text of as many words."""
    rows = [(1, "ab" * 500_000, 5), (2, "word " * 500_000, 6)]
    got = {r.doc_id: r for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()}
    assert got[1].n_words == 1 and 100_000 < got[1].n_tokens < 1_000_000
    assert got[2].n_words == got[2].n_tokens == 500_000
