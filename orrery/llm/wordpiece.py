"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links and, at each node, the number of pieces that are done when its link is followed. A
word is read once, byte by byte: where the trie has no further edge, the node's popped count is added and its link taken. The
sum is the number of pieces of greedy longest-match tokenisation, in time linear in the word; no piece is ever built.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import parse_ranks, read_ranks
from .common import WORD, map_arrow

#: Words whose counts a worker keeps, and the bytes that such a word has at most.
CACHE_ENTRIES, CACHE_BYTES = 100_000, 64


def word_vocabulary(ranks: dict[bytes, int]) -> tuple[set[bytes], set[bytes]]:
    """Pieces that start a word and pieces that continue one.

    A vocabulary entry with a leading space starts a word (without the space), any other entry continues one. Every single
    byte is added to both, so that every word has pieces.
    """
    single = {bytes([b]) for b in range(256)}
    return single | {t[1:] for t in ranks if t[:1] == b" " and len(t) > 1}, single | {t for t in ranks if t[:1] != b" "}


class LongestMatch:
    """The automaton. Node 0 is the start of a word, node 1 the start of its continuations."""

    def __init__(self, starts: set[bytes], continuations: set[bytes]):
        goto: dict[int, int] = {}
        final = [False, False]
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in sorted(pieces):
                at = root
                for b in piece:
                    key = at << 8 | b
                    if key not in goto:
                        goto[key] = len(final)
                        final.append(False)
                    at = goto[key]
                final[at] = True
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in goto.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        self.goto, self.link, self.popped = goto, [-1] * len(final), [0] * len(final)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for b, node in children.get(parent, ()):
                queue.append(node)
                if final[node]:
                    self.link[node], self.popped[node] = 1, 1
                    continue
                at, n = self.link[parent], self.popped[parent]
                while at >= 0 and at << 8 | b not in goto:
                    n += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = goto[at << 8 | b], n

    def count(self, word: bytes) -> int:
        """Pieces of a non-empty word; 1 (an unknown word) if it cannot be cut into pieces."""
        goto, link, popped = self.goto, self.link, self.popped
        at = n = 0
        for b in word:
            while (to := goto.get(at << 8 | b)) is None:
                if link[at] < 0:
                    return 1
                n += popped[at]
                at = link[at]
            at = to
        while at != 1:
            if link[at] < 0:
                return 1
            n += popped[at]
            at = link[at]
        return n


class WordCounts(dict):
    """Piece counts by word, kept for short words."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        n = self.automaton.count(raw)
        if len(raw) <= CACHE_BYTES and len(self) < CACHE_ENTRIES:
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def word_counts(rank_file: bytes) -> WordCounts:
    return WordCounts(LongestMatch(*word_vocabulary(parse_ranks(rank_file))))


def token_counts(docs: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, longest (pieces of the word that has most) of every whole text.

    Words are runs of characters other than ASCII white space. A null, empty or wordless text has no words and tokens. A very long
    text or word is read whole, in time that grows with its length. Ties: of the pieces that fit at a place the longest is taken, so there
    are none; ``longest`` is a count. Rows are judged one by one: repeated rows repeat, null ids stay, other columns are
    ignored, an empty table gives an empty result. The vocabulary file is read by the driver and broadcast (its size is that of the vocabulary).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counts(shared.value).__getitem__
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                counts = list(map(count, WORD.findall(text)))
                found.append((len(counts), sum(counts), max(counts, default=0)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array([f[i] for f in found], pa.int64()) for i, k in enumerate(("n_words", "n_tokens", "longest"))})

    return map_arrow(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, n_words long, n_tokens long, longest long")
