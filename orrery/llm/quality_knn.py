"""Quality by nearest-neighbour voting: labelled latent-semantic vectors are broadcast, every document gets its exact cosines.

Terms are trigrams of character shapes (lower case, upper case, digit, white space, line feed, and groups of symbols), and
counted signs of repetition (a word that repeats the one before, a line or word that was there before). Term counts are weighed
by TF-IDF, with document frequencies over all documents, and projected on the leading right singular vectors of the labelled
documents' matrix. A document's cosines with all labelled vectors come from blocked matrix products; the nearest vote with
their similarity as weight.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_arrow
from .quality_rules import labelled_sample
from .scratch import Scratch

#: Character groups; every other character counts as a letter in lower case.
GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", "|", "#*$%&", "!?", ".,;:", "\"'()[]{}-_/\\", "<>=+~^`@")
SHAPES = len(GROUPS) + 1
TRIGRAMS = SHAPES**3
#: Signs of repetition: repeated next word, repeated line, share of words seen before in four steps.
SIGNS = ("same_word", "same_line", "seen_half", "seen_most", "seen_nearly_all")
TERMS = TRIGRAMS + len(SIGNS)
#: Cosines are compared to so many parts.
PARTS = 10**9
WIDE = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
_SHAPE_OF = np.zeros(0x250, np.int32)
for _k, _group in enumerate(GROUPS, 1):
    for _c in _group:
        _SHAPE_OF[ord(_c)] = _k
for _c in range(0x80, 0x250):
    if chr(_c).isupper():
        _SHAPE_OF[_c] = 1


def term_counts(texts: list[str]) -> np.ndarray:
    """A row of term counts (float32) for each whole text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode(WIDE, "replace"), np.uint32)
        shapes = np.where(codes < len(_SHAPE_OF), _SHAPE_OF[np.minimum(codes, len(_SHAPE_OF) - 1)], 0)
        if len(shapes) > 2:
            out[i, :TRIGRAMS] = np.bincount((shapes[:-2] * SHAPES + shapes[1:-1]) * SHAPES + shapes[2:], minlength=TRIGRAMS)
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        new = len(set(words)) / max(1, len(words))
        # Signs weigh with the text's length, as trigrams do.
        out[i, TRIGRAMS:] = (4 * sum(map(eq, words, words[1:])), len(text) * (len(lines) - len(set(lines))) / max(1, len(lines)), len(text) * (new < 0.5) * (len(words) >= 20), len(text) * (new < 0.25) * (len(words) >= 20), len(text) * (new < 0.1) * (len(words) >= 20))
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows; a text without terms keeps a zero row."""
    x = np.sqrt(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.maximum(norm, 1e-12)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of all documents and of those with each term; each task sends a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n[-1] += len(texts)
            for i in range(0, len(texts), 200):
                n[:-1] += (term_counts(texts[i : i + 200]) > 0).sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at), "n": pa.array(n[at])})

    n = np.zeros(TERMS + 1, np.int64)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    for r in map_arrow(texts, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[r.term] = r.n
    return int(n[-1]), n[:-1]


class LatentVotes:
    """idf, projection, labelled latent vectors and their labels."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray, rank: int, k: int, power: int):
        self.idf, self.k, self.power = idf.astype(np.float32), k, power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        x = weigh(counts, self.idf)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank])
        self.labels = labels.astype(float)
        self.latent = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float64) @ self.basis
        return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors: cosine to a power as weight, one neighbour's weight of the labels' mean besides."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        x = weigh(counts, self.idf)
        n = len(self.labels)
        k = min(self.k, n)
        # Cosines count to nine digits, so that the shape of a block does not matter; of equally near vectors the first is nearer.
        parts = np.rint(np.maximum(self.project(x) @ self.latent.T, 0) * PARTS).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        best = -np.sort(-np.partition(parts, n - k, axis=1)[:, n - k :], axis=1)
        near, weights = n - 1 - best % n, (best // n / PARTS) ** self.power
        score = ((weights * self.labels[near]).sum(1) + 0.5 * self.prior) / (weights.sum(1) + 0.5)
        return np.where(x.any(1), score.astype(float), self.prior)


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, sample: int = 6_000, rank: int = 40, k: int = 15, power: int = 8) -> LatentVotes:
    """Fit on at most about ``sample`` labelled documents (not the held-out ones), with idf over all of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    chosen = labelled_sample(docs, labels, "quality", sample, held_out, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                counts = term_counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.string()), "y": part.column("y"), "counts": pa.array([r.tobytes() for r in counts], pa.binary())})

    rows = map_arrow(chosen, run, "doc_id string, y int, counts binary").toArrow()
    scratch.drop(chosen)
    ids, raw, y = rows.column("doc_id").to_pylist(), rows.column("counts").to_pylist(), rows.column("y").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
    counts = np.frombuffer(b"".join(raw[i] for i in order), np.float32).reshape(-1, TERMS)
    n, df = document_frequencies(docs)
    return LatentVotes(np.log((1 + n) / (1 + df)) + 0.1, counts, np.array([y[i] for i in order], float), rank, k, power)


def quality_votes(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, least: float = 0.3, sample: int = 6_000, model: LatentVotes | None = None) -> DataFrame:
    """doc_id, score, predicted of every document; a score is the vote for label 1.

    A null, empty or very short text (no trigram and no sign) gets the labels' mean, or 0.5 without labels. A very long text is
    counted whole; its counts are as many as any other's. Of equally near labelled vectors those of the smaller id (as text) vote.
    Rows are judged one by one: repeated rows repeat, equal texts have equal scores, null ids stay, other columns are ignored, an
    empty table gives an empty result. The model is bounded by ``sample`` vectors of ``rank`` numbers and broadcast.
    """
    model = model or fit_quality(docs, labels, held_out, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [model.score(term_counts(texts[i : i + 200])) for i in range(0, len(texts), 200)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= least).astype(np.int32))})

    return map_arrow(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, score double, predicted int")
