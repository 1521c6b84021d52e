"""Document quality rules: base statistics with fixed limits, then gradient-boosted trees over statistics.

The trees are grown here on histograms of a bounded sample of labelled documents, and flattened into numpy arrays (feature,
threshold and leaf by node), so that a batch is scored by a few array look-ups. Chosen features carry monotonic constraints:
more symbols, repeats, repeated lines or capitals can never raise a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_arrow
from .scratch import Scratch

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Features of the trees, and the direction in which each may move the score (0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "pipe_share": -1, "upper_share": -1, "exclaim_share": -1, "dup_line_share": -1, "repeat_share": -1, "adjacent_share": -1, "distinct_share": 1, "line_words": 0, "digit_share": 0}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window of so many words that the text has twice or more. Windows get exact ranks by doubling."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[str, int] = {}
    ranks = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    if len(index) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        ranks = np.unique(ranks[:-step] * len(words) + ranks[step:], return_inverse=True)[1]
        width += step
    twice = np.bincount(ranks)[ranks] > 1
    if not twice.any():
        return 0
    starts = np.flatnonzero(twice)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The statistics and the features of one whole text."""
    words = WORD.findall(text)
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    share, per_word = 1 / max(1, chars), 1 / max(1, n)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    digits = sum(1 for w in words if w.isdigit())
    features = (np.log1p(n), chars * per_word, symbols * share, text.count("|") * share, upper * per_word, text.count("!") * share, dup / max(1, len(lines)), repeats * per_word, sum(map(eq, words, words[1:])) * per_word, len(set(words)) * per_word, min(200.0, n / max(1, len(lines))), digits * per_word)
    return (n, chars, symbols, dup, repeats), features


def base_failed(statistics: np.ndarray) -> np.ndarray:
    return (statistics[:, 0] < 20) | (100 * statistics[:, 4] > 30 * statistics[:, 0])


class Trees:
    """Boosted complete binary trees of one depth. Node k of a tree has children 2k+1 and 2k+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.threshold, self.leaf, self.start = feature, threshold, leaf, start

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, smooth: float = 5.0) -> Trees:
    """Fit by second-order boosting of the logistic loss; a sample of one class gives a constant."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: edges[b-1] < x <= edges[b]
    total = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        value = np.zeros(2 * inner + 1)
        for k in range(2 * inner + 1):
            at = np.flatnonzero(node == k)
            G, H = g[at].sum(), h[at].sum()
            value[k] = np.clip(G / (H + smooth), low[k], high[k])
            if k >= inner:
                continue
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j, e in enumerate(edges):
                if len(e) == 0 or len(at) < 10:
                    continue
                gl = np.cumsum(np.bincount(binned[at, j], g[at], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[at, j], h[at], len(e) + 1))[:-1]
                left, right = np.clip(gl / (hl + smooth), low[k], high[k]), np.clip((G - gl) / (H - hl + smooth), low[k], high[k])
                gain = gl * left - 0.5 * (hl + smooth) * left**2 + (G - gl) * right - 0.5 * (H - hl + smooth) * right**2 - (G * value[k] - 0.5 * (H + smooth) * value[k] ** 2)
                if direction[j]:
                    gain = np.where(direction[j] * (right - left) >= 0, gain, -np.inf)
                c = int(np.argmax(gain))
                if gain[c] > best[0]:
                    best = (float(gain[c]), j, c, float(left[c]), float(right[c]))
            _, j, c, left, right = best
            a, b = 2 * k + 1, 2 * k + 2
            low[[a, b]], high[[a, b]] = low[k], high[k]
            if j < 0:
                node[at] = a  # the threshold is infinite: all go left
                continue
            feature[k], threshold[k] = j, edges[j][c]
            if direction[j]:
                middle = (left + right) / 2
                if direction[j] > 0:
                    high[a], low[b] = min(high[a], middle), max(low[b], middle)
                else:
                    low[a], high[b] = max(low[a], middle), min(high[b], middle)
            node[at] = np.where(binned[at, j] <= c, a, b)
        leaf = rate * value[inner:]
        total += leaf[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def document_statistics(docs: DataFrame, extra: str | None = None) -> DataFrame:
    """doc_id, the five statistics and the features (array<double>) of each document, and the column ``extra`` if named."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.col(extra).alias("extra")] if extra else []))
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column("text").to_pylist()]
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array([s[i] for s, _ in found], pa.int64()) for i, k in enumerate(STATISTICS)}
            columns["features"] = pa.array([list(f) for _, f in found], pa.list_(pa.float64()))
            if extra:
                columns["extra"] = batch.column("extra")
            yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(source, run, f"doc_id {kinds['doc_id']}, " + ", ".join(f"{k} long" for k in STATISTICS) + ", features array<double>" + (f", extra {kinds['extra']}" if extra else ""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, held_out: tuple[int, int] | None, scratch: Scratch) -> DataFrame:
    """doc_id, text and y (0 or 1) of about ``most`` rows of labelled documents, chosen by hashes; all if there are fewer. Written to scratch.

    ``held_out`` = (m, r) leaves out ids whose crc32 as text is r modulo m. Null labels and ids are left out, of several rows for an id the
    largest label counts. Ids are drawn first and broadcast, as ``most`` bounds them; where ids have so many rows that these exceed
    it, repeated rows count once, and what is still too many is drawn by a hash of the text.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna()
    if held_out:
        known = known.filter(F.crc32(F.col("doc_id").cast("string")) % held_out[0] != held_out[1])
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = most / max(1, known.count())
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1_000_003)) < int(share * 1_000_003))
    rows = scratch.save(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id"))
    if rows.count() > 1.2 * most + 100:
        rows, before = scratch.save(rows.dropDuplicates(["doc_id", "text"])), rows
        scratch.drop(before)
        share = most / max(1, rows.count())
        if share < 1:
            rows, before = scratch.save(rows.filter(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_003)) < int(share * 1_000_003))), rows
            scratch.drop(before)
    return rows


def fit_trees(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees:
    """Trees for label quality from at most about ``sample`` labelled documents that pass the base rules."""
    scratch = Scratch(docs.sparkSession)
    chosen = labelled_sample(docs, labels, "quality", sample, None, scratch)
    rows = document_statistics(chosen, "y").toArrow().sort_by([("doc_id", "ascending"), *((k, "ascending") for k in STATISTICS)])
    scratch.drop(chosen)
    statistics = np.stack([rows.column(k).to_numpy() for k in STATISTICS], 1).astype(np.int64) if rows.num_rows else np.zeros((0, 5), np.int64)
    x = np.array(rows.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    ok = ~base_failed(statistics)
    return grow(x[ok], rows.column("extra").to_numpy().astype(float)[ok], list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: float = 0.5, trees: Trees | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for every document.

    kept is false where the base rules fail (fewer than 20 words, or over 30 % of words in repeated windows), else whether the
    trees' score reaches ``least``. A null text counts as empty and so fails. A very long text is measured whole, in time that grows with
    its length by no more than sorting takes. A score of exactly ``least`` keeps; trees are grown on rows sorted by id, and of
    equally good splits the first feature and lowest threshold are taken. Rows are judged one by one: repeated rows repeat, null ids stay, other columns are ignored, an empty table gives an empty result. Without labels of both classes every
    document gets the same score: the labels' mean, or 0.5.
    """
    trees = trees or fit_trees(docs, labels, sample)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            statistics, failed, score = judge(batch.column("text").to_pylist(), trees)
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(statistics[:, i]) for i, k in enumerate(STATISTICS)}
            yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= least)), "score": pa.array(score)})

    return map_arrow(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in STATISTICS) + ", base_failed boolean, kept boolean, score double")


def judge(texts: list[str], trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, whether the base rules fail, and the trees' scores."""
    found = [measure(t) for t in texts]
    statistics = np.array([s for s, _ in found], np.int64).reshape(-1, len(STATISTICS))
    return statistics, base_failed(statistics), trees.score(np.array([f for _, f in found], float).reshape(-1, len(FEATURES)))


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns (whatever their names), that quality_rules() keeps.

    Null, empty and very long texts, ties, repeated rows and null ids are as there: each row is judged by its text and stays or goes
    by itself. An empty table stays empty.
    """
    trees = fit_trees(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, failed, score = judge([t or "" for t in batch.column("text").to_pylist()], trees)
            yield batch.filter(pa.array(~failed & (score >= least)))

    return map_arrow(docs, run, docs.schema)
