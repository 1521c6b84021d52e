"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Terms are words and leading parts of words, each at up to three levels of repetition ("idiot", "idiot twice", ...). The space is
spanned by the terms that tell labelled documents of either class apart (chi-square, both directions) and by the commonest words,
whatever their labels, so that a document without telling words has neighbours too. Weights are plain TF-IDF: logarithmic counts times
the inverse document frequency over all documents, as unit vectors.

The labelled vectors lie in an inverted index cut into blocks of documents. A block holds the postings of its terms side by side
and the largest weight of each term; documents are scored in the order of the blocks' upper bounds until no block can reach
the nearest neighbours found, which makes the search exact. Many documents are searched together, so that a block is one matrix
product for all of those that need it. The neighbours' labels, weighted by similarity, give a vote, and votes are calibrated to
probabilities by isotonic regression over the labelled documents' own leave-one-out votes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .quality_rules import labelled_sample
from .scratch import Scratch

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the leading parts of words that are terms, and the levels of repetition.
STEMS, LEVELS = (3, 4, 5, 6, 7), 3
#: Documents in a block of the index, and documents that are searched together.
BLOCK, TOGETHER = 64, 256
#: Cosines are compared to so many parts, so that equal ones tie whatever the order of sums.
PARTS = 10**9
#: Words that a worker remembers.
KNOWN_WORDS = 100_000


def word_terms(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)] if len(word) > 2 else [word]


def count_terms(text: str) -> dict[str, int]:
    """Every candidate term of the text with its count."""
    found: dict[str, int] = {}
    for word, n in Counter(LETTERS.findall(text.lower())).items():
        for term in word_terms(word):
            found[term] = found.get(term, 0) + n
    return found


class Vocabulary:
    """The selected terms; counts only those in a text. Words met before are known to have terms or to have none."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.levels: dict[str, list[int]] = {}  # the number of each base's term at every level, -1 where that is not selected
        for i, t in enumerate(terms):
            base, _, level = t.rpartition("@")
            self.levels.setdefault(base, [-1] * LEVELS)[int(level) - 1] = i
        #: For each length of a leading part those that are terms (a word itself never ends in *).
        self.stems = [(k, {t[:k]: t for t in self.levels if len(t) == k + 1 and t.endswith("*")}) for k in STEMS]
        self.known: dict[str, tuple[str, ...]] = {}
        self.without: set[str] = set()

    def terms_of(self, word: str) -> tuple[str, ...]:
        """word_terms(word), of those selected."""
        found, n = [word] if word in self.levels else [], len(word)
        for k, starts in self.stems:
            if n <= k:
                break
            if (term := starts.get(word[:k])) is not None:
                found.append(term)
        return tuple(found)

    def count(self, text: str) -> list[tuple[int, int]]:
        """(term, count) of each selected term in the text, by term."""
        words = LETTERS.findall(text.lower())
        if len(self.known) + len(self.without) > KNOWN_WORDS:
            self.known.clear()
            self.without.clear()
        held: list[tuple[str, tuple[str, ...]]] = []
        for word in set(words) - self.without:
            terms = self.known.get(word)
            if terms is None:
                terms = self.terms_of(word)
                if len(word) < 40:
                    if terms:
                        self.known[word] = terms
                    else:
                        self.without.add(word)
            if terms:
                held.append((word, terms))
        times = Counter(words).__getitem__ if len(held) > 12 else words.count
        found: dict[str, int] = {}
        for word, terms in held:
            n = times(word)
            for term in terms:
                found[term] = found.get(term, 0) + n
        levels = self.levels
        return sorted([(i, n - above) for term, n in found.items() for above, i in enumerate(levels[term][:n]) if i >= 0])


def select_terms(sample: DataFrame, most: int, common: int, scratch: Scratch, least: int = 3, least_chi2: float = 30.0) -> list[str]:
    """At most ``most`` terms of largest chi-square among those in at least ``least`` documents, whichever class has them more often, and the
    ``common`` words in the most documents of the sample; nothing if the sample has one class only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                into = toxic if y else clean
                into.update(f"{t}@{level}" for t, n in count_terms(text).items() for level in range(1, min(n, LEVELS) + 1))
            if len(toxic) + len(clean) > 300_000:
                yield from emit(toxic, clean)
        yield from emit(toxic, clean)

    def emit(toxic: Counter[str], clean: Counter[str]) -> Iterator[pa.RecordBatch]:
        terms = list(toxic.keys() | clean.keys())
        for i in range(0, len(terms), 20_000):
            part = terms[i : i + 20_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part), "a": pa.array([toxic[t] for t in part], pa.int64()), "b": pa.array([clean[t] for t in part], pa.int64())})
        toxic.clear()
        clean.clear()

    n = {bool(r.y): r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos or not neg:
        return []
    a, b = F.col("a"), F.col("b")
    counts = map_arrow(sample.select("text", "y"), run, "term string, a long, b long").groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    counts = scratch.save(counts.filter(a + b >= least))
    total = float(pos + neg)
    chi2 = total * (a * (neg - b) - b * (pos - a)) ** 2 / (pos * neg * (a + b) * (total - a - b) + 1e-9)
    telling = counts.select("term", chi2.alias("chi2")).filter(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "term").limit(most)
    words = counts.filter(F.col("term").endswith("@1") & ~F.col("term").contains("*")).orderBy((a + b).desc(), "term").limit(common)
    chosen = [r.term for r in telling.collect()]
    found = dict.fromkeys([*chosen, *(r.term for r in words.select("term").collect())])
    scratch.drop(counts)
    return list(found)


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """The number of all documents, and of those with each term; each task sends one row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, n = Vocabulary(terms), np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            n[-1] += batch.num_rows
            for text in batch.column("text").to_pylist():
                for i, _ in vocabulary.count(text):
                    n[i] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at), "n": pa.array(n[at])})

    n = np.zeros(len(terms) + 1, np.int64)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    for r in map_arrow(texts, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[r.term] = r.n
    return int(n[-1]), n[:-1]


def weigh(counts: list[tuple[int, int]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a unit TF-IDF vector."""
    terms = np.array([i for i, _ in counts], np.int64)
    weights = (1 + np.log(np.array([n for _, n in counts], float))) * idf[terms] if counts else np.zeros(0)
    return terms, weights / np.sqrt((weights**2).sum()) if len(weights) else weights


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among sparse unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n, self.blocks, self.vectors = len(vectors), -(-len(vectors) // BLOCK), vectors
        self.block_max = np.zeros((terms, self.blocks))
        for i, (t, w) in enumerate(vectors):
            self.block_max[t, i // BLOCK] = np.maximum(self.block_max[t, i // BLOCK], w)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def postings(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's terms, and for each the weights of the block's documents."""
        if block not in self.held:
            inside = self.vectors[block * BLOCK : (block + 1) * BLOCK]
            terms = np.flatnonzero(self.block_max[:, block])
            weights = np.zeros((len(terms), BLOCK))
            for i, (t, w) in enumerate(inside):
                weights[np.searchsorted(terms, t), i] = w
            self.held[block] = terms, weights
        return self.held[block]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each block of documents the largest cosine that one of them could have."""
        return weights @ self.block_max[terms]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k documents of largest positive cosine (ties: the smaller index) in that order, and the cosines; -1 and 0
        where there are fewer. Blocks come in the order of their bounds, a few first, then by 32 those that can still matter."""
        m = len(queries)
        best = np.zeros((m, k), np.int64)  # cosine in parts, then the index from behind: larger is nearer
        if not self.blocks or not m:
            return np.full((m, k), -1), np.zeros((m, k))
        dense = np.zeros((m, len(self.block_max)))
        for i, (t, w) in enumerate(queries):
            dense[i, t] = w
        bounds = dense @ self.block_max
        order = np.argsort(-bounds, axis=1, kind="stable")
        behind = self.blocks * BLOCK - 1 - np.arange(self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        first, width = 0, 4
        while first < self.blocks:
            part = order[:, first : first + width]
            limit = np.take_along_axis(bounds, part, 1)
            wanted = (limit > 0) & (limit >= (best.min(1) // (self.blocks * BLOCK) / PARTS - 2 / PARTS)[:, None])
            rows = np.flatnonzero(wanted.any(1))
            if not len(rows):
                break
            part, wanted = part[rows], wanted[rows]
            keys = np.zeros((len(rows), part.shape[1], BLOCK), np.int64)
            at, place = np.nonzero(wanted)
            blocks = part[at, place]
            by = np.argsort(blocks, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(blocks[by])) + 1):
                block = int(blocks[group[0]])
                terms, weights = self.postings(block)
                cosines = np.minimum(1.0, dense[np.ix_(rows[at[group]], terms)] @ weights)
                parts = np.rint(cosines * PARTS).astype(np.int64)
                keys[at[group], place[group]] = np.where(parts > 0, parts * (self.blocks * BLOCK) + behind[block], 0)
            keys = keys.reshape(len(rows), -1)
            if without is not None:
                own = self.blocks * BLOCK - 1 - without[rows]
                keys[(keys > 0) & (keys % (self.blocks * BLOCK) == own[:, None])] = 0
            both = np.concatenate([best[rows], keys], 1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            first, width = first + width, 32
        best = -np.sort(-best, axis=1)
        found = best > 0
        return np.where(found, self.blocks * BLOCK - 1 - best % (self.blocks * BLOCK), -1), np.where(found, best // (self.blocks * BLOCK) / PARTS, 0.0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """search() for one query: only the neighbours that it has."""
        ids, cosines = self.search([(terms, weights)], k, np.array([without]) if without >= 0 else None)
        return ids[0][ids[0] >= 0], cosines[0][ids[0] >= 0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing points (vote, probability), smoothed by one example of either class."""
    values, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for v, s, n in zip(values, np.bincount(at, y), np.bincount(at), strict=True):
        pools.append([v, float(s), float(n), v])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v2, s2, n2, e2 = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + s2, pools[-1][2] + n2, e2]
    points = [(e, (s + 0.5) / (n + 1)) for a, s, n, b in pools for e in ((a, b) if b > a else (a,))]
    xs, ys = (np.array(p) for p in zip(*points, strict=True))
    return xs, np.maximum.accumulate(ys)


class NearestVotes:
    """The fitted classifier: vocabulary, idf, index of labelled vectors, their labels and ids, calibration."""

    def __init__(self, terms: list[str], idf: np.ndarray, ids: list, labels: np.ndarray, counts: list[list[tuple[int, int]]], k: int):
        vectors = [weigh(c, idf) for c in counts]
        # Alike documents share blocks: sorted by their heaviest terms.
        order = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist(), str(ids[i])))
        self.terms, self.idf, self.k = terms, idf, k
        self.ids, self.labels = [ids[i] for i in order], labels[order].astype(float)
        self.index = BlockMaxIndex([vectors[i] for i in order], len(terms))
        rest = np.ones(len(labels), bool)
        rest[order] = False
        #: The score of a document without any of the terms.
        self.prior = float((labels[rest].sum() + 0.5) / (rest.sum() + 1)) if len(terms) else float(labels.mean()) if len(labels) else 0.5
        votes = [self.votes(*self.index.search([vectors[i] for i in order[at : at + TOGETHER]], k, np.arange(at, min(at + TOGETHER, len(order))))) for at in range(0, len(order), TOGETHER)]
        self.points = isotonic(np.concatenate(votes), self.labels) if votes else (np.zeros(1), np.full(1, self.prior))

    def votes(self, near: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """The neighbours' labels, by squared cosine; 0 without neighbours."""
        weights = cosines**2
        return (weights * self.labels[near]).sum(1) / np.maximum(weights.sum(1), 1e-18)

    def judge(self, texts: list[list[tuple[int, int]]], evidence: int = 3) -> tuple[np.ndarray, list[list[tuple]]]:
        """For each text's terms the score, and the nearest examples (id, cosine, label) behind it."""
        scores, behind = np.full(len(texts), self.prior), [[] for _ in texts]
        known = [i for i, counts in enumerate(texts) if counts]
        for start in range(0, len(known), TOGETHER):
            rows = known[start : start + TOGETHER]
            near, cosines = self.index.search([weigh(texts[i], self.idf) for i in rows], self.k)
            scores[rows] = np.interp(self.votes(near, cosines), *self.points)
            for i, ids, c in zip(rows, near[:, :evidence].tolist(), cosines[:, :evidence].tolist(), strict=True):
                behind[i] = [(self.ids[j], x, int(self.labels[j])) for j, x in zip(ids, c, strict=True) if j >= 0]
        return scores, behind


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, sample: int = 12_000, most_terms: int = 1_000, k: int = 25, common: int = 200) -> NearestVotes:
    """Fit on at most about ``sample`` labelled rows (not the held-out ones), with idf over all of ``docs``.

    The space has at most ``most_terms`` telling terms and ``common`` common words.
    """
    scratch = Scratch(docs.sparkSession)
    chosen = labelled_sample(docs, labels, "toxic", sample, held_out, scratch)  # bounded; read three times
    terms = select_terms(chosen, most_terms, common, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            found = [vocabulary.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "terms": pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())), "counts": pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))})

    rows = map_arrow(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, y int, terms array<long>, counts array<long>").toArrow().to_pylist()
    scratch.drop(chosen)
    rows.sort(key=lambda r: (str(r["doc_id"]), r["terms"], r["counts"]))
    n, df = document_frequencies(docs, terms) if terms else (0, np.zeros(0))
    idf = np.log((1 + n) / (1 + df)) + 1e-3  # a word that every document has still makes neighbours
    return NearestVotes(terms, idf, [r["doc_id"] for r in rows], np.array([r["y"] for r in rows], int), [list(zip(r["terms"], r["counts"], strict=True)) for r in rows], k)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, least: float = 0.7, sample: int = 12_000, model: NearestVotes | None = None) -> DataFrame:
    """doc_id, score, predicted, evidence (array of the nearest labelled examples' ids, cosines and labels) of every document.

    A score is the calibrated probability of label 1. A null or empty text, or one without any selected term, gets the share of
    toxic documents among labelled ones like it, and has no evidence. Without labels of both classes every document gets the
    labels' mean, or 0.5 without any. A very long text is read whole; its size does not bound what a task holds, as it is counted, not
    copied. Equally near examples: the one of the smaller place in the index counts. Rows are judged one by one, so repeated rows
    repeat and equal texts have equal scores; a labelled document that was learned meets itself at cosine 1 (calibration leaves
    it out, so only held-out scores tell how good the scores are). Null ids stay, other columns are ignored, an empty table
    gives an empty result. The fitted model is bounded by ``sample`` and broadcast.
    """
    spark = docs.sparkSession
    model = model or fit_toxicity(docs, labels, held_out, sample)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    label_kind = dict(labels.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocabulary = Vocabulary(model.terms)
        for batch in batches:
            scores, found = model.judge([vocabulary.count(t) for t in batch.column("text").to_pylist()])
            evidence = [[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in e] for e in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= least).astype(np.int32)), pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.string() if label_kind == "string" else pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    return map_arrow(source, run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{'string' if label_kind == 'string' else 'long'},cosine:double,toxic:int>>")


def keep_clean(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, least: float = 0.7, sample: int = 12_000) -> DataFrame:
    """The rows of docs, with all their columns (whatever their names), that toxicity() does not predict toxic.

    Null, empty and very long texts, ties, repeated rows and null ids are as there: each row is judged by its text and stays or goes
    by itself. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, held_out, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value.terms)
        for batch in batches:
            scores, _ = shared.value.judge([vocabulary.count(t or "") for t in batch.column("text").to_pylist()], 0)
            yield batch.filter(pa.array(scores < least))

    return map_arrow(docs, run, docs.schema)
