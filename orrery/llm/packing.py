"""Best-fit packing of documents into training sequences, under conflicts.

Open bins are held in the order of their residual capacity and carry bitmaps of the sources and duplicate clusters in them. A
piece goes to the tightest bin that holds it without conflict: the search starts at the first bin whose residual suffices and
goes on to its successors until one is compatible; if none is, a new bin opens. Documents are dealt into shards of a bounded
size, each packed by itself, so that packing takes time and memory in proportion to the input; only the last bins of each
shard can be left less full than one packing of everything would leave them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import read_ranks
from .common import WORD, map_arrow
from .scratch import Scratch
from .wordpiece import word_counts

#: Documents in a shard, about.
SHARD_ROWS = 4_000


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece (length up to capacity, source, cluster). Longer pieces are placed first; ties in the given order.

    No bin gets two pieces of the same source, nor two of the same cluster; a null source or cluster conflicts with nothing.
    """
    source_bits = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for _, s, _ in pieces if s is not None))}
    repeated = [c for c, n in Counter(c for *_, c in pieces if c is not None).items() if n > 1]
    cluster_bits = {c: 1 << i for i, c in enumerate(repeated)}
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    out = [(0, 0)] * len(pieces)
    for k in sorted(range(len(pieces)), key=lambda k: -pieces[k][0]):
        length, source, cluster = pieces[k]
        source, cluster = source_bits.get(source, 0), cluster_bits.get(cluster, 0)
        for at in range(bisect_left(order, (length, -1)), len(order)):
            residual, b = order[at]
            if not (sources[b] & source or clusters[b] & cluster):
                del order[at]
                break
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        out[k] = (b, capacity - residual)
        insort(order, (residual - length, b))
    return out


def lengths(docs: DataFrame, rank_path: str, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster, n_tokens. Without a cluster column a cluster is the texts with the same words (A-Z lower-cased)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    named = [F.col(cluster).cast("string").alias("cluster")] if cluster else []
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), *named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counts(shared.value).__getitem__
        for batch in batches:
            n, digests = [], []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text)
                n.append(sum(map(count, words)))
                if not cluster:
                    digests.append(xxhash.xxh3_128_hexdigest(" ".join(words).encode("utf-8", "surrogatepass").lower()) if words else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "source": batch.column("source"), "cluster": batch.column("cluster") if cluster else pa.array(digests, pa.string()), "n_tokens": pa.array(n, pa.int64())})

    return map_arrow(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, source string, cluster string, n_tokens long")


def pack(docs: DataFrame, rank_path: str, capacity: int = 2048, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, piece_start, piece_tokens, bin_id, bin_offset: where each piece of each document stands.

    Lengths are word-piece counts of whole texts. A document longer than a bin is cut into full bins and a rest, and every
    token has one place. A null, empty or wordless text has one piece of no tokens. Documents with a null source conflict with no
    source. Rows that repeat are packed each for itself, apart from each other as copies; null ids stay; other columns are
    ignored; an empty table gives an empty result. A very long text is counted whole and has as many pieces as it needs. Ties:
    pieces of one length go by id, source, cluster; of bins with the same room the oldest is taken. Rows are dealt into shards
    by a hash of what is packed (id, source, cluster, length) and of the number among rows alike in it, so bins depend neither on files
    nor on cores, and a source, copies or ids that many rows share spread over all shards.
    """
    scratch = Scratch(docs.sparkSession)
    table = scratch.save(lengths(docs, rank_path, cluster))
    shards = max(1, -(-table.count() // SHARD_ROWS))
    kind = dict(table.dtypes)["doc_id"]
    packed = ["doc_id", "source", "cluster", "n_tokens"]
    alike = table.groupBy(packed).agg(F.count("*").alias("copies"))
    # Rows of very many copies are written out by many tasks.
    step = F.lit(SHARD_ROWS).cast("long")
    runs = alike.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), "copies", step))).repartition("doc_id", "cluster", "start")
    each = runs.select(*packed, F.explode(F.sequence("start", F.least(F.col("start") + step - 1, "copies"))).alias("number"))
    dealt = each.select(*packed, F.pmod(F.xxhash64(*packed, "number"), F.lit(shards)).cast("int").alias("shard"))

    def run(shard: pa.Table) -> pa.Table:
        rows = sorted(zip(*(shard.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n_tokens")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "", r[3]))
        number = shard.column("shard")[0].as_py() << 32
        out: list[tuple] = []
        rests, places = [], []
        for doc_id, source, group, n in rows:
            full, rest = divmod(n, capacity)
            for i in range(full):
                out.append((doc_id, i, i * capacity, capacity, -1, 0))
            if rest or not n:
                places.append(len(out))
                rests.append((rest, source, group))
                out.append((doc_id, full, full * capacity, rest, -1, 0))
        found = best_fit(rests, capacity)
        for at, (b, offset) in zip(places, found, strict=True):
            out[at] = (*out[at][:4], number + b, offset)
        fresh = number + max((b for b, _ in found), default=-1) + 1
        for at, row in enumerate(out):
            if row[4] < 0:
                out[at] = (*row[:4], fresh, 0)
                fresh += 1
        columns = list(zip(*out, strict=True))
        types = (shard.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "piece_start", "piece_tokens", "bin_id", "bin_offset"])

    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece int, piece_start long, piece_tokens long, bin_id long, bin_offset long")
