"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes the set of its word shingles (64-bit hashes), reduced to minima under BANDS x ROWS permutations. Band
   keys come from whole minima; of each minimum only the low two bits are kept, packed into seven longs.
2. Texts with equal sets are one class with a number of its own, so exact copies cost nothing further, and texts that share
   an id stay apart.
3. Classes that share a band key are candidates. First each meets the smallest number of its bucket; then, once those links have
   formed components, only members of different components of a bucket meet, in blocks of a bounded number that yield links alone.
4. A candidate pair goes on if its sizes allow the similarity and if the Jaccard estimate from the packed bits, corrected for chance
   collisions, is no more than MARGIN below the threshold (over six standard deviations); it becomes a link by the exact
   similarity of the full sets.
5. Components come from distributed star steps.

At the threshold 0.8 a pair has no common band with probability (1 - 0.8^6)^36 = 2e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import WORD, map_arrow, unused
from .components import connected_components
from .scratch import Scratch

BANDS, ROWS, BITS = 36, 6, 2
PERMUTATIONS = BANDS * ROWS
LONGS = -(-PERMUTATIONS * BITS // 64)
MARGIN = 0.2
#: Members that meet in one block of the second round, of 500 shingles each on average at most; a quarter as many ask.
CHUNK = 1_000
#: Ids of documents or keys of buckets that are sent to every task at most (8 or 16 bytes each).
BROADCAST_IDS = 2_000_000
_RNG = np.random.default_rng(20_240_229)
_MULTIPLY = _RNG.integers(0, 2**32, PERMUTATIONS, np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, PERMUTATIONS, np.uint32)
_PLACES = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hashes of words with A-Z lower-cased; up to 100,000 words are kept."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
        if len(self) < 100_000:
            self[word] = value
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of ``width`` words; of all its words if there are fewer; empty without words."""
    words = WORD.findall(text)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if n < width:
        return _mix((hashes * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * _PLACES[i]
    return np.unique(_mix(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set its minima (uint32) under all permutations."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= 60_000):
            held += len(sets[stop])
            stop += 1
        x = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
        offsets = np.cumsum([0, *map(len, sets[start : stop - 1])])
        v = np.empty_like(x)
        for j in range(PERMUTATIONS):
            np.multiply(x, _MULTIPLY[j], out=v)
            np.add(v, _ADD[j], out=v)
            out[start:stop, j] = np.minimum.reduceat(v, offsets)
        start = stop
    return out


def pack_bits(minima: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum (after mixing, as low bits of a multiple are not random), packed into LONGS longs."""
    m = minima ^ (minima >> np.uint32(15))
    m = m * np.uint32(0x2C1B3C6D)
    m = (m ^ (m >> np.uint32(12))) & np.uint32(2**BITS - 1)
    wide = np.zeros((len(m), LONGS * 64 // BITS), np.uint64)
    wide[:, :PERMUTATIONS] = m
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return (wide.reshape(len(m), LONGS, -1) << shifts).sum(2, dtype=np.uint64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(minima), BANDS), np.uint64)
    for i in range(ROWS):
        key = _mix(key ^ rows[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
    return key


def estimate(a: Column, b: Column) -> Column:
    """Jaccard estimate from the packed bits of two columns: the share of equal low bits, less what chance makes equal."""
    low = F.lit(0x5555555555555555)
    differ = None
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
        differ = n if differ is None else differ + n
    chance = 2.0**-BITS
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, packed bits, band keys; the last three are null for an empty set."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                minima = signatures([sets[i] for i in full])
                bits, keys = iter(pack_bits(minima).view(np.int64)), iter(band_keys(minima).view(np.int64))
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([digest_of(s) for s in sets], pa.binary()),
                    "bits": pa.array([next(bits) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    "bands": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, n long, digest binary, bits array<long>, bands array<long>")


def digest_of(members: np.ndarray) -> bytes | None:
    """128 bits that stand for a shingle set; null for the empty one."""
    return xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest and the full shingle set as array<long>."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                sets = [shingle_set(t or "", width) for t in part.column("text").to_pylist()]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([digest_of(s) for s in sets], pa.binary()),
                    "members": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, n long, digest binary, members array<long>")


def _possible(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether two sets of such sizes and sketches may be similar enough."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (estimate(a, b) >= percent / 100 - MARGIN)


def named_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """node and shingle set of the classes that ``nodes`` (node) names, made again from their texts rather than kept for all.

    Up to BROADCAST_IDS names are sent to every task, so that no text is shuffled; more meet the documents by shuffle. A text
    of another set under the same id is told by its digest, and of rows that repeat one set stays.
    """
    named = scratch.save(classes.select("node", "id", "n", "digest").join(nodes.select("node").distinct(), "node", "left_semi"))
    sent = F.broadcast if named.count() <= BROADCAST_IDS else lambda rows: rows
    texts = docs.select("doc_id", "text").join(sent(named.select("id").distinct()), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    name = named.select("node", "id", F.col("n").alias("size"), F.col("digest").alias("name"))
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("n") == F.col("size")) & (F.col("digest") == F.col("name"))
    sets = scratch.save(shingle_sets(texts, width).filter("n > 0").join(sent(name), match).select("node", "members"))
    if not sets.groupBy("node").count().filter("count > 1").isEmpty():
        sets, before = scratch.save(sets.dropDuplicates(["node"])), sets
        scratch.drop(before)
    scratch.drop(named)
    return sets


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The side b is joined first: each pair then carries one set, and one row of a meets its pairs as a stream.
    """
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    held = pairs.join(right, "b").join(left, "a").filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both))
    return scratch.save(held.select("a", "b"))


def block_links(block: pa.Table, percent: int) -> pa.Table:
    """Links between the asking members of a block and its others, enough to join every two components that any link joins.

    Pairs whose sizes and packed bits allow the similarity are confirmed on the full sets, the likeliest first; pairs of
    components that a confirmed link has joined are passed over.
    """
    ids, labels, asks = block.column("node").to_pylist(), block.column("component").to_pylist(), np.array(block.column("asks").to_pylist(), bool)
    bits = np.array(block.column("bits").to_pylist(), np.int64).view(np.uint64)
    sets = [np.asarray(x, np.int64) for x in block.column("members").combine_chunks().to_numpy(zero_copy_only=False)]
    sizes = np.array([len(x) for x in sets])
    parent = {c: c for c in labels}

    def root(c: object) -> object:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    others = np.flatnonzero(~asks)
    found: list[tuple[float, int, int]] = []
    for x in np.flatnonzero(asks):
        differ = bits[others] ^ bits[x]
        equal = 1 - np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64) / PERMUTATIONS
        near = (equal - 2.0**-BITS) / (1 - 2.0**-BITS)
        ok = (near >= percent / 100 - MARGIN) & (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x]))
        found += [(-near[k], int(x), int(others[k])) for k in np.flatnonzero(ok)]
    links = []
    for _, x, y in sorted(found):
        a, b = root(labels[x]), root(labels[y])
        if a != b:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                parent[a] = b
                links.append((ids[x], ids[y]))
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def links_across(wide: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between members of the same bucket that are in different components (wide: key, node, leader, component).

    In each bucket the members outside its leader's component ask. Buckets of the same leading component form one group; a
    group's askers and members are dealt into blocks of bounded numbers and set sizes, every block of askers meets every
    block of members in a task of its own, and only links leave it.
    """
    mixed = wide.groupBy("key").agg(F.min("component").alias("lowest"), F.max("component").alias("highest"), F.max(F.when(F.col("node") == F.col("leader"), F.col("component"))).alias("group")).filter("lowest <> highest").select("key", "group")
    mixed = scratch.save(mixed)
    few = mixed.count() <= BROADCAST_IDS  # then the members of a hot bucket stay where they are
    rows = wide.join(F.broadcast(mixed) if few else mixed, "key").select("group", "node", "component").distinct().withColumn("asker", F.col("component") != F.col("group"))
    rows = scratch.save(rows.join(sketch, "node").join(sets, "node"))
    heavy = lambda n, size, most: F.greatest(F.ceil(n / most), F.ceil(size / (most * 500)), F.lit(1)).cast("int")
    ask = F.when(F.col("asker"), 1).otherwise(0)
    blocks = rows.groupBy("group").agg(heavy(F.sum(ask), F.sum(ask * F.col("n")), max(1, CHUNK // 4)).alias("of_askers"), heavy(F.count("*"), F.sum("n"), CHUNK).alias("of_members"))
    dealt = rows.join(blocks, "group").withColumn("place", F.xxhash64("node"))
    mine = lambda column: F.pmod("place", F.col(column)).cast("int")
    every = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    carried = ["group", "node", "component", "bits", "members"]
    asking = dealt.filter("asker").select(*carried, F.lit(True).alias("asks"), mine("of_askers").alias("i"), every("of_members").alias("j"))
    asked = dealt.select(*carried, F.lit(False).alias("asks"), mine("of_members").alias("j"), every("of_askers").alias("i"))
    # Without this exchange Spark would keep the blocks of a group together, as the join by group has left them.
    met = asking.unionByName(asked).repartition("group", "i", "j")
    links = scratch.save(met.groupBy("group", "i", "j").applyInArrow(lambda block: block_links(block, percent), "a long, b long"))
    scratch.drop(rows)
    return links


def _components(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n, digest, component_id of every row, and leads: whether its set is the component's smallest by (id, digest)."""
    prints = scratch.save(sketches(docs, width))
    alike = prints.filter("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    classes = scratch.save(alike.withColumn("node", F.monotonically_increasing_id()))  # numbers hold once they are written
    members = classes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    shared = scratch.save(members.join(buckets, "key"))

    sketch = classes.select("node", "n", "bits")
    side = lambda name: sketch.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    possible = _possible(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent)
    first = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sets = named_sets(docs, classes, shared, width, scratch)
    links = confirmed(first.join(side("b"), "b").join(side("a"), "a").filter(possible).select("a", "b"), sets, percent, scratch)

    label = connected_components(links, scratch)
    wide = scratch.save(shared.filter("size > 2").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    links = links.union(links_across(wide, sketch, sets, percent, scratch))
    label = scratch.save(connected_components(links, scratch))
    for done in (wide, shared, sets):
        scratch.drop(done)
    names = classes.select("node", "n", "digest", "id")
    lowest = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest", "n", "node"))  # a null id comes last
    heads = names.join(label, "node").groupBy("component").agg(lowest.alias("head"))
    joined = names.join(label.join(heads, "component").select("node", "head"), "node", "left")
    linked = F.col("head").isNotNull()
    known = joined.select("n", "digest", F.when(linked, F.col("head.id")).otherwise(F.col("id")).alias("component_id"), F.when(linked, F.col("head.node") == F.col("node")).otherwise(True).alias("leads"))
    rows = prints.select("doc_id", "n", "digest").join(known, ["n", "digest"], "left")
    judged = scratch.save(rows.select("doc_id", "n", "digest", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads")))
    scratch.drop_all(but=judged)
    return judged


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept (whether it is that id).

    A document is linked to another if 100 * intersection >= percent * union of their sets of ``width``-word shingles. Null, empty and
    wordless texts have an empty set and no link: each is its own component. A very long text is one set of as many shingles as it
    has. Rows with the same id are judged each by its own text, so texts that differ may have different components. Of a component
    the smallest id stands for it; a row with a null id has the component of the texts alike, or null if none of them has an id;
    kept compares null-safely. Ties: nothing depends on the order of rows. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = _components(docs, width, percent, Scratch(docs.sparkSession))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def with_sets(docs: DataFrame, width: int, size: str, name: str) -> DataFrame:
    """docs with two more columns: the size of each text's shingle set, and its digest (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "", width) for t in batch.column("text").to_pylist()]
            added = [pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) or b"" for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, size, name])

    return map_arrow(docs, run, StructType([*docs.schema, StructField(size, LongType()), StructField(name, BinaryType())]))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their components: one row of every component.

    It is a row of the component's smallest id and, where texts of several sets have that id, of the smallest digest; so of
    unlike texts under one id each stays unless another component member stands for it. Of rows with one id and one set (also the
    empty one) any one stays. Rows with a null id name no document and all stay, as do documents without words. Very long texts,
    extra columns and an empty table are as in near_duplicates(). Only the ids that go, or that several rows have, meet the
    documents, so texts are shuffled only where those ids are too many to be sent to every task; texts are read again only
    for ids of several rows.
    """
    scratch = Scratch(docs.sparkSession)
    judged = _components(docs, width, percent, scratch).filter("doc_id is not null")
    stays = F.col("leads") & (F.col("doc_id") == F.col("component_id"))
    odd = scratch.save(judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(stays).alias("stays")).filter("rows > 1 or not stays"))
    rest = docs.join(odd.select("doc_id"), "doc_id", "left_anti")
    size, name = (unused(n, docs.columns) for n in ("set_size", "set_digest"))
    several = odd.filter("rows > 1").select("doc_id")
    if several.isEmpty():
        return rest
    wanted = judged.filter(stays).join(several, "doc_id", "left_semi").select("doc_id", F.col("n").alias(size), F.coalesce("digest", F.lit(b"")).alias(name)).distinct()
    key = ["doc_id", size, name]
    again = with_sets(docs.join(several, "doc_id", "left_semi").select(docs.columns), width, size, name)
    return rest.select(docs.columns).unionByName(again.join(wanted, key, "left_semi").dropDuplicates(key).select(docs.columns))
