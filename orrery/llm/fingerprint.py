"""Document fingerprints by closed syncmers and positional matching, in DataFrame operations only.

A text's words are hashed; a run of K words is an anchor if the smallest hash of its inner runs of S words lies at the run's
first or last place. Whether a run is chosen depends on nothing but itself, so the same passage has the same anchors wherever it stands,
and any K - S + 1 runs in a row hold at least one. The fingerprint writes each anchor as one hexadecimal digit (words since the
anchor before) and eight more (hash of its K words); a text of fewer words has one anchor, the hash of them all.

A text of few words, or of words so long that it is likely to be written without spaces, is taken by its characters (white space as one space)
in shorter runs, so that half of it keeps anchors: see ``grain``. Two texts are compared by the grain of the first.

Two texts are compared by where their common anchors stand: each pair of equal anchors votes for the shift between their
places, and the anchors that agree on the commonest shift count, in proportion to all anchors of both texts. The same passages in
another order agree on no one shift. Equal anchors meet by sorting, so that the work grows with the texts' length, not its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_GAP_SQL
from .scratch import Scratch

K, S = 9, 2
INNER = K - S + 1
#: Texts of fewer words than FEW_WORDS, or of more than LONG_WORD characters a word, are taken by runs of SHORT_K characters; of fewer characters than FEW_CHARS, by runs of LEAST_K.
FEW_WORDS, LONG_WORD, FEW_CHARS, SHORT_K, LEAST_K = 64, 12, 16, 5, 2
#: Documents that one ordered bucket holds about, and buckets at most; parts of an id of many rows at most; bounds passed over in one step of a search.
BUCKET_ROWS, MOST_BUCKETS, PARTS, GROUP = 2_000, 65_536, 1_024, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP_SQL, -1), "")


def word_hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def character_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.array_join(_words(text), " "), F.lit("(?s)."), F.lit(0)), lambda c: F.xxhash64(c))


def grain(text: Column) -> Column:
    """K if the text is taken by words, SHORT_K or LEAST_K if by characters."""
    by_characters = F.when(F.length(text) >= FEW_CHARS, SHORT_K).otherwise(LEAST_K)
    return let(F.size(_words(text)), lambda n: F.when((n >= FEW_WORDS) & (F.length(text) <= LONG_WORD * n), K).otherwise(by_characters))


def anchors(text: Column, taken: Column | None = None) -> Column:
    """The text's anchors in order, as array of (at: number of the first word or character from 1, hash: 32 bits in a long).

    By words, or by the grain that is given.
    """

    def anchor(at: Column, run: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), F.xxhash64(run).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"))

    def chosen(words: Column, k: int) -> Column:
        width = k - S + 1
        inner = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))
        edge = lambda runs, i: F.array_min(F.slice(runs, i, width)).isin(F.element_at(runs, i), F.element_at(runs, i + width - 1))
        places = lambda runs: F.filter(F.sequence(F.lit(1), F.size(runs) - width + 1), lambda i: edge(runs, i))
        many = F.transform(let(inner, places), lambda i: anchor(i, F.slice(words, i, k)))
        one = F.array(anchor(F.lit(1), words))
        return F.when(F.size(words) >= k, many).when(F.size(words) > 0, one).otherwise(F.slice(one, 1, 0))

    by_words = let(word_hashes(text), lambda w: chosen(w, K))
    if taken is None:
        return by_words
    by_characters = lambda k: let(character_hashes(text), lambda c: chosen(c, k))
    return F.when(taken == K, by_words).when(taken == SHORT_K, by_characters(SHORT_K)).otherwise(by_characters(LEAST_K))


def fingerprint(found: Column) -> Column:
    """The anchors as a string; empty for a text without words."""
    text = lambda a, i: F.concat(F.lower(F.hex(a["at"] - F.when(i > 0, F.element_at(found, F.greatest(i, F.lit(1)))["at"]).otherwise(1))), F.lpad(F.lower(F.hex(a["hash"])), 8, "0"))
    return F.array_join(F.transform(found, text), "")


def _agreeing(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(sorted shifts, last places): the shift of each two neighbouring equal anchors of the two texts, sorted, and where runs of equal shifts end.

    An anchor is one long, so that sorting lays equal hashes side by side in the order of their places: hash, place, text.
    """

    def coded(found: Column, text: int) -> Column:
        return F.transform(found, lambda x: F.shiftleft(x["hash"], 32).bitwiseOR(F.shiftleft(x["at"].cast("long"), 1)).bitwiseOR(F.lit(text)))

    place = lambda x: F.shiftright(x.bitwiseAND(F.lit(0xFFFFFFFF)), 1)

    def shift(p: Column, q: Column) -> Column:
        meet = (F.shiftright(p.bitwiseXOR(q), 32) == 0) & (p.bitwiseXOR(q).bitwiseAND(F.lit(1)) == 1)
        return F.when(meet, F.when(p.bitwiseAND(F.lit(1)) == 0, place(q) - place(p)).otherwise(place(p) - place(q)))

    neighbours = lambda s: F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), shift)
    shifts = F.sort_array(F.array_compact(let(F.sort_array(F.concat(coded(a, 0), coded(b, 1))), neighbours)))
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.coalesce(F.get(s, i) != F.element_at(s, i), F.lit(True)))
    return let(shifts, lambda s: F.when(F.size(s) > 0, let(ends(s), lambda e: body(s, e))))


def _runs(ends: Column) -> Column:
    return F.zip_with(ends, F.concat(F.array(F.lit(0)), ends), lambda end, before: end - before)


def shift_votes(a: Column, b: Column) -> Column:
    """Positional matching: how many anchors the two texts share at each distance in words or characters (map from distance to count)."""
    runs = lambda e: F.slice(_runs(e), 1, F.size(e))
    return _agreeing(a, b, lambda s, e: F.map_from_arrays(F.transform(e, lambda i: F.element_at(s, i)), runs(e)))


def likeness(a: Column, b: Column) -> Column:
    """The anchors that agree on the commonest shift, in proportion to the anchors of either text; 1 if both have none."""
    agree = F.coalesce(F.when(F.arrays_overlap(a["hash"], b["hash"]), _agreeing(a, b, lambda s, e: F.array_max(_runs(e)))), F.lit(0))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(let(agree, lambda n: n / (both - n)))


def _bucket(bounds: list[int] | Column) -> Column:
    """How many of the sorted bounds are smaller than doc_id (0 for null), by a search in steps of GROUP, then in one group."""
    array = bounds if isinstance(bounds, Column) else F.array(*map(F.lit, bounds)).cast("array<long>")
    below = lambda b: b < F.col("doc_id")
    steps = F.filter(F.sequence(F.lit(GROUP), F.size(array) + GROUP, F.lit(GROUP)), lambda i: F.coalesce(below(F.get(array, i - 1)), F.lit(False)))
    found = let(F.size(steps) * GROUP, lambda start: start + F.size(F.filter(F.slice(array, start + 1, GROUP), below)))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(found)


def _bucketed(ids: DataFrame, hot: DataFrame, most: int, lowest: int | None, highest: int | None, scratch: Scratch) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``bucket`` to rows with a doc_id: quantiles of the ids, larger for larger ids, -1 for null; hot ids have their own.

    The bounds stay in a table: ids are cut into cells of a power of two, and a cell's row holds its bounds and the number
    of those below it. That table has at most 4 * ``most`` + 1 rows, so it is sent to every task.
    """
    if most <= 1 or lowest is None:
        return lambda df: df.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long"))
    shift = 0
    while (highest >> shift) - (lowest >> shift) >= 4 * most:
        shift += 1
    quantiles = F.percentile_approx("doc_id", [i / most for i in range(1, most)], max(10_000, 20 * most))
    cuts = ids.agg(quantiles.alias("cuts")).select(F.explode("cuts").alias("cut"))
    own = hot.select(F.explode(F.array(F.col("doc_id"), F.when(F.col("doc_id") > lowest, F.col("doc_id") - 1))).alias("cut")).dropna()
    inside = cuts.union(own).distinct().groupBy(F.shiftright("cut", shift).alias("cell")).agg(F.sort_array(F.collect_list("cut")).alias("inside"))
    every = ids.sparkSession.range(lowest >> shift, (highest >> shift) + 1).select(F.col("id").alias("cell")).join(inside, "cell", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce("inside", F.array().cast("array<long>"))
    cells = scratch.save(every.select("cell", held.alias("inside"), F.coalesce(F.sum(F.size(held)).over(before), F.lit(0)).alias("base")))

    def add(df: DataFrame) -> DataFrame:
        met = df.join(F.broadcast(cells), F.shiftright("doc_id", shift) == F.col("cell"), "left")
        return met.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("base") + _bucket(F.col("inside")))).select(*df.columns, "bucket")

    return add


def _hot_rows(rows: DataFrame, hot: DataFrame, parts: int, add: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """The rows of hot ids, each text of an id once with its copies, dealt into ``parts`` of the id in their order by length and digest."""
    same = F.col("doc_id").eqNullSafe(F.col("hot_id"))
    found = rows.join(F.broadcast(hot.select(F.col("doc_id").alias("hot_id"))), same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    found = scratch.save(add(found).withColumn("length", F.length("text")).withColumn("digest", F.sha2("text", 256)))
    key = F.shiftleft(F.col("length").cast("long"), 31).bitwiseOR(F.conv(F.substring("digest", 1, 7), 16, 10).cast("long"))
    cuts = found.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts))).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("key")))
    met = found.withColumn("key", key).join(F.broadcast(cuts.withColumnRenamed("doc_id", "hot_id")), same)
    return met.withColumn("part", part).select("doc_id", "text", "copies", "length", "digest", "bucket", "part")


def _with_next(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text, copies, grain, anchors, and text and anchors (at this grain) of the next document by descending doc_id, the first's after
    the last; and whether copies are ever more than one.

    Documents are dealt into ordered slots by quantiles of the id; the first of each slot is also sent to the slot before it, where
    it stands last, and the very first to the last. Of documents with the same id the shorter comes first, then the one of the
    smaller digest; nulls come last. An id (or null) of very many rows has slots of its own, by length and digest, and
    there rows that repeat are one with a number of copies, of which each but the last is followed by the next copy.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n, lowest, highest = ids.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    cores = min(spark.sparkContext.defaultParallelism, n // 100)  # a small table still has work for all of them
    most = max(1, cores, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    hot = scratch.save(ids.groupBy("doc_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > 4 * -(-n // most)))  # at most most / 4 ids
    hot_ids = hot.count()
    heated = hot_ids > 0
    add = _bucketed(ids, hot, most, lowest, highest, scratch)
    same = F.col("doc_id").eqNullSafe(F.col("hot_id"))
    cool = lambda df: df.join(F.broadcast(hot.select(F.col("doc_id").alias("hot_id"))), same, "left_anti") if heated else df
    heads = add(cool(ids)).groupBy("bucket").agg(F.max("doc_id").alias("head")).select("bucket", F.lit(0).alias("part"), "head", F.lit(None).cast("string").alias("name"))
    if heated:
        own = _hot_rows(rows, hot, max(2, min(PARTS, 4 * most // hot_ids)), add, scratch)
        heads = heads.union(own.groupBy("bucket", "part").agg(F.min(F.struct("length", "digest", "doc_id")).alias("first")).select("bucket", "part", F.col("first.doc_id"), F.col("first.digest")))
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"), "part")  # one row for each slot
    slot = F.struct("bucket", "part")
    last = F.last(slot).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = scratch.save(heads.select("head", "name", F.coalesce(F.lag(slot).over(in_order), last).alias("to")))
    plain = add(cool(rows)).withColumn("part", F.lit(0)).withColumn("copies", F.lit(1).cast("long"))
    sent = plain.join(F.broadcast(guests.filter("name is null")), F.col("doc_id").eqNullSafe(F.col("head")), "left").select("doc_id", "text", "copies", "bucket", "part", "to")
    if heated:
        named = (F.col("digest") == F.col("name")) & F.col("doc_id").eqNullSafe(F.col("head"))
        sent = sent.union(own.join(F.broadcast(guests.filter("name is not null")), named, "left").select("doc_id", "text", "copies", "bucket", "part", "to"))
    places = F.array(F.struct("bucket", "part", F.lit(False).alias("guest")), F.struct(F.col("to.bucket"), F.col("to.part"), F.lit(True).alias("guest")))
    sent = sent.select("doc_id", "text", "copies", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())).alias("place"))
    # As many tasks as slots, told by number: a hash would lay some slots on one task and leave others empty.
    number = F.pmod(F.col("bucket") + 1 + F.col("part"), F.lit(most + 1)).cast("int")
    dealt = sent.select("doc_id", "text", "copies", "place.*").withColumn("task", number).repartitionById(most + 1, "task")
    order = Window.partitionBy("task", "bucket", "part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "length", "digest")
    shown = dealt.withColumn("taken", grain(F.col("text"))).select("*", anchors(F.col("text"), F.col("taken")).alias("found"), F.length("text").alias("length"), F.sha2("text", 256).alias("digest"))
    # Column by column, so that a query that wants the edited texts only carries no anchors.
    following = shown.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "taken", "found"))).filter("not guest")
    next_found = F.when(F.col("next_taken") == F.col("taken"), F.col("next_found")).otherwise(anchors(F.col("next_text"), F.col("taken")))
    return following.select("doc_id", "text", "copies", "taken", "found", "next_text", next_found.alias("next_found")), heated


def _described(rows: DataFrame) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_found", anchors(F.col("edited"), F.col("taken")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
        "copies",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    edited_fingerprint and both likenesses are at the grain of the document. A text of one or two characters has one anchor.
    A null or empty text has no characters and an empty fingerprint; two empty fingerprints are alike (1), an empty and
    another one not (0). A very long text is read whole, in time that grows with its length by no more than sorting takes. Repeated
    rows repeat; the order of rows with the same or a null id is that of ``_with_next``, and those of one id may be
    a third of all: they are dealt over tasks too. Other columns are ignored; an empty table gives an empty result, a single
    document is its own next one.
    """
    rows, heated = _with_next(docs)
    if not heated:
        return _described(rows).drop("copies")
    # Each copy but the last is followed by its like; what it gives is made once and repeated by many tasks.
    alike = _described(rows.filter("copies > 1").withColumn("next_text", F.col("text")).withColumn("next_found", F.col("found")))
    dealt = alike.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(BUCKET_ROWS).cast("long")))).repartition("doc_id", "start")
    repeats = dealt.withColumn("each", F.explode(F.sequence("start", F.least(F.col("start") + BUCKET_ROWS, F.col("copies")) - 1)))
    result = _described(rows).drop("copies")
    return result.unionByName(repeats.select(result.columns))
