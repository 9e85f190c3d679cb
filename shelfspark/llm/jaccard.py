"""N-gram Jaccard join by set-relation skipping.

Documents become sets of hashed word shingles; equal sets are one set from the
start.  An index lists, for every shingle in a set's prefix, the sets that hold it.
Two ideas keep the join from emitting all pairs of a long list:

* block skipping: lists are cut into blocks of similar set sizes.  A
  set meets its own and the neighbouring block only, and pairs whose positions in
  both prefixes leave too few shingles to reach the threshold are skipped;
* answers from similar sets: each block has a leader: the set with the fewest rarer
  shingles, which in a group of edited copies is the one nearest to their origin.  All sets
  are verified against leaders first, which links most groups of copies.  A second
  pass looks only at lists that still hold several components; for a pair of
  sets verified against the same leader, their differences from it bound
  their own difference from below and from above, which settles most pairs
  without reading the sets.

The result is exact.  The prefix order puts widespread shingles last; they are
found by a mergeable heavy-hitter count over all documents, and the order affects
speed only, never the result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, drop_table, map_batches, semi, small_enough, tidy, write_table
from .components import connected_components

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Heavy hitters: local count from which a task reports a shingle, how many shingles a task counts at once,
#: and how many of the most frequent ones are sent to the tasks (16 bytes each).
REPORT, COUNT_AT_ONCE, HEAVY = 2, 1_000_000, 1 << 20
#: Earlier shingles of a set that an entry of the second pass carries, so that a pair is met once rather than at each shingle.
EARLIER = 4
#: Pairs of one set that go to a task together; the pairs of a set with more are dealt over several tasks.
PAIRS = 128
#: Words hashed together; longer texts are hashed in pieces.
PIECE = 1 << 16

MULTIPLIER = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


class Powers:
    """Powers of the hash multiplier and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, m, np.uint64)))) for m in (MULTIPLIER, INVERSE)
            )
        return self.up, self.down


POWERS = Powers()


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are parted by ASCII white space after A-Z are lower-cased.  Fewer words than ``size`` make one
    shingle; no words none.  A polynomial hash over prefixes gives every shingle in constant time.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    found = []
    for at in range(0, max(1, len(words) - size + 1), PIECE):
        part = words[at : at + PIECE + size - 1]
        raw = np.frombuffer(b" ".join(part), np.uint8)
        up, down = POWERS.get(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        span = min(size, len(part))
        first, last = starts[: len(part) - span + 1], ends[span - 1 :]
        h = (sums[last] - sums[first]) * down[first]
        # a finaliser spreads the polynomial over all bits
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        found.append(h)
    return np.unique(np.concatenate(found))


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that identify a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def heavy_shingles(df: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most widespread shingles of all documents, sorted, with their counts.

    Every task counts all its sets and reports what it met at least REPORT times; the reports are summed.
    Copies inside a task count once.
    """

    def count(batches):
        import pyarrow as pa

        waiting, size, seen = [], 0, set()

        def report():
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            keep = counts >= REPORT
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["token", "n"]
            )

        for batch in batches:
            for text in as_bytes(batch, text_col):
                own = shingle_set(text)
                if not len(own) or (name := digest(own)) in seen:
                    continue
                seen.add(name)
                waiting.append(own)
                size += len(own)
                if size >= COUNT_AT_ONCE:
                    yield report()
                    waiting, size, seen = [], 0, set()
        if waiting:
            yield report()

    counts = df.select(text_col).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "token").limit(HEAVY).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("n").to_numpy()[order]


def prefix(shingles: np.ndarray, tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the global order, enough to meet any set similar to it; how many are not heavy.

    The order is: shingles that are not heavy by hash, then heavy ones by count and hash.
    """
    n = rare = len(shingles)
    length = n - -(-percent * n // 100) + 1
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        weight = np.where(tokens[at] == shingles, counts[at], 0)
        if weight.any():
            shingles = shingles[np.argsort(weight, kind="stable")]
            rare = n - int(np.count_nonzero(weight))
    return shingles[:length], min(rare, length)


def describe_sets(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row per document: ``id``, ``n`` (set size), ``digest`` and ``prefix`` of its set.

    ``rare`` counts the prefix shingles that are not heavy.  The prefix is null for empty sets and for sets
    that the task has described before.
    """
    shared = df.sparkSession.sparkContext.broadcast(heavy_shingles(df, text_col))
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind), T.StructField("n", T.LongType()),
            T.StructField("digest", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
            T.StructField("rare", T.IntegerType()),
        ]
    )

    def describe(batches):
        import pyarrow as pa

        tokens, counts = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            sizes, digests, prefixes, rare = [], [], [], []
            for text in as_bytes(batch, "_text"):
                own = shingle_set(text)
                sizes.append(len(own))
                digests.append(digest(own))
                new = digests[-1] not in seen
                head, n_rare = prefix(own, tokens, counts) if new and len(own) else (None, 0)
                prefixes.append(head if head is None else head.view(np.int64))
                rare.append(n_rare)
                if len(seen) < 1_000_000:
                    seen.add(digests[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(rare, pa.int32()),
                ],
                names=["id", "n", "digest", "prefix", "rare"],
            )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(tidy(describe), schema)


def read_sets(df: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(``sid``, ``own``): the shingles of the sets in ``wanted`` (``sid``, ``id``), read from one document of each."""
    rows = semi(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), wanted, "id")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t) for t in as_bytes(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["digest", "own"],
            )

    found = rows.mapInArrow(tidy(read), "digest binary, own array<long>")
    names = wanted.select("sid", "digest")
    names = F.broadcast(names) if small_enough(names) else names
    return found.join(names, "digest").select("sid", "own")


def with_both(pairs: DataFrame, sets: DataFrame, value: str) -> tuple[DataFrame, list[DataFrame]]:
    """Add ``_a`` and ``_b``, the ``value`` of the sets (``sid``) of each pair; also gives tables to drop later.

    A set with very many pairs, as the leader of a large group has, is copied once for every PAIRS of them, so its
    pairs don't gather in one task.  ``pairs`` is a written table.
    """
    out, sides, used = pairs, [], []
    for key, other in (("b", "a"), ("a", "b")):
        many = pairs.groupBy(key).count().filter(F.col("count") > PAIRS).select(F.col(key).alias("sid"), F.ceil(F.col("count") / PAIRS).alias("parts"))
        used.append(write_table(many, "sets-of-many-pairs"))
        many = F.broadcast(used[-1]) if small_enough(used[-1]) else used[-1]
        copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0).cast("long")))
        copied = sets.join(many, "sid", "left").select(F.col("sid").alias(key), F.col(value).alias(f"_{key}"), F.explode(copies).alias(f"part_{key}"))
        part = F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0).cast("long"))
        out = out.join(many.withColumnRenamed("sid", key), key, "left").withColumn(f"part_{key}", part).drop("parts")
        sides.append((copied, [key, f"part_{key}"]))
    # arrays of sets grow with the corpus, so they are merged by key at every size
    for copied, on in sides:
        out = out.join(copied.hint("merge"), on)
    return out, used


def verify(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Add the exact ``overlap`` of the sets ``a`` and ``b`` of each pair; also gives tables to drop later."""
    both, used = with_both(pairs, sets, "own")
    # equal rows may appear where a document is repeated
    return both.select(*pairs.columns, F.size(F.array_intersect("_a", "_b")).cast("long").alias("overlap")).distinct(), used


def similar(overlap, n_a, n_b):
    """100 * intersection >= PERCENT * union, in integers."""
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


def class_of(n):
    """Size block: similar sets are in the same or in neighbouring blocks."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")


def jaccard_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_sets: bool = False) -> DataFrame:
    """``doc_id`` (the id column), ``n_shingles`` and ``component_id`` of every row.

    Two documents are linked if their shingle sets have a Jaccard similarity of at least PERCENT / 100; the
    component is named by its smallest id.  Documents without words (null or empty text) have 0 shingles and are their
    own components.  A null id belongs to the component of its text, which is null only if no member has an id.
    Repeated rows get equal results; rows that share an id but not the text are judged by their texts.  Texts of any length
    are read whole, piece by piece; an empty table stays empty; other columns, whatever their names, are not looked at and not returned.

    ``with_sets`` adds ``set_digest`` of the row's shingle set (see :func:`add_digests`) and ``stands``: whether the
    row has the smallest (id, digest) of its component, null ids last.  Unlike the component's id, this tells apart
    rows that share an id or have none.
    """
    described = write_table(describe_sets(df, text_col, id_col), "described")
    sets = described.filter("n > 0").groupBy("digest").agg(
        F.max("n").alias("n"), F.min("id").alias("id"), F.max("rare").alias("rare"),
        F.first("prefix", ignorenulls=True).alias("prefix"),
    )
    sets = write_table(sets.withColumn("sid", F.monotonically_increasing_id()), "distinct-sets")
    docs = write_table(described.select("id", "n", "digest"), "documents")
    drop_table(described)
    full = docs.filter("n > 0")

    # index lists of at least two sets
    index = sets.select("sid", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    packed = F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long"))  # half the shuffle of two columns
    index = index.select("token", "sid", packed.alias("at"), (F.col("pos") >= F.col("rare")).alias("heavy"))
    # leaders come with the light lists; heavy lists, which may be long, get theirs by aggregation
    light = write_table(_lists_of_several(index.filter("not heavy").drop("heavy")), "light-lists")
    heavy = index.filter("heavy").select("token", "sid", *_unpacked(F.col("at")))
    heavy = write_table(heavy.withColumn("block", class_of(F.col("n"))), "heavy-lists")
    names = write_table(sets.select("sid", "n", "id", "digest"), "set-names")
    drop_table(sets)
    # the bound on common shingles needs every entry, candidates come from lists that leave room for one
    every = light.select("sid", "token").unionByName(heavy.select("sid", "token"))
    shared = write_table(every.groupBy("sid").agg(F.collect_list("token").alias("shared")), "shared-shingles")
    plain = ("token", "sid", "n", "pos", "block")

    # first answers: every set against the leaders of its own and of the next smaller block
    leaders = heavy.groupBy("token", "block").agg(F.min(F.struct("pos", "n", "sid")).alias("leader"))
    leaders = write_table(leaders, "leaders")
    reach = leaders.withColumn("block", F.explode(F.array("block", F.col("block") + 1)))
    met = heavy.join(reach, ["token", "block"]).select(*plain, "leader")
    for leader in ("own_leader", "low_leader"):
        met = met.unionByName(light.filter("meets").select(*plain, F.col(leader).alias("leader")))
    met = met.select("n", "pos", F.col("sid").alias("b"), F.col("leader.sid").alias("a"), F.col("leader.n").alias("n_a"), F.col("leader.pos").alias("pos_a"))
    first = met.filter((F.col("a") != F.col("b")) & _possible("n_a", "pos_a", "n", "pos")).select("a", "b", "n_a", F.col("n").alias("n_b")).distinct()
    first = _promising(write_table(first, "first-candidates"), shared, "first-pairs")
    known = _overlaps(first, names, df, text_col, id_col, "first-answers")
    links = known.filter(similar(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    comps = connected_components(links)

    # what is left: pairs in different components of one list
    lead = F.col("leader.sid").alias("lead")
    led = heavy.join(leaders, ["token", "block"]).select(*plain, lead, F.lit(True).alias("heavy"))
    led = led.unionByName(light.filter("meets").select(*plain, F.col("own_leader.sid").alias("lead"), F.lit(False).alias("heavy")))
    labelled = led.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low <> _high").select("token")
    labelled = write_table(labelled.join(mixed, "token", "left_semi"), "mixed-lists")
    answers = known.select(F.col("a").alias("lead"), F.col("b").alias("sid"), (F.col("n_a") + F.col("n_b") - 2 * F.col("overlap")).alias("away"))
    placed = labelled.join(answers, ["lead", "sid"], "left").withColumn("away", F.when(F.col("lead") == F.col("sid"), 0).otherwise(F.col("away")))
    # pairs that share one of their last shingles before this one have met there, where less stood in their way
    last = Window.partitionBy("sid").orderBy("pos").rowsBetween(-EARLIER, -1)
    placed = write_table(placed.withColumn("earlier", F.collect_list("token").over(last)), "placed-lists")
    carried = ("sid", "n", "pos", "comp", "lead", "away", "earlier")
    side = lambda df, k, *on: df.select(*on, *[F.col(c).alias(f"{c}_{k}") for c in carried])
    # light lists: one shuffle brings a whole list together, and its entries meet there
    lists = placed.filter("not heavy").repartition("token")
    n_comp = F.count("*").over(Window.partitionBy("token", "comp"))
    top = F.max(F.struct("_n", "comp")).over(Window.partitionBy("token"))
    odd = lists.withColumn("_n", n_comp).withColumn("_main", top).filter(F.col("comp") != F.col("_main.comp"))
    x, y = side(odd, "x", "token", F.col("block").alias("_x")), side(lists, "y", "token", F.col("block").alias("_y"))
    few = x.join(y.hint("merge"), "token").filter(F.abs(F.col("_x") - F.col("_y")) <= 1).drop("_x", "_y")
    # heavy lists: by neighbouring blocks
    lists = placed.filter("heavy")
    main = lists.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    odd = lists.join(main, "token").filter("comp <> main")
    x = side(odd, "x", "token", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("block"))
    many = x.join(side(lists, "y", "token", "block"), ["token", "block"]).drop("block")
    gap, joint = F.abs(F.col("away_x") - F.col("away_y")), F.col("away_x") + F.col("away_y")
    most = (100 - PERCENT) * (F.col("n_x") + F.col("n_y"))  # similar if (100 + PERCENT) * difference is at most this
    same_lead = F.col("lead_x").eqNullSafe(F.col("lead_y")) & gap.isNotNull()
    met = few.unionByName(many).filter(
        (F.col("comp_x") != F.col("comp_y"))
        & _possible("n_x", "pos_x", "n_y", "pos_y")
        & ~F.coalesce(same_lead & ((100 + PERCENT) * gap > most), F.lit(False))
        & ~F.arrays_overlap("earlier_x", "earlier_y")
    )
    swap = F.col("sid_x") > F.col("sid_y")
    pick = lambda c: F.when(swap, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x"))
    drop = lambda c: F.when(swap, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y"))
    met = met.select(
        pick("sid").alias("a"), drop("sid").alias("b"), pick("n").alias("n_a"), drop("n").alias("n_b"),
        F.coalesce(same_lead & ((100 + PERCENT) * joint <= most), F.lit(False)).alias("sure"),
    )
    # every list that two sets share is seen here or is skipped by sizes and answers alone, so lists in
    # which both are in the main component do not matter: the pair is not of different components there
    pairs = met.groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max("sure").alias("sure")
    )
    asked = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.join(asked, ["a", "b"], "left_anti")
    pairs = write_table(pairs, "second-pairs")
    sure = write_table(pairs.filter("sure").select("a", "b"), "sure-links")
    unsure = write_table(pairs.filter("not sure").drop("sure"), "second-candidates")
    drop_table(pairs)
    open_pairs = _promising(unsure, shared, "open-pairs")
    answered = _overlaps(open_pairs, names, df, text_col, id_col, "second-answers")
    more = answered.filter(similar(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b").unionByName(sure)
    if not more.isEmpty():
        comps = connected_components(links.unionByName(more))
    for done in (first, leaders, labelled, placed, light, heavy, shared, known, sure, open_pairs, answered):
        drop_table(done)

    # names of components
    grouped = names.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    lowest = grouped.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("lowest"))
    named = grouped.join(lowest, "comp").select("digest", F.col("lowest.id").alias("component_id"), (F.col("digest") == F.col("lowest.digest")).alias("_best"))
    stands = F.col("_best") & F.col("id").eqNullSafe(F.col("component_id"))
    added = lambda stands: [F.col("digest").alias("set_digest"), stands.alias("stands")] if with_sets else []
    joined = full.join(named, "digest").select("id", "n", "component_id", *added(stands))
    empty = docs.filter("n = 0").withColumn("digest", F.lit(None).cast("binary"))
    empty = empty.select("id", "n", F.col("id").alias("component_id"), *added(F.lit(True)))
    return joined.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), *joined.columns[2:])


def add_digests(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``set_digest``, the digest of the row's shingle set: null if it is empty."""

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t) for t in as_bytes(batch, text_col)]
            yield batch, [pa.array([digest(own) if len(own) else None for own in sets], pa.binary())]

    return map_batches(df, describe, [T.StructField("set_digest", T.BinaryType())])


def _lists_of_several(index: DataFrame) -> DataFrame:
    """Entries of the index lists with another set of similar size in their list, by one shuffle on the shingle.

    A list is sorted by size, so the neighbours of an entry tell whether any set of it can be similar.  ``meets`` is false
    where a list of two leaves no room for enough common shingles.  ``own_leader`` and ``low_leader`` (pos, n, sid) lead
    the entry's own block and the next smaller one.  Heavy shingles don't come here, so no long list gathers in one window.
    """
    order = Window.partitionBy("token").orderBy("at", "sid")
    beside = {f"_{k}": F.lag("at", k).over(order) for k in (2, 1, -1, -2)}
    placed = index.withColumns(beside)
    n, pos = _unpacked(F.col("at"))
    # null, which does not pass, where there is no entry beside
    placed = placed.filter((100 * _unpacked(F.col("_1"))[0] >= PERCENT * n) | (100 * n >= PERCENT * _unpacked(F.col("_-1"))[0]))
    more = F.col("_2").isNotNull() | F.col("_-2").isNotNull() | (F.col("_1").isNotNull() & F.col("_-1").isNotNull())
    alone = _room(n, pos, *_unpacked(F.coalesce("_1", "_-1")))
    placed = placed.select("token", "sid", n, pos, (more | alone).alias("meets")).withColumn("block", class_of(F.col("n")))
    entry = F.min(F.struct("pos", "n", "sid"))
    low = Window.partitionBy("token").orderBy("block").rangeBetween(-1, -1)
    return placed.withColumns({"own_leader": entry.over(Window.partitionBy("token", "block")), "low_leader": entry.over(low)})


def _unpacked(at):
    """Set size and position of an entry."""
    return F.shiftright(at, 32).alias("n"), at.bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")


def _possible(n_a: str, pos_a: str, n_b: str, pos_b: str):
    """Whether sizes and positions leave room for enough common shingles.

    ``pos`` counts the shingles before the one in common.  For the first common shingle of two sets the overlap
    is at most what stands from there on in either set, and every similar pair meets at its first one.
    """
    return _room(F.col(n_a), F.col(pos_a), F.col(n_b), F.col(pos_b))


def _room(a, i, b, j):
    rest = F.least(a - i, b - j)
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & ((100 + PERCENT) * rest >= PERCENT * (a + b))


def _promising(pairs: DataFrame, shared: DataFrame, name: str) -> DataFrame:
    """Pairs of a written table whose prefixes have enough shingles in common, as the table ``name``; ``pairs`` goes.

    The prefix that ends earlier in the global order holds all common shingles up to there, so the overlap is at
    most the common prefix shingles plus the rest of that set.  ``shared`` lists the prefix shingles of a set
    that other sets have, too.
    """
    both, used = with_both(pairs, shared, "shared")
    rest = F.ceil(PERCENT * F.greatest("n_a", "n_b") / 100) - 1
    bound = F.size(F.array_intersect("_a", "_b")) + rest
    out = write_table(both.filter((100 + PERCENT) * bound >= PERCENT * (F.col("n_a") + F.col("n_b"))).select(*pairs.columns), name)
    for done in (pairs, *used):
        drop_table(done)
    return out


def _overlaps(pairs: DataFrame, names: DataFrame, df: DataFrame, text_col: str, id_col: str, name: str) -> DataFrame:
    """Verify pairs, as the table ``name``: reads only the sets that occur in them."""
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = write_table(names.join(wanted, "sid"), "wanted")
    verified, used = verify(pairs, read_sets(df, wanted, text_col, id_col))
    out = write_table(verified, name)
    for done in (wanted, *used):
        drop_table(done)
    return out
