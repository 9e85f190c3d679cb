"""Trie of conversation prefixes by distributed MSD radix partitioning.

Turns are dictionary-encoded, and conversations with the same turns become one sequence with a count.  A bucket is
the set of sequences below a node.  A round deals the sequences of every large bucket by the digit after its common
prefix: the id of the next turn.  New buckets of one sequence are a path, those of few turns are finished
by multikey quicksort inside a task, and only large ones go to the next round, so the number of rounds is that of
branchings above large buckets, not of turns.  Totals of subtrees then go up, round by round.

Every step reduces by sums, counts and minima.  No task takes more than the turns of a local bucket, or a part of a sorted table; the
list of conversations that end at one node is hashed from such parts in turn.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, small_enough, tidy, write_table

#: Turns of a bucket that one task finishes.
LOCAL_TURNS = 1 << 15
#: What a node has.
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: SHA-256 of nothing.
NOTHING = hashlib.sha256(b"").hexdigest()


def _light(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its measured bytes are few."""
    return F.broadcast(df) if small_enough(df) else df


def number_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``rank`` (from 0), ``tid``, ``n_bytes`` of every turn, a written table.

    Turns are ranked by ``turn``, null first, ties by role and then by the MD5 of the text; a null role or text is
    empty.  ``tid`` stands for role and text, ``n_bytes`` are the text's as UTF-8.  Rows without a conversation id belong to none
    and go.  Ranks come from a range-partitioned sort with offsets per part, so a conversation of any length loads no single task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    parts = write_table(turns.orderBy(*order).withColumn("part", F.spark_partition_id()), "sorted-turns")
    coded = write_table(parts.select("role", "digest", "n_bytes").distinct().withColumn("tid", F.monotonically_increasing_id()), "turn-dictionary")
    counts = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a part can have begun before it
    offsets = counts.withColumn("offset", F.sum("n").over(before)).filter("offset is not null").select("conv_id", "part", "offset")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:])) - 1
    placed = parts.withColumn("inside", inside).join(_light(offsets), ["conv_id", "part"], "left")
    ranked = placed.select("conv_id", (F.col("inside") + F.coalesce("offset", F.lit(0))).cast("long").alias("rank"), "role", "digest", "n_bytes")
    out = write_table(ranked.join(_light(coded), ["role", "digest", "n_bytes"]).select("conv_id", "rank", "tid", "n_bytes"), "turns")
    drop_table(parts)
    drop_table(coded)
    return out


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`prefix_trie` of the conversations of a table as :func:`number_turns` orders them.

    Equal rows are turns of their own; texts of any length count whole; other columns, whatever their names, are not looked at; an empty table has no
    trie, not even a root.
    """
    turns = number_turns(df, conv_col, turn_col, role_col, text_col)
    out = prefix_trie(turns.select("conv_id", (F.col("rank") + 1).alias("depth"), "tid", "n_bytes"), turns.select("conv_id").distinct())
    drop_table(turns)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv_id``, ``depth`` from 1 without gaps, ``tid``, ``n_bytes``), a written table.

    ``convs`` (``conv_id``) names all conversations, those without turns, too.  Per node: ``conv_id``, the smallest that starts with its
    prefix, ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of its subtree and ``ends_sha256`` of the conversations that end there.
    """
    classes = _sequences(turns, convs)
    kept = turns.join(_light(classes.select(F.col("sid").alias("conv_id"), "n", "w")), "conv_id")
    rows = write_table(kept.select(F.col("conv_id").alias("sid"), "depth", "tid", "n_bytes", "n", "w"), "sequences")
    rounds = _partition(rows, classes, local_turns)
    if not rounds:
        drop_table(classes)
        return rows.select(*[F.lit(None).cast("long").alias(c) for c in COLUMNS[:-1]], F.lit(None).cast("string").alias(COLUMNS[-1]))
    small = [_paths(rows, members) for _, _, members in rounds] + [_finished(rows, members) for _, _, members in rounds]
    nodes = write_table(_union(small), "small-nodes")
    tops = nodes.filter("top").select("parent_conv_id", "depth", "n_leaves", "saved_tokens")
    above, used = [], []
    for buckets, chains, _ in reversed(rounds):
        own = write_table(_large(buckets, chains, tops), "large-nodes")
        tops = _union([nodes.filter("top"), own.filter("top")]).select("parent_conv_id", "depth", "n_leaves", "saved_tokens")
        above.append(own)
        used += [buckets, chains]
    ends = classes.select(F.col("sid").alias("ends"), "ends_sha256")
    every = _union([nodes, *above]).drop("top").join(_light(ends), "ends", "left")
    out = write_table(every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*COLUMNS), "trie")
    for done in (classes, rows, nodes, *above, *used, *[members for _, _, members in rounds]):
        drop_table(done)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def _sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct sequences: ``sid`` (smallest conversation), ``w`` (conversations), ``n`` (turns), ``ends_sha256``; a written table."""
    # two hashes of (depth, turn), added up without order
    a, b = F.bit_xor(F.xxhash64("depth", "tid")), F.bit_xor(F.xxhash64("tid", F.lit("b"), "depth"))
    per = turns.groupBy("conv_id").agg(F.count("*").alias("n"), a.alias("a"), b.alias("b"))
    zero = F.lit(0).cast("long")
    keyed = convs.join(per, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("n", "a", "b")])
    key = ["n", "a", "b"]
    parts = write_table(keyed.orderBy(*key, "conv_id").withColumn("part", F.spark_partition_id()), "keyed-conversations")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = write_table(parts.groupBy(*key, "part").agg(listed.alias("ids"), F.min("conv_id").alias("sid"), F.count("*").alias("w")), "ends-by-part")
    totals = lists.groupBy(*key).agg(F.count("*").alias("parts"), F.min("sid").alias("sid"), F.sum("w").alias("w"), F.first("ids").alias("ids"))
    alone = totals.filter("parts = 1").select("sid", "w", "n", F.sha2("ids", 256).alias("ends_sha256"))
    # a list in several parts: hashed part by part, in the order of the sort
    several = totals.filter("parts > 1").select(*key, F.col("sid").alias("low"), F.col("w").alias("total"))
    long_lists = lists.join(_light(several), key).select("low", "total", "n", "part", "ids").repartition("low").sortWithinPartitions("low", "part")
    hashed = long_lists.mapInArrow(tidy(_hash_lists), "sid long, w long, n long, ends_sha256 string")
    out = write_table(alone.unionByName(hashed), "distinct-sequences")
    drop_table(parts)
    drop_table(lists)
    return out


def _hash_lists(batches):
    import pyarrow as pa

    now, digest = None, None
    names = ["sid", "w", "n", "ends_sha256"]
    done = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*now, digest.hexdigest()), strict=True))], pa.schema([(c, pa.int64()) for c in names[:3]] + [(names[3], pa.string())]))
    for batch in batches:
        for row in batch.to_pylist():
            this = (row["low"], row["total"], row["n"])
            if this != now:
                if now:
                    yield done()
                now, digest = this, hashlib.sha256(row["ids"].encode())
            else:
                digest.update(b"," + row["ids"].encode())
    if now:
        yield done()


def _partition(rows: DataFrame, classes: DataFrame, local_turns: int) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Radix rounds over large buckets, each as three written tables.

    Buckets: ``m`` (smallest sequence), ``d`` and ``e`` (depths where its common path begins and ends), ``k`` (sequences), ``w``
    (conversations), ``parent``, ``ends``; the nodes of their paths: ``m``, ``d``, ``depth``, ``n_bytes``; and the sequences below the
    path's end: ``m``, ``e``, ``child``, ``size`` (``path``, ``local`` or ``large``), ``n_bytes`` of the child's turn, ``sid``, ``w``, ``n``.
    """
    rounds = []
    first = classes.agg(F.min("sid").alias("m")).first().m
    if first is None:
        return []
    live = write_table(classes.select(F.lit(first).cast("long").alias("m"), F.lit(0).cast("long").alias("d"), "sid", "w", "n", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("n_bytes")), "live")
    while True:
        per = live.groupBy("m", "d", "parent", "n_bytes").agg(F.count("*").alias("k"), F.sum("w").alias("w"))
        per = write_table(per, "sizes")
        below = rows.select("sid", "depth", "tid", F.col("n_bytes").alias("bytes")).join(live.select("m", "d", "sid", "w", "n"), "sid").filter("depth > d")
        level = below.groupBy("m", "d", "depth").agg(F.count("*").alias("c"), F.min("tid").alias("low"), F.max("tid").alias("high"), F.min("bytes").alias("n_bytes"))
        level = write_table(level.join(_light(per.select("m", "d", "k")), ["m", "d"]), "levels")
        split = F.min(F.when((F.col("c") < F.col("k")) | (F.col("low") != F.col("high")), F.col("depth")))
        stop = level.groupBy("m", "d").agg(F.coalesce(split, F.max("depth") + 1).alias("stop"))
        found = per.join(stop, ["m", "d"], "left").withColumn("e", F.coalesce(F.col("stop") - 1, F.col("d"))).drop("stop")
        ended = live.join(_light(found.select("m", "d", "e")), ["m", "d"]).filter("n = e").groupBy("m", "d").agg(F.min("sid").alias("ends"))
        buckets = write_table(found.join(ended, ["m", "d"], "left"), "buckets")
        along = level.join(_light(buckets.select("m", "d", "e")), ["m", "d"]).filter("depth <= e").select("m", "d", "depth", "n_bytes")
        chains = write_table(along.unionByName(buckets.select("m", "d", F.col("d").alias("depth"), "n_bytes")), "common-paths")
        dealt = write_table(below.join(_light(buckets.select("m", "d", "e")), ["m", "d"]).filter("depth = e + 1").select("m", "e", "tid", "bytes", "sid", "w", "n"), "dealt")
        child = dealt.groupBy("m", "e", "tid").agg(F.min("sid").alias("child"), F.count("*").alias("k"), F.sum(F.col("n") - F.col("e")).alias("turns"))
        size = F.when(F.col("k") == 1, "path").when(F.col("turns") <= local_turns, "local").otherwise("large")
        child = child.select("m", "e", "tid", "child", size.alias("size"))
        members = write_table(dealt.join(_light(child), ["m", "e", "tid"]).select("m", "e", "child", "size", F.col("bytes").alias("n_bytes"), "sid", "w", "n"), "members")
        rounds.append((buckets, chains, members))
        for done in (live, per, level, dealt):
            drop_table(done)
        large = members.filter("size = 'large'")
        if large.isEmpty():
            return rounds
        live = large.select(F.col("child").alias("m"), (F.col("e") + 1).alias("d"), "sid", "w", "n", F.col("m").alias("parent"), "n_bytes")


def _paths(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of buckets of one sequence: the rest of its path."""
    own = members.filter("size = 'path'").select("sid", F.col("m").alias("parent"), "e")
    rest = rows.join(_light(own), "sid").filter("depth > e")
    later = F.sum("n_bytes").over(Window.partitionBy("sid").orderBy(F.col("depth").desc()))
    saved = rest.filter("w > 1").withColumn("saved", (F.col("w") - 1) * later).unionByName(rest.filter("w = 1").withColumn("saved", F.lit(0).cast("long")))
    top, last = F.col("depth") == F.col("e") + 1, F.col("depth") == F.col("n")
    return saved.select(
        F.col("sid").alias("conv_id"), "depth", F.when(top, F.col("parent")).otherwise(F.col("sid")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(last, F.col("sid")).alias("ends"), top.alias("top"),
    )


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, top boolean"


def _finished(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of local buckets, each finished inside a task."""
    own = members.filter("size = 'local'").select("sid", F.col("m").alias("parent"), "e", "child")
    rest = rows.join(_light(own), "sid").filter("depth > e")
    rest = rest.select("child", "parent", "e", "sid", "depth", "tid", "n_bytes", "w").repartition("child").sortWithinPartitions("child", "sid", "depth")
    return rest.mapInArrow(tidy(_finish_batches), NODE)


def _finish_batches(batches):
    """Collect one bucket at a time from rows sorted by bucket, sequence and depth."""
    now, held = None, {}
    for batch in batches:
        child, parent, e, sid, _, tid, size, w = (c.to_pylist() for c in batch.columns)
        for k in range(len(child)):
            if child[k] != now:
                if held:
                    yield _as_batch(finish(held, *place))
                now, held, place = child[k], {}, (parent[k], e[k])
            own = held.setdefault(sid[k], (w[k], [], []))
            own[1].append(tid[k])
            own[2].append(size[k])
    if held:
        yield _as_batch(finish(held, *place))


def _as_batch(nodes: list[list]):
    import pyarrow as pa

    names = [field.split()[0] for field in NODE.split(", ")]
    kinds = [pa.bool_() if field.endswith("boolean") else pa.int64() for field in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*nodes, strict=True), kinds, strict=True)], names=names)


def finish(held: dict[int, tuple[int, list[int], list[int]]], parent: int, e: int) -> list[list]:
    """Nodes of a bucket by multikey quicksort; ``held``: sequence to its conversations, turn ids and bytes after depth ``e``.

    A stack holds sets of sequences: those below a new node, and those to be parted by their turn at a place.
    """
    nodes, above = [], []  # rows of NODE, and the number of each one's parent
    stack = [(True, list(held), 0, -1)]
    while stack:
        shared, own, at, up = stack.pop()
        if shared:  # all have the same turn here: a node
            low = min(own)
            n_convs = sum(held[s][0] for s in own)
            ends = [s for s in own if len(held[s][1]) == at + 1]
            rest = [s for s in own if len(held[s][1]) > at + 1]
            nodes.append([low, e + at + 1, nodes[up][0] if up >= 0 else parent, n_convs, 0, 0 if rest else 1, (n_convs - 1) * held[low][2][at], ends[0] if ends else None, up < 0])
            above.append(up)
            if rest:
                stack.append((False, rest, at + 1, len(nodes) - 1))
            continue
        pivot = held[own[len(own) // 2]][1][at]
        parts = ([], [], [])
        for s in own:
            turn = held[s][1][at]
            parts[(turn >= pivot) + (turn > pivot)].append(s)
        for part, same in zip(parts, (False, True, False), strict=True):
            if part:
                stack.append((same, part, at, up))
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        up = nodes[above[k]]
        up[4] += 1
        up[5] += nodes[k][5]
        up[6] += nodes[k][6]
    return nodes


def _large(buckets: DataFrame, chains: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of a round's large buckets; ``tops``: the nodes below them with their totals."""
    kids = tops.groupBy(F.col("parent_conv_id").alias("m"), (F.col("depth") - 1).alias("e")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    zero = F.lit(0).cast("long")
    full = buckets.drop("n_bytes").join(kids, ["m", "e"], "left").withColumns({c: F.coalesce(c, zero) for c in ("kids", "leaves", "saved")})
    later = F.sum("n_bytes").over(Window.partitionBy("m", "d").orderBy(F.col("depth").desc()))
    along = chains.withColumn("later", later).join(_light(full), ["m", "d"])
    top, last = F.col("depth") == F.col("d"), F.col("depth") == F.col("e")
    return along.select(
        F.col("m").alias("conv_id"), "depth", F.when(top, F.col("parent")).otherwise(F.col("m")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(1).alias("n_children"), F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        (F.col("saved") + (F.col("w") - 1) * F.col("later")).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"), top.alias("top"),
    )
