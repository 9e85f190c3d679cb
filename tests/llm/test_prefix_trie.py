"""Prefix tries against a plain one: rounds over large buckets, copies, prefixes of each other, nulls and empty tables."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import prefix_trie


def brute(conversations):
    """``conversations``: id to a list of (role, text)."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for prefix, own in members.items():
        subtree = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in subtree if len(p) == len(prefix) + 1]
        childless = [p for p in subtree if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in subtree)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in own if len(conversations[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(own), len(prefix), parent, len(own), len(kids), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, conversations, local_turns, parts=3):
    rows = [(c, d + 1, hash_of(t), len(t[1].encode())) for c, turns in conversations.items() for d, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, tid long, n_bytes long").repartition(parts)
    convs = spark.createDataFrame([(c,) for c in conversations], "conv_id long").repartition(parts)
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, convs, local_turns).select(*prefix_trie.COLUMNS).collect()), key=str)


def hash_of(turn):
    return int.from_bytes(hashlib.md5(repr(turn).encode()).digest()[:7], "big")


@pytest.mark.parametrize("local_turns", [1, 1 << 15])
def test_against_a_plain_trie(spark, local_turns):
    rnd = random.Random(4)
    turn = lambda k: ("user" if k % 2 else "assistant", f"é{rnd.randrange(2)}" * (k + 1))
    conversations = {c: [turn(k) for k in range(rnd.randrange(6))] for c in range(60)}
    shared = [("u", "s"), ("a", "long" * 9), ("u", "")]
    conversations |= {c: shared for c in range(100, 130)} | {c: shared[: c % 4] + [("x", str(c % 3))] for c in range(200, 220)}
    conversations |= {-3: [("u", "only")] * 7, 300: [], 301: []}
    assert trie_of(spark, conversations, local_turns) == brute(conversations)


def test_one_sequence_and_prefixes_of_each_other(spark):
    deep = [("u", f"t{k}") for k in range(12)]
    for conversations in ({5: deep}, {5: [], 6: []}, {5: deep, 2: deep}, {k: deep[:k] for k in range(7)}):
        assert trie_of(spark, conversations, 4) == brute(conversations)


def test_from_a_table_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "u", "b"), (1, 0, None, "a"), (1, 0, "u", None), (1, 5, "u", "x" * 50_000), (2, 3, "u", "b"), (2, None, "u", "b"), (None, 1, "u", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("rank", "tid", "depth", "part", "digest", "sid", "n_bytes", "m")})
    got = sorted(map(tuple, prefix_trie.conversation_trie(df).select(*prefix_trie.COLUMNS).collect()), key=str)
    assert got == brute({1: [("u", "b"), ("", "a"), ("u", ""), ("u", "x" * 50_000)], 2: [("u", "b"), ("u", "b")]})
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_ends_in_several_parts(spark):
    conversations = {c: [("u", "all the same")] for c in range(400)} | {1000: [("u", "other")]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_of(spark, conversations, 50, 8) == brute(conversations)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
