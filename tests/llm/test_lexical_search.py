"""Ranked search against a plain scorer; ties, repeats, nulls, long texts, empty tables."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from shelfspark.llm import lexical_search

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // max(1, n_terms)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, n in own.items() if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "term", "id", "tf", "n", "bucket", "score", "rank")})
    items = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "times", "doc_id", "weight")})
    return sorted(map(tuple, lexical_search.rank_documents(docs.repartition(3), items).collect()), key=str)


def test_against_a_plain_scorer(spark):
    rnd = random.Random(2)
    word = lambda: f"{rnd.choice(['W', 'w', 'é', 'ß9'])}{int(rnd.expovariate(0.05))}"
    text = lambda n: rnd.choice([" ", "-", "\n", "_"]).join(word() for _ in range(n))
    docs = [(k, text(rnd.randrange(80))) for k in range(300)]
    docs += [(7, docs[7][1]), (7, "other words"), (None, docs[3][1]), (None, None), (900, None), (901, ""), (902, "..."), (903, text(40_000))]
    items = [(k, text(rnd.randrange(30))) for k in range(25)] + [(50, None), (51, ""), (None, text(5)), (3, text(4)), (52, "nowhere-found")]
    assert found(spark, docs, items) == brute(docs, items)


def test_ties_go_by_id_and_fewer_than_ten_come_back(spark):
    docs = [(k, "same words here") for k in (5, 3, 9, None, 3)] + [(1, "none of it")] * 9
    got = found(spark, docs, [(1, "Same words words")])
    assert got == brute(docs, [(1, "Same words words")]) and [r[2] for r in got] == [3, 3, 5, 9, None]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == [] and found(spark, [(1, "a b")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_a_whole_index_serves_any_search(spark):
    docs = [(k, f"alpha{k % 7} beta{k % 3} gamma gamma") for k in range(60)]
    postings = lexical_search.build_postings(spark.createDataFrame(docs, "doc_id long, text string"))
    assert postings.filter("term is null").count() == 60 and postings.filter("term = 'gamma'").agg(F.sum("tf")).first()[0] == 120
    for items in ([(1, "alpha3")], [(2, "beta1 alpha6 alpha6")]):
        asked = lexical_search.terms_of_items(spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, lexical_search.search(postings, asked).collect()), key=str) == brute(docs, items)
