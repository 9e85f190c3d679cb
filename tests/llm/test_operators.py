"""Operators on small tables: brute force, exact round trips, held-out accuracy, awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import components, decontaminate, jaccard, language_id, line_dedup, media, mixing, pii, sharding, toxicity, url_filter
from shelfspark.llm.common import shared_dir, write_table

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use, as extra input columns
CLASHES = ["_id", "_drop", "_kept", "_line", "_copy", "_run", "_shard", "_live", "row", "id", "h", "key", "number", "text_", "drop", "kept", "time", "size", "score", "n_words", "Shard", "items", "media", "host", "rule", "copies", "pii", "clean_text", "n", "sid", "comp", "token", "run"]


def awkward(spark):
    texts = [None, "", " \n\t ", "...", "a", "word " * 3, LONG, "same text here for all of them", "same text here for all of them", "Ünïcode ñandú 東京"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 == 0 else "s", None) for k, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s", 3), (None, "no id on this one at all", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}), rows


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def operators(spark):
    empty_model = toxicity.ToxicityModel()
    gru = language_id.ByteGRU(["de", "en"])
    benchmark = spark.createDataFrame([(1, "same text here for all"), (None, "word word"), (2, None)], "item_id long, text string")
    return {
        "url": lambda d: url_filter.filter_urls(d, "text"),
        "toxicity": lambda d: toxicity.score_toxicity(d, empty_model),
        "decontaminate": lambda d: decontaminate.find_contamination(d, benchmark),
        "language": lambda d: language_id.identify_language(d, gru),
        "lines": lambda d: line_dedup.remove_boilerplate(d, min_sites=2),
        "mixing": lambda d: mixing.mix_sources(d),
        "sharding": lambda d: sharding.shard_documents(d, f"{shared_dir(spark)}/t-{random.random()}", 1 << 20),
        "media": lambda d: media.media_features(media.images_of_texts(d)),
        "jaccard": lambda d: jaccard.jaccard_components(d),
        "pii": lambda d: pii.find_personal_data(d),
    }


@pytest.mark.parametrize("name", ["url", "toxicity", "decontaminate", "language", "lines", "mixing", "sharding", "media", "jaccard", "pii"])
def test_awkward_and_empty_tables(spark, name):
    df, rows = awkward(spark)
    apply = operators(spark)[name]
    out = apply(df)
    assert out.count() == len(rows)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(r[0]) for r in rows)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert apply(df.limit(0)).count() == 0


# --- 1: URL filters -------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.example.ORG/es/x?q", "https://example.org/en/12", "http://org/", "http://xorg/", "http://b.com/de/#t", "http://b.com/fr/", "http://b.org", None, "no scheme", "a://b.org?/es/"]
    got = url_filter.filter_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), ("com/de/", "block"),
        ("com/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/x") and got[7].host == "" and got[9].host == "b.org"


def test_digest_collisions_are_confirmed(tmp_path):
    path = str(tmp_path / "rules.bin")
    url_filter.write_digest_array(url_filter.DEFAULT_RULES, path, digest=lambda b: 7)
    array = url_filter.DigestArray(path, digest=lambda b: 7)
    assert array.judge(["example.org", "z.net"], ["/es/", "/es/"]) == (["example.org/es/", None], ["block", "allow"])


def test_a_long_list_takes_several_files(tmp_path):
    rules = [("block" if k % 3 else "allow", f"h{k}.net/p{k % 7}") for k in range(500)]
    paths = url_filter.write_digest_array(rules, str(tmp_path / "rules"), file_bytes=600)
    assert len(paths) > 5
    hosts, places = [f"x.h{k}.net" for k in range(520)], [f"/p{k % 7}q" for k in range(520)]
    one = url_filter.DigestArray(*url_filter.write_digest_array(rules, str(tmp_path / "one"))).judge(hosts, places)
    assert url_filter.DigestArray(*paths).judge(hosts, places) == one
    assert one[0] == [f"h{k}.net/p{k % 7}" if k < 500 else None for k in range(520)]


# --- 2: toxicity, 4: language ID ------------------------------------------------------------------


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 3)
    monkeypatch.setattr(toxicity, "LANES", 2)
    rng = np.random.default_rng(1)
    lengths, move = np.array([7, 0, 1, 3, 4, 12]), rng.normal(size=(2, 2))
    emissions, chains = rng.normal(size=lengths.sum()) * 2, toxicity.Chains(lengths)
    got, pairs = toxicity.marginals(chains.grid(emissions, 0.0), move, chains)
    got, at, want_pairs = got.ravel()[chains.places], 0, np.zeros((2, 2))
    for n in lengths:
        weights = {p: np.exp(sum(emissions[at + t] * s for t, s in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:], strict=False))) for p in np.ndindex(*(2,) * n)}
        total = sum(weights.values())
        for t in range(n):
            assert got[at + t] == pytest.approx(sum(w for p, w in weights.items() if p[t]) / total)
        for p, w in weights.items():
            for x, y in zip(p, p[1:], strict=False):
                want_pairs[x, y] += w / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity_model(docs, labels)
    held = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0")
    rows = toxicity.score_toxicity(held, model).collect()
    hit = [r.score >= 0.5 for r in rows if r.toxic == 1]
    false = [r.score >= 0.5 for r in rows if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.03  # some labels have no toxic words
    spans = [r.text[s.start : s.end] for r in rows for s in r.toxic_spans if r.toxic == 1]
    assert "idiot" in {s.lower() for s in spans}


def test_gru_gradients_by_differences():
    model = language_id.ByteGRU(["a", "b"], units=3)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    rng = np.random.default_rng(2)
    symbols, truth = rng.integers(0, 257, (5, 4)), np.array([0, 1, 0, 1])
    _, grads = model.gradients(symbols, truth)
    for name in ("loop", "bias", "out", "out_bias", "table"):
        flat = model.params[name].reshape(-1)
        k = int(np.argmax(np.abs(grads[name])))
        old, eps = flat[k], 1e-2
        flat[k] = old + eps
        up, _ = model.gradients(symbols, truth)
        flat[k] = old - eps
        down, _ = model.gradients(symbols, truth)
        flat[k] = old
        assert (up - down) / (2 * eps) == pytest.approx(grads[name].reshape(-1)[k], rel=0.05)


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train_language_model(docs)
    held = docs.filter("crc32(cast(doc_id as string)) % 5 = 0 and lang is not null")
    rows = language_id.identify_language(held, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


# --- 3: decontamination ---------------------------------------------------------------------------


def test_suffix_array_and_index():
    rng = random.Random(4)
    for _ in range(20):
        text = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 60))])
        full = np.append(text, 0)
        assert decontaminate.suffix_array(full).tolist() == sorted(range(len(full)), key=lambda k: full[k:].tolist())
        index = decontaminate.FMIndex(text, 4)
        phrase = text[: rng.randint(1, min(4, len(text)))]
        low, high = index.search(phrase[None, :])
        at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert at == [k for k in range(len(text)) if text[k : k + len(phrase)].tolist() == phrase.tolist()]


def brute_contamination(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, names = lower(text), set(), set()
    for name, item in items:
        own = lower(item)
        for k in range(max(1, len(own) - 12) if own else 0):
            w = own[k : k + 13]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
def test_pieces_of_a_text_overlap_by_a_window(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    text = " ".join(f"w{k}" for k in range(200)).encode()
    seen = set()
    for before, words in decontaminate.pieces_of(text):
        assert words == decontaminate.words_of(text)[before : before + len(words)]
        seen |= {before + k for k in range(len(words) - 12)}
    assert seen == set(range(188)) and before + len(words) == 200


@pytest.mark.parametrize("block, shard, piece", [(decontaminate.BLOCK_BYTES, 1 << 19, 1 << 20), (40, 1 << 19, 1 << 20), (1 << 20, 50, 20)])
def test_contamination_against_brute_force(spark, monkeypatch, tmp_path, block, shard, piece):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(5)
    words = ["Alpha", "beta", "été", "x1", "Z"]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([3, 13, 15, 0])]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", "; " + rng.choice(items)[1].upper()])) for k in range(60)]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()}
    want = {k: brute_contamination(t, items) for k, t in docs}
    assert found == want
    # the tasks above are other processes; here with small shards and pieces
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    decontaminate.write_phrases([(str(k), t.encode()) for k, t in items], str(tmp_path / "phrases"))
    for (k, _), (n, spans, names) in zip(docs, decontaminate.Phrases(str(tmp_path / "phrases")).find([t.encode() for _, t in docs]), strict=True):
        assert (n, sum(e - b for b, e in decontaminate.merge_spans(spans)), len(names)) == want[k][:3]


def test_hash_collisions_are_confirmed(monkeypatch, tmp_path):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: len(w))  # all words of a length collide
    decontaminate.write_phrases([("x", b"aa bbb c")], str(tmp_path / "phrases"))
    found = decontaminate.Phrases(str(tmp_path / "phrases")).find([b"zz aa bbb c", b"aa bbb d", b"dd bbb c"])
    assert [spans for _, spans, _ in found] == [[(1, 4)], [], []]


# --- 5: lines, 6: mixing, 7: sharding -------------------------------------------------------------


def test_boilerplate_is_exact_near_the_threshold(spark):
    rows = [(s * 10 + k, f"own {s} {k}\nshared by {n}\n\nmore", f"site{s}") for s in range(12) for k, n in enumerate((8, 7)) if s < n]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_removed, r.clean_text) for r in line_dedup.remove_boilerplate(df.filter("text not like '%more%'").unionByName(df.withColumn("text", F.expr("replace(text, 'more', concat('m', doc_id))")))).collect()}
    assert all(("shared by 8" not in t) and (n == ("shared by 7" not in t)) for n, t in got.values())


def test_blank_lines_of_any_kind_stay(spark):
    rows = [(s, f"own {s}\r\n\r\n\t\nshared line\r\n\x0b", f"site{s}") for s in range(10)] + [(None, f"own {s}\nshared line", f"site{s}") for s in range(5)]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.collect():
        assert r.n_removed == 1 and r.clean_text == r.text.replace("shared line\r\n", "").replace("\nshared line", "")


def test_rows_of_one_id_draw_by_themselves(spark):
    rows = [(None, f"w{k} " * 10, "a") for k in range(900)] + [(None, "same words here", "b")] * 900 + [(7, f"t{k} x", "c") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert [r.n for r in got] == [900] * 3 and all(abs(r.taken - r.target) < 0.12 * r.target for r in got)
    again = lambda d: sorted(str(r) for r in mixing.mix_sources(d).collect())
    assert again(df) == again(df.repartition(9))


def test_targets_against_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 400, "é": 100}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = sorted((s for s in sizes if s), key=str) + [None]
    weights, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in order if 3 * sizes[s] <= level * weights[s]}
        if more == capped:
            break
        capped = more
    want = {s: min(3 * sizes[s], level * weights[s]) for s in order}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_reruns_agree_and_keep_bounds(spark):
    docs = documents(spark)
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mix_sources(d).collect()) for d in (docs, docs.repartition(7)))
    assert one == two
    mixed = mixing.mix_sources(docs)
    assert mixed.filter("taken > 3 * size").count() == 0
    assert mixing.emit_copies(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_store_versions(spark):
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/store-{random.random()}", 200_000)
    docs = documents(spark).repartition(6)
    assert store.manifest().count() == 0
    first = store.append(docs.filter("doc_id % 2 = 0"))
    second = store.append(docs.filter("doc_id % 2 = 1"))
    third = store.compact()
    assert [first, second, third] == store.versions() == [1, 2, 3]
    want = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sorted(r.doc_id for r in store.read(third).collect()) == want
    assert store.read(first).count() == docs.filter("doc_id % 2 = 0").count()
    assert store.manifest(third).agg(F.sum("rows")).first()[0] == len(want)
    with pytest.raises(Exception, match="exists|Exist"):
        store._commit(store.manifest(), second)
    assert store.vacuum() >= 1 and sorted(r.doc_id for r in store.read().collect()) == want


# --- 8: media -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["pgm", "bmp"])
def test_payload_round_trip(spark, kind):
    texts = ["", "a" * 64, "é" * 100, LONG[:1000]]
    rows = media.media_features(media.images_of_texts(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), kind=kind)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        payload = t.encode() + bytes(-len(t.encode()) % 64 if t else 64)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and bytes(r.tile_npy[:6]) == b"\x93NUMPY"


def test_decoders_and_resize():
    assert media.decode(b"P1\n# c\n2 2\n1 0\n0 1").ravel().tolist() == [0, 255, 255, 0]
    assert media.decode(b"P2 2 1 15 0 15").ravel().tolist() == [0, 255]
    assert media.decode(b"P3 1 1 255 1 2 3").ravel().tolist() == [1, 2, 3]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").shape == (1, 1, 3)
    assert media.decode(b"P4 9 1\n\x80\x80").ravel().tolist() == [0] + [255] * 7 + [0]
    image = np.arange(48.0).reshape(6, 8)
    assert np.allclose(media.area_resize(image, 3, 4), image.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert media.area_resize(image, 5, 3).mean() == pytest.approx(image.mean())


def brute_means(image, height, width):
    """Area means by splitting every sample among the boxes it touches."""
    rows, cols = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y, x = (i * rows / height, (i + 1) * rows / height), (j * cols / width, (j + 1) * cols / width)
            wy = [max(0.0, min(y[1], r + 1) - max(y[0], r)) for r in range(rows)]
            wx = [max(0.0, min(x[1], c + 1) - max(x[0], c)) for c in range(cols)]
            out[i, j] = np.array(wy) @ image @ np.array(wx) / (sum(wy) * sum(wx))
    return out


@pytest.mark.parametrize("strip", [1, 100, 1 << 18])
def test_features_against_brute_force(spark, monkeypatch, strip):
    monkeypatch.setattr(media, "STRIP", strip)
    rng = np.random.default_rng(2)
    for rows in (1, 2, 7, 33, 150):
        image = rng.integers(0, 256, (rows, 64)).astype(np.uint8)
        assert np.allclose(media.area_resize(image, 8, 9), brute_means(image.astype(float), 8, 9))
        means = brute_means(image.astype(float), 8, 9)
        bits = "".join("01"[int(a > b + 1e-7)] for row in means for a, b in zip(row, row[1:], strict=False))
        assert media.difference_hash(image) == f"{int(bits, 2):016x}"
        tile = np.load(__import__("io").BytesIO(media.npy_tile(image)))
        assert (tile == np.clip(np.rint(brute_means(image.astype(float), 32, 32)), 0, 255)).mean() > 0.99


# --- 9: similarity join ---------------------------------------------------------------------------


def brute_components(rows):
    sets, parent = {}, {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_jaccard_against_brute_force(spark):
    rng = random.Random(6)
    rows, words = [], [f"w{k}" for k in range(400)]
    for group in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy += [rng.choice(words) for _ in range(rng.randint(1, 15))]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["w1 w2", "W1\tw2", "w1", "", None])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    text = " ".join(f"t{k % 97}x{k % 13}" for k in range(1000)).encode()
    whole = jaccard.shingle_set(text)
    monkeypatch.setattr(jaccard, "PIECE", 64)
    assert (jaccard.shingle_set(text) == whole).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200)], "a long, b long")
    got = {r.node: r.comp for r in components.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


# --- 10: personal data ----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_spans_against_plain_patterns(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "x.y@z-1.org.", "@", "1.2.3.4", "300.1.2.3.4", ".5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "5500005555555559", "+1 (269) 555-3212", "+44", "++12345678901", " ", "é", "日", "7", "-", "  ", "007.1.1.255", "\n", "99999999999999999999", "_%", "text"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    df = pii.find_personal_data(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    got = {r.doc_id: r.s for r in df.select("doc_id", pii.span_list(base).alias("s")).collect()}
    assert got == {k: brute_spans(t) for k, t in enumerate(texts)}


def test_iban_scores_and_long_runs(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "1 " * 60_000, "a" * 300_000, "1.1.1.1 " * 3000]
    rows = pii.find_personal_data(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.kind, s.start, s.end, round(s.score, 2)) for s in rows[0].pii] == [("iban", 5, 32, 1.0)]
    assert [len(r.pii) for r in rows[1:]] == [0, 0, 0, 3000]
    after = pii.find_personal_data(spark.createDataFrame([("1.2.3.4 is our server",), ("1.2.3.4 " + "x" * 50 + " server",)], "text string")).collect()
    assert [round(r.pii[0].score, 2) for r in after] == [0.7, 0.6]
    assert rows[4].pii[-1].start == 8 * 2999


def test_written_table_reads_back(spark):
    assert write_table(spark.range(5), "t").count() == 5
