"""Inputs that once broke or stalled an operator: degenerate images, long hosts, many boilerplate lines, arrivals of other columns."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import line_dedup, media, sharding, url_filter
from shelfspark.llm.common import shared_dir

BROKEN = [
    b"P5 0 0 255 ", b"P1 0 0 ", b"P5 99999999999 99999999999 255 ", b"P2 1 1 255 " + b"9" * 40, b"P2 1 1 255 300", b"P3 1 1 255 -1 2 3", b"P1 2 1 1 7",
    b"P5 5 5 255 abc", b"P5 1 1 0 a", b"P6", b"P4 9 1 \x80", b"", b"BM", b"BM" + b"\0" * 60,
    b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 0, 4, 1, 24, 0, 0, 0, 0, 0, 0),
    b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, -4, 4, 1, 24, 0, 0, 0, 0, 0, 0) + b"\0" * 64,
    b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 0, 1, 8, 0, 0, 0, 0, 0, 0) + b"\0" * 64,
]


def test_degenerate_images_give_nulls(spark):
    rows = [(k, data) for k, data in enumerate(BROKEN)] + [(100, b"P1 2 2 1 0 0 1"), (101, b"P4 1 1 \x80"), (102, None)]
    out = {r.k: r for r in media.media_features(spark.createDataFrame(rows, "k long, media binary")).collect()}
    for k, data in enumerate(BROKEN):
        assert out[k].feature is None and out[k].height is None and out[k].payload_bytes is None and out[k].media_bytes == len(data)
    assert (out[100].height, out[100].width, out[101].payload_bytes, out[102].media_bytes) == (2, 2, 1, None)


def test_long_hosts(spark):
    hosts = ["a." * 50_000 + "example.org", "x" * 100_000, "." * 3000 + "com", "de.com", "xn.example.org", "example.orgx"]
    rows = [(k, f"http://{h}/es/p") for k, h in enumerate(hosts)]
    began = time.time()
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.time() - began < 60
    assert out[0] == out[4] == ("example.org/es/", "block") and out[1] == out[2] == out[3] == out[5] == (None, "allow")


def test_long_hosts_as_by_every_suffix(tmp_path):
    rnd = random.Random(1)
    label = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(4)))
    rules = [(rnd.choice(["allow", "block"]), ".".join(label() for _ in range(rnd.randrange(1, 4))) + "/" + label()) for _ in range(40)]
    rules = list({rule: (verdict, rule) for verdict, rule in rules}.values())
    array = url_filter.DigestArray(*url_filter.write_digest_array(rules, str(tmp_path / "rules")))
    urls = [(".".join(label() for _ in range(rnd.randrange(9))), "/" + label()) for _ in range(400)]
    for (host, path), rule, verdict in zip(urls, *array.judge(*map(list, zip(*urls, strict=True))), strict=True):
        fits = [(len(r), r.index("/"), r, v) for v, r in rules if (h := r.partition("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (rule, verdict) == best[2:]


def test_many_boilerplate_lines(spark):
    lines = [f"line number {k}" for k in range(32_000)]
    rows = [(k, "\n".join([f"own {k}", *lines, " \t", f"line number {k} "]), f"s{k}") for k in range(8)]
    began = time.time()
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert time.time() - began < 60
    assert all((r.n_lines, r.n_removed, r.clean_text) == (32_003, 32_001, f"own {r.doc_id}\n \t") for r in out)


def test_line_hashes_are_those_of_spark(spark):
    import xxhash

    texts = ["a", "ab" * 50, "Ünïcode 東京", "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [g % (1 << 64) for g in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("target", [1 << 10, 1 << 28])
def test_arrivals_with_other_columns(spark, target):
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/columns-{random.random()}", target)
    store.append(spark.createDataFrame([(k, "t" * 200 + str(random.random())) for k in range(50)], "doc_id long, text string").coalesce(2))
    store.append(spark.createDataFrame([("en", k, f"later {random.random()}" * 20) for k in range(50, 90)], "lang string, doc_id long, text string").coalesce(2))
    store.append(spark.createDataFrame([(k,) for k in range(90, 99)], "doc_id long").coalesce(1))
    with pytest.raises(ValueError, match="doc_id"):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    before = store.read()
    assert set(before.columns) == {"doc_id", "text", "lang", "shard"}
    want = sorted(map(str, before.select("doc_id", "text", "lang").collect()))
    store.compact()
    after = store.read().select("doc_id", "text", "lang")
    assert sorted(map(str, after.collect())) == want and after.filter("lang = 'en'").count() == 40 and after.filter("text is null").count() == 9
