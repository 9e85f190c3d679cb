"""Line deduplication: what is moved and written, and that both ways of dropping lines agree."""

from pathlib import Path
from random import Random

import pytest

from shelfspark.llm import line_dedup
from shelfspark.llm.common import shared_dir


def sites(spark, n=240):
    rnd, rows = Random(5), []
    for k in range(n):
        lines = [rnd.choice(["", " \t", f"own {k}", f"near {rnd.randrange(40)}", f"far {rnd.randrange(3)} \r"]) for _ in range(rnd.randrange(9))]
        rows.append((rnd.choice([None, k, 7]), rnd.choice([None, f"s{rnd.randrange(30)}"]), None if k % 40 == 3 else "\n".join(lines), k))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, Text string, number int").repartition(8)


def plainly(rows, least=8):
    seen = {}
    for _, site, text, _ in rows:
        for line in (text or "").split("\n"):
            seen.setdefault(line.strip(line_dedup.BLANKS), set()).add(site)
    common, out = {x for x, by in seen.items() if x and len(by) >= least}, set()
    for _, _, text, k in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if x.strip(line_dedup.BLANKS) not in common]
        out.add((k, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("most", [line_dedup.LIST_BYTES, -1])
def test_a_list_that_is_sent_or_joined(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "LIST_BYTES", most)
    rows, df = sites(spark)
    out = line_dedup.remove_boilerplate(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed", "clean_text"]
    got = out.collect()
    assert {(r.number, r.n_lines, r.n_removed, r.clean_text) for r in got} == plainly(rows) and len(got) == len(rows)
    assert {(r.doc_id, r.source, r.Text, r.number) for r in got} == set(rows)
    assert sum(r.n_removed for r in got) > 100 and any(r.n_removed for r in got if r.doc_id is None)


def test_texts_are_not_shuffled_and_lists_are_few_files(spark, tmp_path):
    _, df = sites(spark)
    df.write.parquet(str(tmp_path / "documents"))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    there = set(folder.iterdir())
    try:
        out = line_dedup.remove_boilerplate(spark.read.parquet(str(tmp_path / "documents")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
        new = set(folder.iterdir()) - there
        assert new and all(len(list(x.glob("part-*"))) <= spark.sparkContext.defaultParallelism for x in new)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
