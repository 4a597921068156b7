"""The corpus pipeline, stage by stage against brute force on what the stage was given."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from argosift.llm.common import Scratch, table

from . import brute
from .conftest import BASE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """(name, input, output) of each stage over the whole table."""
    scratch, docs, out = Scratch(spark, "steps"), table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.put(stage(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stages_in_order(steps):
    assert list(steps) == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(b.columns == COLUMNS for name, (_, b) in steps.items() if name != "mixing")


def test_quality_drops_only_what_scores_low(spark, sf, steps):
    from argosift.llm.quality import CompressionQuality

    a, b = steps["quality"]
    model = CompressionQuality.fit(a, table(spark, sf, "labels"))
    want = [r for r in a.collect() if model.scores([r.text])[0] >= 0.3]
    assert rows_of(b) == sorted((tuple(r) for r in want), key=str)
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in b.collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) / len(good) > 0.95 and sum(i in kept for i in bad) / len(bad) < 0.3


def test_exact(steps):
    a, b = steps["exact_dedup"]
    best = {}
    for r in a.collect():
        if (r.text or "") not in best or r.doc_id > best[r.text or ""].doc_id:
            best[r.text or ""] = r
    assert rows_of(b) == sorted((tuple(r) for r in best.values()), key=str)


def test_near(steps):
    a, b = steps["near_dedup"]
    rows = a.collect()
    parts = brute.near([(r.doc_id, r.text) for r in rows], 5, 80)
    assert rows_of(b) == sorted((tuple(r) for r in rows if parts[r.doc_id][1] == r.doc_id), key=str)


def test_leaks(spark, sf, steps):
    a, b = steps["decontamination"]
    rows = a.collect()
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    hit = {i for i, *_, bad in brute.leaks([(r.doc_id, r.text) for r in rows], items) if bad}
    assert hit and rows_of(b) == sorted((tuple(r) for r in rows if r.doc_id not in hit), key=str)


def test_mix(steps):
    a, b = steps["mixing"]
    given, took = {r.doc_id: r for r in a.collect()}, b.groupBy("doc_id").count().collect()
    assert all(r["count"] <= 2 for r in took) and {r.doc_id for r in took} <= set(given)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    total, mixed = (df.agg(F.sum(words)).first()[0] for df in (a, b))
    assert abs(mixed - 1.5 * total) < 0.05 * total
    assert b.select("shard").distinct().count() > 4


def put(spark, folder, docs):
    """The three tables that the pipeline reads, in `folder`."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (8, 0, 0), (14, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, BASE), (2, None), (None, "word")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_edge_rows_through_all_stages(spark, clashing, tmp_path):
    folder = str(tmp_path / "edge")
    put(spark, folder, clashing)
    docs, seen = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        given, scratch = docs, Scratch(spark, "edge")
        docs = scratch.put(stage(spark, docs, folder), name)
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted(docs.columns) == sorted(given.columns)
        if name == "exact_dedup":
            texts = [t or "" for _, t in seen[0]]
            assert sorted(t or "" for _, t in seen[1]) == sorted(set(texts))
            assert all((i is None) == all(j is None for j, u in seen[0] if (u or "") == (t or "")) for i, t in seen[1])
        if name == "near_dedup":
            parts = brute.near([(i, t) for i, t in seen[1] if i is not None], 5, 80)
            assert sorted(map(str, seen[2])) == sorted(str((i, t)) for i, t in seen[1] if i is None or parts[i][1] == i)
        if name == "decontamination":
            bad = brute.leaks(seen[2], [(1, BASE), (2, None), (None, "word")])
            assert sorted(map(str, seen[3])) == sorted(str(r) for r, b in zip(seen[2], bad, strict=True) if not b[-1])
    assert set(seen[4]) <= set(seen[3]) and seen[3]


def test_no_rows_through_all_stages(spark, empty, tmp_path):
    folder = str(tmp_path / "none")
    put(spark, folder, empty)
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == 0 and set(empty.columns) <= set(got.columns)


def test_registered(spark, sf):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
