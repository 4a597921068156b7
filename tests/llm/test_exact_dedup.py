import hashlib
from collections import defaultdict

import pytest

from argosift.llm.exact_dedup import DigestIndex, exact_dedup
from argosift.llm.queries import op10_exact_dedup

from .conftest import CLASHING, edge_rows


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=str)


def test_edge_rows(edge, clashing):
    for df in (edge, clashing, edge.repartition(7)):
        got = exact_dedup(df).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(edge_rows())
        kept = defaultdict(int)
        for r in got:
            kept[r.text_sha256] += r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1}


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
    assert DigestIndex(empty.sparkSession).survivors(empty).count() == 0


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in op10_exact_dedup(spark, sf).collect()), key=str) == expected(rows)


SMALL = "doc_id long, text string"


def test_index_persists(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b")], SMALL)
    then = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c")], SMALL)
    index = DigestIndex(spark)
    index.dedup(first).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.dedup(then).collect()}
    assert got == {3: (1, 2, False), 4: (5, 2, False), 5: (5, 2, True)}
    assert spark.table(index.name).count() == 3
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert described["Bucket Columns"] == "[`digest`]" and described["Sort Columns"] == "[`digest`]"


def decided(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_a_named_batch_can_be_added_again(spark):
    """After a failure that left a part of the batch, after a whole run, and under another number of shuffle partitions."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (None, "c")], SMALL)
    name = "digests_named"
    try:
        index = DigestIndex(spark, name)
        index.add(docs.filter("doc_id > 1"), "monday")  # all that a first try has published
        want = [(1, 1, 1, True), (2, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)]
        for _ in range(2):
            assert decided(index.dedup(docs, "monday")) == sorted(want, key=str)
        spark.conf.set("spark.sql.shuffle.partitions", 3)
        again = DigestIndex(spark, name, buckets=9)
        assert again.buckets == index.buckets
        assert decided(again.dedup(docs, "monday")) == sorted(want, key=str)
        assert not any(r.kept for r in again.dedup(docs, "tuesday").collect())
        assert spark.table(name).count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_table_added_again_decides_alike(spark, edge):
    index = DigestIndex(spark)
    first, size = decided(index.decide(edge, "all")), spark.table(index.name).count()
    assert decided(index.decide(edge, "all")) == first and spark.table(index.name).count() == size


def test_later_parts_meet_the_index_in_an_anti_join(spark):
    """Each part but the first is sort-merge anti-joined; the index is neither shuffled nor read but by bucket."""
    rows = [(i, f"text {i % 50}") for i in range(200)]
    index = DigestIndex(spark)
    got = index.decide(spark.createDataFrame(rows, SMALL)).collect()
    assert {r.keep_id for r in got} == set(range(150, 200)) and sum(r.kept for r in got) == 50
    batches = {r.batch for r in spark.table(index.name).select("batch").distinct().collect()}
    assert batches == {"table-0"}
    plan = index.fresh(index.rows(spark.createDataFrame(rows, SMALL)), "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "LeftAnti" in plan
    index_side = plan.split("Scan ExistingRDD")[-1]  # the batch's own side is printed first
    assert "Bucketed: true" in index_side and "Exchange" not in index_side


@pytest.mark.parametrize("ids", ["string", "decimal(20,0)", "int"])
def test_ids_of_other_types(spark, ids):
    docs = spark.createDataFrame([(str(i), f"t{i % 7}") for i in range(40)], "doc_id string, text string").selectExpr(f"cast(doc_id as {ids}) as doc_id", "text")
    got = exact_dedup(docs).collect()
    best = {r.text: r.best for r in docs.groupBy("text").agg({"doc_id": "max"}).toDF("text", "best").collect()}
    assert len(got) == 40 and {r.keep_id for r in got} == set(best.values()) and sum(r.kept for r in got) == 7


def test_one_text_in_most_rows(spark):
    """A hot text, and a null id in a third of the rows."""
    rows = [(i if i % 3 else None, "hot" if i % 5 else f"cold {i}") for i in range(3000)]
    got = exact_dedup(spark.createDataFrame(rows, SMALL).repartition(5)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(rows)
    assert sum(r.kept for r in got) == len({t for _, t in rows})


def test_survivors_keep_all_columns(clashing):
    got = DigestIndex(clashing.sparkSession).survivors(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in edge_rows()})
    assert all(r[k] == v for r in rows for k, v in CLASHING.items())
