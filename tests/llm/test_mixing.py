from collections import defaultdict

import numpy as np
import pytest

from argosift.llm.mixing import Mixer, _targets, split_tree
from argosift.llm.queries import op3_mixing

from .conftest import edge_rows
from .test_rescore import level


def check(rows, sources):
    """rows: report rows with ids; sources: a source for each row."""
    by = defaultdict(list)
    for r, s in zip(rows, sources, strict=True):
        by[s].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in order]
    targets = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes), 2)
    for s, n, t in zip(order, sizes, targets, strict=True):
        largest = max(r.size for r in by[s])
        assert all(r.source_size == n and r.target == pytest.approx(t) and r.taken <= 2 * r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= largest + 1
        assert t <= 2 * n + 1e-9
    assert sum(targets) == pytest.approx(min(1.5 * sum(sizes), 2 * sum(sizes)))


def test_whole_table(spark, sf):
    got = op3_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    check(got, [r.source for r in got])


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(map(tuple, Mixer().report(df).collect())) for df in (docs, docs.repartition(13)))
    assert one == two
    assert sorted(map(tuple, Mixer().draw(docs).collect())) == sorted(map(tuple, Mixer().draw(docs.repartition(5)).collect()))


def test_edge_rows(edge, clashing, empty):
    source = {}
    for i, t, _, s in edge_rows():
        source[(i, len((t or "").split()))] = s
    for df in (edge, clashing):
        got = Mixer(block_words=5).report(df).collect()
        assert len(got) == len(edge_rows())
        assert {r.size for r in got if r.doc_id == 5} == {0}
        assert all(r.taken <= 2 * r.size for r in got)
    assert Mixer().report(empty).count() == 0
    assert Mixer().draw(empty).count() == 0


def test_draw_holds_what_the_report_says(clashing):
    mixer = Mixer(block_words=5)
    drawn = mixer.draw(clashing)
    assert [c for c in drawn.columns if c != "shard"] == [c for c in clashing.columns if c != "shard"]
    times = defaultdict(int)
    for r in drawn.collect():
        times[(r.doc_id, r.text)] += 1
        assert 0 <= r.shard < mixer.shards
    taken = defaultdict(int)
    for r in mixer.mix(clashing).collect():
        taken[(r.doc_id, r.text)] += r["__passes"]
    assert {k: v for k, v in taken.items() if v} == dict(times)


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_splitting_tree_keeps_quotas(shards):
    quotas = np.array([0, 3, 17, 200, 1])
    parts = split_tree(quotas, shards, np.random.default_rng(2))
    assert (parts.sum(0) == quotas).all() and (parts >= 0).all() and parts.shape == (shards, 5)
    assert parts.sum(1).max() - parts.sum(1).min() <= 5


def test_targets():
    assert _targets([100, 100, 100], [5, 2, 1], 450, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert _targets([10, 1000], [5, 2], 1515, 2) == pytest.approx([20, 1495])
    assert _targets([0, 5], [5, 2], 7.5, 2) == pytest.approx([0, 7.5])
    assert _targets([], [], 0, 2) == []
