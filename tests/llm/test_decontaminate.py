import pytest

from argosift.llm.decontaminate import Decontaminator
from argosift.llm.queries import op8_decontamination

from . import brute
from .conftest import BASE, edge_rows

ITEMS = [(1, "Two three, FOUR five six seven eight nine ten eleven twelve"), (2, "word"), (3, ""), (4, None), (None, "a b"), (5, BASE), (5, BASE), (6, "absent words that no document has in it at all"), (7, "dolor sit amet consectetur lorem ipsum dolor sit amet consectetur lorem")]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.mark.parametrize("window", [10, 3, 1])
def test_edge_rows(spark, edge, clashing, window):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute.leaks([(i, t) for i, t, *_ in edge_rows()], ITEMS, window), key=str)
    assert rows_of(Decontaminator(items, window).report(edge)) == want
    assert rows_of(Decontaminator(items, window).report(clashing.repartition(6))) == want


def test_shuffled_form(spark, edge, monkeypatch):
    """What happens once the windows are too many to be broadcast."""
    from argosift.llm import decontaminate

    monkeypatch.setattr(decontaminate, "_MOST_CHARS", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(Decontaminator(items, 10).report(edge)) == sorted(brute.leaks([(i, t) for i, t, *_ in edge_rows()], ITEMS, 10), key=str)


def test_empty(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Decontaminator(items).report(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    got = Decontaminator(none).report(edge).collect()
    assert len(got) == len(edge_rows()) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert Decontaminator(none).clean(edge).count() == len(edge_rows())


def test_whole_table(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()] for n, c in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    assert rows_of(op8_decontamination(spark, sf)) == sorted(brute.leaks(docs, items), key=str)


def test_clean(spark, clashing):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = Decontaminator(items).clean(clashing)
    assert got.columns == clashing.columns
    hit = {(i, t) for (i, t, *_), out in zip(edge_rows(), brute.leaks([(i, t) for i, t, *_ in edge_rows()], ITEMS[:1]), strict=True) if out[-1]}
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((i, t) for i, t, *_ in edge_rows() if (i, t) not in hit), key=str)
