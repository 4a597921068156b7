import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from argosift.llm.common import Scratch
from argosift.llm.components import connected_components
from argosift.llm.near_dedup import NearDedup, drop_near_duplicates, near_dedup
from argosift.llm.queries import op6_near_dedup
from argosift.llm.shingles import set_digest, shingle_set, word_hashes, words_of

from . import brute
from .conftest import edge_rows


def as_map(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80), (2, 50)])
def test_edge_rows(edge, clashing, k, percent):
    known = [(i, t) for i, t, *_ in edge_rows() if i is not None]
    for df in (edge, clashing.repartition(5)):
        got = near_dedup(df, k, percent)
        assert got.count() == len(edge_rows())
        found = as_map(got)
        assert found.pop(None)[1] is None
        assert found == brute.near(known, k, percent)


def test_empty(empty):
    assert near_dedup(empty).count() == 0
    assert drop_near_duplicates(empty).count() == 0


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op6_near_dedup(spark, sf)
    assert as_map(got) == brute.near(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_chains_and_borders(spark):
    """Chains whose neighbours lie at or just under the similarity, and one large group of near copies."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(120)]  # neighbours share 58 of 60 words
    rows += [(1000 + i, " ".join([*words[:300], f"own{i}"])) for i in range(150)]
    rows += [(2000, " ".join(words[100:140])), (2001, " ".join(words[100:136])), (2002, " ".join(words[104:140]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for k, percent in ((4, 80), (3, 90)):
        assert as_map(NearDedup(k, percent, block=20).components(df)) == brute.near(rows, k, percent)


def test_the_exact_rest_finds_what_pivots_leave(spark):
    """Two bands of one minimum make buckets of strangers; the links must be found all the same."""
    rng = np.random.default_rng(1)
    base = [[f"t{rng.integers(60)}" for _ in range(40)] for _ in range(12)]
    rows = []
    for g, words in enumerate(base):
        for c in range(8):
            own = list(words)
            for j in rng.integers(0, 40, rng.integers(0, 3)):
                own[j] = f"x{rng.integers(1000)}"
            rows.append((g * 100 + c, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_map(NearDedup(1, 70, bands=12, rows=1, block=7).components(df))
    assert got == brute.near(rows, 1, 70)


def test_one_id_with_several_texts(spark):
    """The set with the least digest is the document's, whatever the order of the rows."""
    one, two = ("alpha beta gamma delta " * 3).strip(), ("kappa lambda mu nu " * 3).strip()
    rows = [(1, one), (1, two), (1, two), (2, one), (3, two), (4, None), (4, two), (5, "other words than these here"), (6, one), (6, two)]
    digest = lambda t: set_digest(shingle_set(word_hashes(t), 3))
    own = {}
    for i, t in rows:
        if t and (i not in own or digest(t) < digest(own[i])):
            own[i] = t
    want = brute.near(sorted(own.items()), 3, 80)
    for parts in (1, 5):
        got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 3, 80).collect()
        assert len(got) == len(rows) and all(r.component_id == want[r.doc_id][1] for r in got)
        assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, brute.near([(i, t)], 3, 80)[i][0]) for i, t in rows)


def test_drop_keeps_columns(clashing):
    got = drop_near_duplicates(clashing, 4, 80)
    assert got.columns == clashing.columns
    ids = [r.doc_id for r in got.collect()]
    assert 1 in ids and 2 not in ids and ids.count(None) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té\x0b", max_size=12), max_size=6))
def test_word_hashes_part_words_alike(parts):
    text = " ".join(parts)
    words, hashes = words_of(text), word_hashes(text)
    assert len(words) == len(hashes)
    assert len(set(words)) == len(set(hashes.tolist()))


def test_shingle_sets():
    h = word_hashes("a b a b a b")
    assert len(shingle_set(h, 2)) == 2 and len(shingle_set(h, 6)) == 1 and len(shingle_set(h, 9)) == 1 and not len(shingle_set(h[:0], 3))


@pytest.mark.parametrize("shape", ["path", "star", "cliques", "loops"])
def test_components(spark, shape):
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(999, i) for i in range(300)], "cliques": [(10 * g + i, 10 * g + j) for g in range(6) for i in range(5) for j in range(i)], "loops": [(1, 1), (2, 3), (3, 2), (None, 4)]}[shape]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def templates(rng, number, shared, own, every):
    """Texts on one template that differ in their `own` words; each `every`th has a near copy."""
    frame, rows = [f"f{i}" for i in range(shared)], []
    for i in range(number):
        words = [*frame, *(f"o{i}x{j}" for j in range(own))]
        rows.append((10 * i, " ".join(words)))
        if i % every == 0:
            words[int(rng.integers(len(words)))] = "changed"
            rows.append((10 * i + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize(("number", "percent", "bands", "shared", "own", "every"), [(60, 80, 8, 70, 70, 5), (60, 34, 8, 70, 70, 5), (200, 96, 3, 90, 10, 1)])
def test_prefixes_in_place_of_buckets(spark, monkeypatch, number, percent, bands, shared, own, every):
    """Buckets that a template fills are compared by rare shingles; links and components stay those of brute force."""
    table, made, put = templates(np.random.default_rng(5), number, shared, own, every), {}, Scratch.put

    def keeping(self, df, name, by=None):
        made[name] = put(self, df, name, by)
        return made[name]

    monkeypatch.setattr(Scratch, "put", keeping)
    monkeypatch.setattr(Scratch, "keep", lambda self, *tables: None)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = as_map(NearDedup(1, percent, bands=bands, rows=1, block=3, copies=0).components(df))
    assert got == brute.near(table, 1, percent)
    assert made["rare"].count() > 0
    if every == 1:  # pivots find few pairs; small units of rare shingles find the others
        assert made["more"].count() > made["links"].count() and made["tops"].count() > 100


def test_prefixes_hold_every_link(spark):
    rng = np.random.default_rng(3)
    sets = {i: sorted({int(x) for x in rng.zipf(1.3, 30) % 60}) for i in range(150)}
    df = spark.createDataFrame([(7, i, len(t), t) for i, t in sets.items()], "region long, id long, n int, tokens array<long>")
    for percent in (50, 80, 100):
        scratch, units = Scratch(spark, "test"), {}
        for r in NearDedup(percent=percent)._prefixes(df, scratch).collect():
            units.setdefault(r.key, set()).add(r.id)
        met = {(a, b) for ids in units.values() for a in ids for b in ids if a < b}
        linked = {(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
        assert linked <= met and (percent == 50 or len(met) < 150 * 149 / 2)
