"""Relational shapes, statistics, vectors and clusters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from argosift.operators import cluster as C
from argosift.operators import relational as R
from argosift.operators import stance as S
from argosift.operators import stats as X
from argosift.operators import vectors as V
from argosift.schemas import MissingColumns, require_cols, unify, with_columns_of


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_schema_helpers(spark):
    df = spark.createDataFrame([("1", "x")], "ad_archive_id string, ad_creative_bodies string")
    assert unify(df).columns == ["cid", "text"]
    with pytest.raises(MissingColumns):
        require_cols(df, ["cid"])
    assert with_columns_of(df, {"n": F.lit(0), "ad_archive_id": F.lit("no")}).first().ad_archive_id == "1"


def test_first_last_and_ranks(spark):
    df = spark.createDataFrame([(0, "a", 0.5), (1, "a", 0.5), (2, "b", 0.1), (3, None, 0.2), (4, None, 0.3)], "row_index long, k string, p double").repartition(3)
    assert rows(R.keep_first(df, ["k"]), "row_index") == [(0,), (2,), (3,)]
    assert rows(R.keep_last(df, ["k"], "row_index"), "row_index") == [(1,), (2,), (4,)]
    assert rows(R.top_k(df, ["k"], 1, F.col("p").desc()), "k", "row_index") == [("a", 0), ("b", 2), (None, 4)]
    assert rows(R.slice_rows(df, 1, 2), "row_index") == [(1,), (2,)]
    assert rows(R.sample_n(df, 3, "row_index"), "row_index") == rows(R.sample_n(df.repartition(2), 3, "row_index"), "row_index")


def test_priority_and_null_keys(spark):
    base = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "cid string")
    a = spark.createDataFrame([(0, " 1 ", "x"), (1, "1", "y"), (2, "2", " ")], "row_index long, cid string, stance string")
    b = spark.createDataFrame([(0, "1", "z"), (1, "2", "w")], "row_index long, cid string, stance string")
    found = R.attach_by_priority(base, [R.lookup(a, "cid", "stance"), R.lookup(b, "cid", "stance")], "cid", "stance")
    assert rows(found, "cid", "stance") == [("1", "x"), ("2", "w"), ("3", None), (None, None)]
    assert (None,) in rows(R.anti(base, a.select(F.trim("cid").alias("cid")), ["cid"]), "cid")


@pytest.mark.parametrize("parts", [1, 4])
def test_batches_are_consecutive(spark, parts):
    ids = random.Random(1).sample(range(1000), 103)
    df = spark.createDataFrame([(i,) for i in ids], "row_index long").repartition(parts)
    want = [(i, n // 20) for n, i in enumerate(sorted(ids))]
    assert sorted(tuple(r) for r in R.batches(df, 20).select("row_index", "batch").collect()) == want


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_batches_lose_no_wide_row(spark, parts):
    """Whole texts, with the adaptive planner left free to coalesce: every row once, batches full and consecutive."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    n = docs.count()
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        got = R.batches(docs.repartition(parts), 20, "doc_id")
        assert got.columns == ["doc_id", "text", "batch"]
        found = sorted((r.doc_id, r.batch) for r in got.select("doc_id", "batch").collect())
        assert found == [(i, k // 20) for k, (i,) in enumerate(sorted((r.doc_id,) for r in docs.select("doc_id").collect()))] and len(found) == n
        assert got.select(F.sum(F.xxhash64("doc_id", "text").cast("decimal(20,0)"))).first() == docs.select(F.sum(F.xxhash64("doc_id", "text").cast("decimal(20,0)"))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_batches_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d"), (0, "e")], "row_index long, t string")
    got = sorted(R.batches(df, 2).collect(), key=lambda r: (r.batch, r.t))
    assert [r.batch for r in got] == [0, 0, 1, 1, 2] and {r.t for r in got if r.batch == 0} == {"a", "b"} and "".join(sorted(r.t for r in got)) == "abcde"
    assert R.batches(df.limit(0), 2).count() == 0


def test_describe_single_row_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", float("nan"))], "segment string, m double")
    got = {r.segment: r for r in R.describe_with_overall(df, "segment", ["m"]).collect()}
    assert got["b"].m_std is None and got["b"].n == 2 and got["b"].m_mean == 2.0
    assert got["Overall"].n == 4 and got["Overall"].m_mean == 2.0 and got["Overall"].m_std == 1.0


def test_pivot_rounds_half_even(spark):
    df = spark.createDataFrame([("t1", "A")] * 1 + [("t2", "A")] * 7 + [("t1", "B")] * 3, "topic string, platform string")
    got = {r.topic: r for r in R.pivot_shares(df, "topic", "platform", ["A", "B"]).collect()}
    assert got["t1"].A_pct == 12.5 and got["t1"].B_pct == 100.0 and got["t1"].pct_diff == -87.5 and got["t2"].B_n == 0


def test_removal_of_nothing(spark):
    assert R.removal_summary(spark.createDataFrame([], "g string, ok boolean"), "g", F.col("ok")).count() == 0


def test_top_texts_are_filled(spark):
    df = spark.createDataFrame([("c", 2, "second"), ("c", 1, "first")], "cluster_id string, topk_rank int, text string")
    assert R.top_texts(df, ["cluster_id"]).first().texts == ["first", "second", "", "", ""]


# Statistics.


@pytest.mark.parametrize(("t", "df", "p"), [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 2, 1 - 2 / math.sqrt(6)), (1.959964, 1e7, 0.05)])
def test_student(t, df, p):
    assert X.t_two_sided(t, df) == pytest.approx(p, abs=1e-6)
    assert X.t_two_sided(-t, df) == pytest.approx(p, abs=1e-6)


def test_compare_groups(spark):
    rng = random.Random(2)
    data = [(g, rng.gauss(m, 1), 3.0, float(i) if i < 4 else None) for g, m in (("A", 0), ("B", 1)) for i in range(40)]
    got = {r.feature: r for r in X.compare_groups(spark.createDataFrame(data, "platform string, x double, flat double, few double"), "platform", "A", "B", ["x", "flat", "few"]).collect()}
    assert set(got) == {"x", "flat"} and got["flat"].cohens_d == 0.0 and got["flat"].t is None and got["flat"].sig == "ns"
    a, b = ([v for g, v, *_ in data if g == s] for s in "AB")
    va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
    assert got["x"].t == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va / 40 + vb / 40)) and got["x"].cohens_d == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt((va + vb) / 2))
    assert got["x"].p_bonferroni == pytest.approx(min(1, got["x"].p * 2))


def test_z_heat_map_without_spread(spark):
    got = X.z_heat_map(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double"), "g", ["v"])
    assert {r.v for r in got.collect()} == {0.0}


# Vectors and clusters.


def vectors(spark, n=120, groups=3, size=8, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, size))
    m = np.vstack([at[i % groups] + rng.normal(0, 0.6, size) for i in range(n)])
    return m, spark.createDataFrame([(i, [float(x) for x in v], i % groups) for i, v in enumerate(m)], "id long, vector array<double>, label int")


@pytest.mark.parametrize("block", [7, 1000])
def test_similar_pairs(spark, block):
    m, df = vectors(spark)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    want = {(i, j): sims[i, j] for i in range(len(m)) for j in range(i + 1, len(m)) if i % 3 == j % 3 and sims[i, j] >= 0.8}
    got = {(r.a, r.b): r.sim for r in V.similar_pairs(df.repartition(4), 0.8, block=block).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_silhouette_and_dbi(spark):
    m, df = vectors(spark)
    df = df.withColumn("label", F.when(F.col("id") == 5, 99).otherwise(F.col("label")))
    labels = np.array([99 if i == 5 else i % 3 for i in range(len(m))])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d, inside = 1 - u @ u.T, labels != 99
    s = []
    for i in np.flatnonzero(inside):
        own = inside & (labels == labels[i])
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == k].mean() for k in range(3) if k != labels[i])
        s.append((b - a) / max(a, b))
    assert V.silhouette(df, ["label"]).first().silhouette == pytest.approx(np.mean(s))
    cents = {k: u[labels == k].mean(0) for k in set(labels)}
    spread = {k: np.linalg.norm(u[labels == k] - c, axis=1).mean() for k, c in cents.items()}
    dbi = np.mean([max((spread[a] + spread[b]) / np.linalg.norm(cents[a] - cents[b]) for b in cents if b != a) for a in cents])
    assert V.davies_bouldin(df, ["label"]).first().dbi == pytest.approx(dbi)
    assert V.silhouette(df.filter("label = 0"), ["label"]).first().silhouette is None


def test_centroid_merge_chains(spark):
    at = {0: (1.0, 0.0), 1: (0.9, 0.45), 2: (0.5, 0.87), 7: (-1.0, 0.0), -1: (1.0, 0.0)}
    df = spark.createDataFrame([(k, list(v)) for k, v in at.items()], "label int, vector array<double>")
    assert rows(V.centroid_merge(df, 0.8), "label", "merged_label") == [(0, 0), (1, 0), (2, 0), (7, 1)]


def test_greedy_groups_are_stars(spark):
    """Each row is near its neighbours alone; what a seed doesn't reach founds a group of its own."""
    angle = [0, 20, 40, 60, 80]
    df = spark.createDataFrame([("s", i, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate(angle)], "segment string, row_index long, vector array<double>")
    got = rows(C.greedy_merge(df, [math.cos(math.radians(25)), 0.99999]), "threshold", "row_index", "merged_id")
    near = [r[2] for r in got if r[0] < 0.99]
    assert near == [0, 0, 1, 1, 2] and [r[2] for r in got if r[0] > 0.99] == [0, 1, 2, 3, 4]


def test_grid():
    assert V.threshold_grid("0.60:0.70:0.02") == [0.6, 0.62, 0.64, 0.66, 0.68, 0.7]
    assert V.threshold_grid("0.5, 1.5,-1") == [0.0, 0.5, 1.0]


def test_sweep_ranking(spark):
    given = [("s", 0.60, 0.5, 0.9), ("s", 0.62, 0.7, 0.5), ("s", 0.64, 0.7, 0.5), ("s", 0.66, None, None), ("t", 0.6, 0.3, 0.0), ("t", 0.7, 0.3, 0.0), ("u", 0.6, None, None)]
    got = {(r.segment, r.threshold): r for r in C.rank_sweep(spark.createDataFrame(given, "segment string, threshold double, silhouette double, dbi double")).collect()}
    assert [got["s", t].place for t in (0.62, 0.64, 0.60, 0.66)] == [1, 2, 3, 4] and got["s", 0.62].score == 2.0 and got["s", 0.66].score == 0.0
    assert got["t", 0.6].sil_norm == 1.0 and got["t", 0.6].dbi_norm is None and got["u", 0.6].score == 0.0


def test_sweep_of_strangers(spark):
    """At a high threshold all are alone: no silhouette, score 0."""
    _, df = vectors(spark, 20)
    swept = C.threshold_sweep(df.select(F.lit("s").alias("segment"), F.col("id").alias("row_index"), "vector"), [0.9999]).first()
    assert swept.n_groups == swept.n_singletons == 20 and swept.silhouette is None and swept.score == 0.0


def test_sweep_is_judged_where_it_is_walked(spark):
    """The same figures as the operators over rows give, null segments left out, rows without a place walked only; no join of points with groups."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (150, 6)), rng.normal(0, 1, (1, 6)).repeat(3, 0), np.zeros((2, 6))])
    data = [(("a", "b", None)[i % 3], None if i == 6 else i, [float(v) for v in r]) for i, r in enumerate(x)]
    df, grid = spark.createDataFrame(data, "segment string, row_index long, vector array<float>"), [0.2, 0.5, 0.8]
    swept = C.threshold_sweep(df, grid)
    merged = C.greedy_merge(df.filter("segment IS NOT NULL"), grid).join(df, ["segment", "row_index"])
    keys = ["segment", "threshold", "merged_id"]
    sil, dbi = ({(r.segment, r.threshold): r[2] for r in f(merged, keys).collect()} for f in (V.silhouette, V.davies_bouldin))
    sizes = {}
    for r in merged.groupBy(*keys).count().collect():
        sizes.setdefault((r.segment, r.threshold), []).append(r["count"])
    got = {(r.segment, r.threshold): r for r in swept.collect()}
    assert got.keys() == sizes.keys() and len(got) == 6
    for k, n in sizes.items():
        assert (got[k].n_groups, got[k].n_singletons) == (len(n), n.count(1)) and len(n) - n.count(1) >= 2
        assert got[k].silhouette == pytest.approx(sil[k]) and got[k].dbi == pytest.approx(dbi[k])
    assert "Join" not in swept._jdf.queryExecution().executedPlan().toString()


def test_hdbscan_finds_blobs():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [rng.uniform(-20, 20, (15, 2))])
    label, prob = C.hdbscan(x, 15, 3)
    for g in range(3):
        own = label[40 * g : 40 * g + 40]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.9
    assert len(set(label[label >= 0])) == 3 and ((label == -1) == (prob == 0)).all() and prob.max() <= 1 and (label[120:] == -1).mean() > 0.7
    assert (C.hdbscan(x[:5], 15, 3)[0] == -1).all()


def test_density_and_kmeans(spark):
    _, df = vectors(spark)
    found = C.density_clusters(df.withColumn("g", F.lit("x")).drop("label"), "g", least=10, samples=3).collect()
    assert len(found) == 120 and {r.label for r in found} >= {0}
    assert C.kmeans_clusters(df, 3).filter("label >= 0").select("label").distinct().count() == 3
    assert {r.label for r in C.kmeans_clusters(df, 3, least=1000).collect()} == {-1}


def test_representatives_by_string_order(spark):
    df = spark.createDataFrame([(1, "Pro-Climate_14", "x"), (1, "Pro-Climate_100", "y"), (2, "a", "z")], "merged_id int, cluster_id string, cluster_claim string")
    assert rows(C.representatives(df, ["merged_id"]), "merged_id", "cluster_id", "cluster_claim") == [(1, "Pro-Climate_100", "y"), (2, "a", "z")]


def test_stance_vectors_come_in_few_large_blocks(spark, monkeypatch):
    """The regression's input has no more partitions than there are cores, and blocks of many rows."""
    seen = []
    fit = S.LogisticRegression._fit
    monkeypatch.setattr(S.LogisticRegression, "_fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), self.getMaxBlockSizeInMB())) or fit(self, df))
    df = spark.createDataFrame([(f"{i}", f"word{i % 2} more text", "ab"[i % 2]) for i in range(40)], "cid string, text string, stance string").repartition(20)
    with monkeypatch.context() as m:
        m.setattr("argosift.sources.files.scratch_put", lambda d, name: d)
        S.fit_stance(df, min_df=1, max_iter=2)
    assert seen and seen[0][0] <= spark.sparkContext.defaultParallelism and seen[0][1] >= 64


def test_stance_model(spark):
    words = {"Pro-Climate": "climate warming carbon planet", "Pro-Energy": "gas oil jobs drilling", "Neutral": "weather report today local"}
    rng = random.Random(4)
    data = [(f"{s}{i}", " ".join(rng.choices(w.split(), k=6)), s) for s, w in words.items() for i in range(15)]
    df = spark.createDataFrame(data, "cid string, text string, stance string")
    model = S.fit_stance(df, min_df=1)
    got = S.predict_stance(model, df.unionByName(spark.createDataFrame([("n", None, None)], df.schema))).collect()
    truth = {c: s for c, _, s in data}
    assert sum(r.predicted_label == truth.get(r.cid) for r in got) > 42
    assert all(r.prob_pro_climate + r.prob_pro_energy + r.prob_neutral == pytest.approx(1) for r in got) and len(got) == 46
