"""Clustering: greedy seeds, threshold sweeps, density clusters, k-means, and dimension reduction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seed_groups(units: np.ndarray, threshold: float) -> np.ndarray:
    """Row by row: a row joins its earliest seed within the threshold or becomes a seed. Similarities are computed seed by seed."""
    label = np.full(len(units), -1)
    rank = 0
    for i in range(len(units)):
        if label[i] < 0:
            near = units[i:] @ units[i] >= threshold
            near[0] = True
            tail = label[i:]
            tail[near & (tail < 0)] = rank
            rank += 1
    return label


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def greedy_merge(df: DataFrame, thresholds: list[float], group: str = "segment", order: str = "row_index", vector: str = "vector") -> DataFrame:
    """(group, order, threshold, merged_id): greedy seed groups within each group, for every threshold at once. (V7)

    The groups are claim lists of a segment, which the rule walks in order, so each is one task; they hold cluster claims, not posts.
    """
    kinds = {c: t for c, t in df.dtypes}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        u = _units(pdf[vector])
        return pd.concat([pd.DataFrame({group: pdf[group].to_numpy(), order: pdf[order].to_numpy(), "threshold": t, "merged_id": seed_groups(u, t).astype("int32")}) for t in thresholds])

    return df.select(group, order, vector).groupBy(group).applyInPandas(walk, f"{group} {kinds[group]}, {order} {kinds[order]}, threshold double, merged_id int")


def rank_sweep(sweep: DataFrame, group: str = "segment") -> DataFrame:
    """Scores of a sweep: silhouette scaled up, Davies-Bouldin scaled down, their sum, and the place in descending order."""
    w = Window.partitionBy(group)

    def scaled(c: str):
        lo, hi, v = F.min(c).over(w), F.max(c).over(w), F.col(c)
        return F.when(hi == lo, F.try_divide(v, v)).otherwise((v - lo) / (hi - lo))

    out = sweep.withColumn("sil_norm", scaled("silhouette")).withColumn("dbi_norm", 1 - scaled("dbi"))
    out = out.withColumn("score", F.coalesce("sil_norm", F.lit(0.0)) + F.coalesce("dbi_norm", F.lit(0.0)))
    best = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("silhouette").desc_nulls_last(), F.col("threshold").asc())
    return out.withColumn("place", F.row_number().over(best))


def judge_groups(units: np.ndarray, label: np.ndarray, block: int = 4096) -> tuple[float | None, float | None]:
    """(silhouette, Davies-Bouldin index) of groups numbered from 0, as `vectors.silhouette` and `vectors.davies_bouldin` define them, by matrix products."""
    n = np.bincount(label)
    sums = np.zeros((len(n), units.shape[1]))
    np.add.at(sums, label, units)
    means = sums / np.maximum(n, 1)[:, None]
    many = np.flatnonzero(n > 1)
    at = np.full(len(n), -1)
    at[many] = np.arange(len(many))
    away = np.zeros(len(n))
    total = count = 0
    for i in range(0, len(units), block):
        u, own = units[i : i + block], label[i : i + block]
        away += np.bincount(own, np.sqrt(((u - means[own]) ** 2).sum(1)), len(n))
        u, own = u[n[own] > 1], own[n[own] > 1]
        if len(many) > 1 and len(u):
            far, rows, k = 1 - u @ means[many].T, np.arange(len(u)), n[own]
            near = far[rows, at[own]]
            far[rows, at[own]] = np.inf
            x, y = k * near / (k - 1), far.min(1)
            top = np.maximum(x, y)
            total, count = total + np.divide(y - x, top, out=np.zeros(len(u)), where=top != 0).sum(), count + len(u)
    there = np.flatnonzero(n)
    spread, means = (away[there] / n[there]), means[there]
    worst = []
    for c, s in zip(means, spread, strict=True):
        gap = np.sqrt(((means - c) ** 2).sum(1))
        if (gap > 0).any():  # a group isn't compared with itself, nor with one at its own centre
            worst.append(((spread + s)[gap > 0] / gap[gap > 0]).max())
    return total / count if count else None, float(np.mean(worst)) if worst else None


def threshold_sweep(df: DataFrame, thresholds: list[float], group: str = "segment", order: str = "row_index", vector: str = "vector") -> DataFrame:
    """Every threshold's greedy groups, judged and ranked, in one plan.

    The task that walks a group also judges it: a row a threshold leaves it, no point meets the means in rows. Rows without a place in the order take part
    in the walk and aren't judged.
    """
    kinds = dict(df.dtypes)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        u, known, rows = _units(pdf[vector]), pdf[order].notna().to_numpy(), []
        for t in thresholds:
            label = seed_groups(u, t)[known]
            if len(label):
                sizes = np.bincount(label)
                groups, alone = int((sizes > 0).sum()), int((sizes == 1).sum())
                rows.append((pdf[group].iloc[0], t, groups, alone, *(judge_groups(u[known], label) if groups - alone >= 2 else (None, None))))
        return pd.DataFrame(rows, columns=[group, "threshold", "n_groups", "n_singletons", "silhouette", "dbi"]).astype({"silhouette": float, "dbi": float})

    judged = df.filter(F.col(group).isNotNull()).select(group, order, vector).groupBy(group).applyInPandas(judge, f"{group} {kinds[group]}, threshold double, n_groups int, n_singletons int, silhouette double, dbi double")
    return rank_sweep(judged.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("silhouette", "dbi")}), group)


def representatives(df: DataFrame, group: list[str], id: str = "cluster_id") -> DataFrame:
    """The row with the least id, as a string, of each group."""
    cols = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min_by(F.struct(*cols), F.col(id).cast("string")).alias("__r")).select(*group, "__r.*")


# Density clusters.


def _core_tree(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of mutual reachability (Prim, a row of distances at a time): two ends and a length for each edge."""
    n = len(x)
    squares = (x * x).sum(1)
    row = lambda i: np.sqrt(np.maximum(squares + squares[i] - 2 * (x @ x[i]), 0))
    core = np.array([np.partition(row(i), min(k, n - 1))[min(k, n - 1)] for i in range(n)])
    best, link, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    a, b, w, at = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1), 0
    for e in range(n - 1):
        left[at] = False
        d = np.maximum(np.maximum(row(at), core), core[at])
        nearer = left & (d < best)
        best[nearer], link[nearer] = d[nearer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
        a[e], b[e], w[e] = link[at], at, best[at]
    order = np.argsort(w, kind="stable")
    return a[order], b[order], w[order]


def hdbscan(x: np.ndarray, least: int = 15, samples: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(label, probability) by hierarchical density: excess-of-mass selection on the condensed tree; -1 and 0 for noise."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1), np.zeros(n)
    a, b, w = _core_tree(np.asarray(x, float), samples)
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for e in range(n - 1):
        p, q, new = root(a[e]), root(b[e]), n + e
        kids[new] = (p, q, w[e])
        size[new] = size[p] + size[q]
        parent[p] = parent[q] = new

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += kids[v][:2]
        return out

    # Condense: clusters are born at `birth` (1 / distance); points and small branches fall out at some density.
    birth, up, falls, children = {0: 0.0}, {0: None}, {0: []}, {0: []}
    todo, count = [(2 * n - 2, 0)], 1
    while todo:
        node, c = todo.pop()
        while node >= n:
            p, q, d = kids[node]
            density = 1 / max(d, 1e-12)
            big = [v for v in (p, q) if size[v] >= least]
            if len(big) == 2:
                for v in (p, q):
                    birth[count], up[count], falls[count], children[count] = density, c, [], []
                    children[c].append((count, size[v], density))
                    todo.append((v, count))
                    count += 1
                node = -1
            else:
                for v in (p, q):
                    if v not in big:
                        falls[c] += [(i, density) for i in leaves(v)]
                node = big[0] if big else -1
        if 0 <= node < n:
            falls[c].append((node, birth[c]))
    mass = {c: sum(d - birth[c] for _, d in falls[c]) + sum(s * (d - birth[c]) for _, s, d in children[c]) for c in birth}
    chosen: set[int] = set()
    total = dict(mass)
    for c in sorted(birth, reverse=True):
        below = sum(total[k] for k, _, _ in children[c])
        if c and (not children[c] or mass[c] >= below):
            chosen.add(c)
        else:
            total[c] = max(below, mass[c]) if c == 0 else below
    label, prob, number = np.full(n, -1), np.zeros(n), 0
    for c in sorted(chosen):
        k, above = up[c], False
        while k is not None:
            above |= k in chosen
            k = up[k]
        if above:
            continue
        members, stack = [], [c]
        while stack:
            v = stack.pop()
            members += falls[v]
            stack += [k for k, _, _ in children[v]]
        top = max(d for _, d in members)
        for i, d in members:
            label[i], prob[i] = number, min(1.0, d / top) if top > 0 else 1.0
        number += 1
    return label, prob


def density_clusters(df: DataFrame, group: str, id: str = "id", vector: str = "vector", least: int = 15, samples: int = 3) -> DataFrame:
    """(group, id, label, cluster_prob) by hdbscan within each group. (V5)

    One task a group, with a row of distances in memory at a time; for groups beyond some 50,000 points use kmeans_clusters.
    """
    kinds = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id)
        label, prob = hdbscan(_units(pdf[vector]), least, samples)
        return pd.DataFrame({group: pdf[group].to_numpy(), id: pdf[id].to_numpy(), "label": label.astype("int32"), "cluster_prob": prob})

    return df.select(group, id, vector).groupBy(group).applyInPandas(fit, f"{group} {kinds[group]}, {id} {kinds[id]}, label int, cluster_prob double")


def kmeans_clusters(df: DataFrame, k: int, id: str = "id", vector: str = "vector", least: int = 5, seed: int = 42) -> DataFrame:
    """(id, label) by spherical k-means; clusters below `least` become noise, -1. The form that scales with the rows. (V5)"""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = df.select(id, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features")).persist()
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(points)
    found = model.transform(points).select(id, F.col("prediction").alias("label"))
    small = F.broadcast(found.groupBy("label").agg(F.count(F.lit(1)).alias("__n")))  # k rows
    return found.join(small, "label").select(id, F.when(F.col("__n") >= least, F.col("label")).otherwise(-1).alias("label"))


def reduce_pca(df: DataFrame, size: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, vector) of `size` principal components of the centred vectors; also what stands for manifold reduction, which has no distributed form."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = df.select(id, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("x"))
    steps = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="c"), PCA(k=size, inputCol="c", outputCol="p")])
    return steps.fit(points).transform(points).select(id, vector_to_array("p").alias(vector))
