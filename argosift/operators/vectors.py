"""Vector operators over ARRAY<FLOAT or DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: So many groups, with their vectors, are broadcast at most; the number is checked.
MOST_GROUPS = 20_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str, least: float = 1e-12) -> Column:
    """Scaled to length 1. (V2)"""
    a = F.col(a) if isinstance(a, str) else a
    # The length is made once a vector: inside the lambda it would be made for each element.
    return F.get(F.transform(F.array(F.greatest(norm(a), F.lit(least))), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, null if one is zero. (V6)"""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similar_pairs(df: DataFrame, threshold: float, group: str = "label", id: str = "id", vector: str = "vector", block: int = 2000) -> DataFrame:
    """(group, a, b, sim) for pairs a < b of one group with a cosine of the threshold or more, exactly.

    Each group is cut into blocks of about `block` rows, so a large group is many tasks; two blocks meet in one task, where a matrix
    product compares them, and only pairs that reach the threshold become rows. Rows move once for each block of their group.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    u = df.filter(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(id).alias("id"), unit(vector).alias("u"))
    sizes = u.groupBy(F.col("g").alias("__g")).agg((F.count(F.lit(1)) / block).cast("int").alias("last"))
    placed = u.join(sizes, F.col("g").eqNullSafe(F.col("__g"))).select("g", "id", "u", "last", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int").alias("own"))
    both = placed.select("g", "id", "u", "own", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    cells = both.select("g", "id", "u", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, ids = np.vstack([np.asarray(v, float) for v in pdf["u"]]), pdf["id"].to_numpy()
        left, right = np.flatnonzero(pdf["own"].to_numpy() == key[1]), np.flatnonzero(pdf["own"].to_numpy() == key[2])
        out = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            sims = m[rows] @ m[right].T
            i, j = np.nonzero(sims >= threshold)
            p, q, s = ids[rows[i]], ids[right[j]], sims[i, j]
            keep = p < q if key[1] == key[2] else p != q
            out.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "sim": s[keep]}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "sim": []})
        found.insert(0, group, key[0])
        return found

    return cells.groupBy("g", "x", "y").applyInPandas(compare, f"{group} {kinds[group]}, a {kinds[id]}, b {kinds[id]}, sim double")


def _mean(vector: str) -> Column:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double")))))


def centroids(df: DataFrame, group: list[str], vector: str = "vector", normalize: bool = True) -> DataFrame:
    """(group, size, centroid): the mean of the unit vectors, itself of length 1 if normalized."""
    units = df.withColumn("__u", unit(vector))
    out = units.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), _mean("__u").alias("centroid"))
    return out.withColumn("centroid", unit("centroid")) if normalize else out


def silhouette(df: DataFrame, labels: list[str], vector: str = "vector") -> DataFrame:
    """Mean cosine silhouette over groups that have more than one member, null with fewer than two such groups. (V9)

    `labels`: the columns of an outer key and, last, the label. The mean distance of a point to a group follows from the group's vector
    sum, so no pairs are formed. Returns a row for each outer key.
    """
    *outer, label = labels
    u = df.select(*outer, F.col(label).alias("__l"), unit(vector).alias("u"))
    sums = u.groupBy(*outer, "__l").agg(F.count(F.lit(1)).alias("n"), _mean("u").alias("m")).filter("n > 1")
    every = sums.groupBy(*outer).agg(F.collect_list(F.struct("__l", "n", "m")).alias("__groups"))  # one array of groups for each outer key
    few = sums.count() <= MOST_GROUPS
    side = F.broadcast(every) if few else every
    # Each point meets all groups in one projection: no row is made for a pair, and none moves.
    rows = u.join(side, outer) if outer else u.crossJoin(side)
    own = F.get(F.filter("__groups", lambda g: g["__l"] == F.col("__l")), F.lit(0))
    far = F.array_min(F.transform(F.filter("__groups", lambda g: g["__l"] != F.col("__l")), lambda g: 1 - dot(F.col("u"), g["m"])))
    a = (own["n"] - own["n"] * dot(F.col("u"), own["m"])) / (own["n"] - 1)
    s = rows.select(*outer, a.alias("a"), far.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return s.groupBy(*outer).agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def davies_bouldin(df: DataFrame, labels: list[str], vector: str = "vector") -> DataFrame:
    """Davies-Bouldin index by Euclidean distance on unit vectors, all groups counted, null with fewer than two."""
    *outer, label = labels
    u = df.select(*outer, F.col(label).alias("__l"), unit(vector).alias("u"))
    cents = u.groupBy(*outer, "__l").agg(_mean("u").alias("c"))
    gap = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
    spread = u.join(cents, [*outer, "__l"]).groupBy(*outer, "__l").agg(F.first("c").alias("c"), F.avg(gap(F.col("u"), F.col("c"))).alias("s"))
    x, y = spread.alias("x"), spread.alias("y")
    same = F.lit(True)
    for k in outer:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    # Groups against groups of the same outer key; their number doesn't grow with the rows.
    ratio = F.try_divide(F.col("x.s") + F.col("y.s"), gap(F.col("x.c"), F.col("y.c")))
    worst = x.join(y, same & (F.col("x.__l") != F.col("y.__l"))).select(*[F.col(f"x.{k}") for k in outer], F.col("x.__l").alias("__l"), ratio.alias("r")).groupBy(*outer, "__l").agg(F.max("r").alias("r"))
    return worst.groupBy(*outer).agg(F.avg("r").alias("dbi"))


def centroid_merge(df: DataFrame, threshold: float = 0.8, label: str = "label", vector: str = "vector", noise: int = -1) -> DataFrame:
    """(label, merged_label): groups whose centroids are chained by cosines of the threshold or more become one, numbered from 0 by least label."""
    cents = centroids(df.filter(F.col(label) != noise), [label], vector).select(F.col(label).alias("l"), F.col("centroid").alias("c"))
    x, y = cents.alias("x"), cents.alias("y")
    edges = x.join(y, F.col("x.l") < F.col("y.l")).filter(dot("x.c", "y.c") >= threshold).select(F.col("x.l").alias("a"), F.col("y.l").alias("b"))
    links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cents.select(F.col("l").alias("a"), F.col("l").alias("b"))).distinct()
    reach = _components(links, cents)
    return reach.select(F.col("l").alias(label), (F.dense_rank().over(Window.orderBy("root")) - 1).alias("merged_label"))  # a row a group


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(l, root): the least label reached, over groups, not rows. Each round looks one link further and jumps to the root's root.

    Every round is a table in the shared folder, so plans stay small and a lost executor costs one round at most.
    """
    from ..sources.files import scratch_put

    links, now = scratch_put(links, "links"), scratch_put(nodes.select("l", F.col("l").alias("root")), "roots")
    while True:
        near = links.join(now.withColumnRenamed("l", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        jump = now.select(F.col("l").alias("near"), F.col("root").alias("far"))
        then = scratch_put(near.join(jump, "near").join(now.withColumnRenamed("l", "a"), "a").select(F.col("a").alias("l"), F.least("near", "far").alias("root"), F.col("root").alias("was")), "roots")
        if then.filter("root <> was").isEmpty():
            return then.select("l", "root")
        now = then.select("l", "root")


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln((a + 1) / (b + 1))."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.log((a + 1) / (b + 1))


def threshold_grid(text: str) -> list[float]:
    """`start:end:step`, or numbers parted by commas, kept within 0 and 1. (V8)"""
    if ":" in text:
        lo, hi, step = map(float, text.split(":"))
        found = [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step, 6)) + 1)]
    else:
        found = [float(x) for x in text.split(",") if x.strip()]
    return sorted({min(1.0, max(0.0, x)) for x in found})
