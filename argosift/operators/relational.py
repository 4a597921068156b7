"""Recurring relational shapes, with order made explicit by a row index."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: str = "row_index") -> DataFrame:
    """The first row of each key. Rows are ranked within partitions before they move, so hot keys cost one row a partition."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: later attempts win."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def lookup(df: DataFrame, key: str, value: str, order: str = "row_index") -> DataFrame:
    """(key, value) trimmed, without empty ones, the first per key."""
    from ..functions.text import strip

    clean = df.select(strip(F.col(key)).alias(key), F.nullif(strip(F.col(value)), F.lit("")).alias(value), F.col(order).alias("row_index"))
    return keep_first(clean.filter(F.col(key).isNotNull() & (F.col(key) != "") & F.col(value).isNotNull()), [key]).drop("row_index")


def attach_by_priority(df: DataFrame, lookups: Iterable[DataFrame], key: str, value: str) -> DataFrame:
    """`value` from the first lookup that has the key: one union, one aggregate and one join, however many lookups."""
    each = [x.select(key, value, F.lit(i).alias("__priority")) for i, x in enumerate(lookups)]
    best = reduce(DataFrame.unionByName, each).groupBy(key).agg(F.min_by(value, "__priority").alias(value))
    return df.join(best, key, "left")


def semi(df: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur in `keep`."""
    return df.join(keep.select(*keys), keys, "left_semi")


def anti(df: DataFrame, drop: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys don't occur in `drop`; null keys stay."""
    return df.join(drop.select(*keys), keys, "left_anti")


def top_k(df: DataFrame, group: list[str], k: int, by: Column, tie: str = "row_index", rank: str = "topk_rank") -> DataFrame:
    """The k first rows of each group."""
    w = Window.partitionBy(*group).orderBy(by, F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def slice_rows(df: DataFrame, offset: int, limit: int | None, order: str = "row_index") -> DataFrame:
    """Rows from `offset`, `limit` of them, by the row index."""
    out = df.orderBy(order).offset(offset)
    return out if limit is None else out.limit(limit)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for a seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def batches(df: DataFrame, size: int, order: str = "row_index", within: list[str] | None = None) -> DataFrame:
    """`batch`, from 0, for runs of `size` rows in order, null orders first; the rows themselves stay whole.

    Without `within`, rows are sorted by ranges and numbered once (`files.place_rows`), so no single task sees all rows. (W12)
    """
    if within:
        w = Window.partitionBy(*within).orderBy(order)
        return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    from ..sources.files import place_rows

    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    return place_rows(ranged, "__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def value_counts(df: DataFrame, column: str, normalize: bool = False, nulls: bool = False) -> DataFrame:
    """Rows a value; shares of the counted rows if normalized. (A1, A2)"""
    counted = (df if nulls else df.filter(F.col(column).isNotNull())).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counted
    total = counted.agg(F.sum("n").alias("__total"))
    return counted.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__total")).alias("share"))  # one row


def describe_with_overall(df: DataFrame, group: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """n, mean, std, min, max of each metric by group and for all rows as Overall."""
    name = F.when(F.grouping(group) == 1, "Overall").otherwise(F.col(group))
    values = []
    for m in metrics:
        c = F.nanvl(F.col(m).cast("double"), F.lit(None))
        values += [F.round(f(c), digits).alias(f"{m}_{k}") for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.rollup(group).agg(name.alias("__name"), F.count(F.lit(1)).alias("n"), *values).drop(group).withColumnRenamed("__name", group)


def pivot_shares(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column, each column's percentages to one digit (half even), their difference if there are two. (A4, A5)"""
    counts = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)
    totals = counts.agg(*[F.sum(v).alias(f"__{v}") for v in values])
    raw = {v: 100 * F.try_divide(F.col(v), F.col(f"__{v}")) for v in values}
    out = counts.crossJoin(F.broadcast(totals))  # one row
    columns = [F.col(row), *[F.col(v).alias(f"{v}_n") for v in values], *[F.bround(raw[v], 1).alias(f"{v}_pct") for v in values]]
    if len(values) == 2:
        columns.append(F.bround(raw[values[0]] - raw[values[1]], 1).alias("pct_diff"))
    return out.select(*columns)


def cluster_stats(df: DataFrame, group: str, cluster: str = "cluster_id", noise: str = "-1") -> DataFrame:
    """Rows, outliers and their share, clusters, the largest and the median size, by group."""
    sizes = df.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("size"))
    own = F.when(F.col(cluster).cast("string") != noise, F.col("size"))
    out = F.coalesce(F.sum(F.when(F.col(cluster).cast("string") == noise, F.col("size"))), F.lit(0))
    return sizes.groupBy(group).agg(
        F.sum("size").alias("n_total"), out.alias("n_outliers"), F.coalesce(F.try_divide(out, F.sum("size")), F.lit(0.0)).alias("pct_outliers"),
        F.count(own).alias("n_clusters"), F.coalesce(F.max(own), F.lit(0)).alias("largest_cluster"), F.coalesce(F.median(own), F.lit(0.0)).alias("median_cluster_size"),
    )


def top_texts(df: DataFrame, group: list[str], k: int = 5, text: str = "text", rank: str = "topk_rank") -> DataFrame:
    """The k top texts of each group as an array, filled with ''."""
    ranked = df.filter(F.col(rank) <= k).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(rank, text))).alias("__t"))
    texts = F.transform("__t", lambda x: x[text])
    return ranked.select(*group, F.slice(F.concat(texts, F.array_repeat(F.lit(""), k)), 1, k).alias("texts"))


def join_texts(df: DataFrame, key: str, text: str = "text", order: str = "row_index", sep: str = " ") -> DataFrame:
    """All texts of a key in row order, joined."""
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("__t"))
    return listed.select(key, F.array_join(F.transform("__t", lambda x: x[text]), sep).alias("texts"))


def removal_summary(df: DataFrame, group: str, kept: Column) -> DataFrame:
    """Rows before and after a filter, removed ones and their rate in percent, by group."""
    removed = F.count_if(~kept)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), removed.alias("removed"), F.round(F.try_divide(removed * 100.0, F.count(F.lit(1))), 2).alias("removal_rate"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Rows in equal-width bins between least and greatest value."""
    ends = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1)))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of ends


def segment_candidates(items: DataFrame, claims: DataFrame, segment: str = "segment") -> tuple[DataFrame, DataFrame]:
    """Items with their segment's numbered claims, and items whose segment has none, as assignments."""
    from ..functions.text import normalize_label, strip_marks

    w = Window.partitionBy("__seg").orderBy("cluster_id")
    numbered = claims.select(normalize_label(segment).alias("__seg"), F.col("cluster_id"), strip_marks("cluster_claim").alias("cluster_claim")).withColumn("ordinal", F.row_number().over(w))
    keyed = items.withColumn("__seg", normalize_label(segment))
    none = keyed.join(numbered, "__seg", "left_anti").drop("__seg").withColumns({"assign_reason": F.lit("no_claims_for_segment"), "match_status": F.lit("non_matching")})
    return keyed.join(numbered, "__seg").drop("__seg"), none


def merge_back(full: DataFrame, part: DataFrame, columns: list[str], key: str = "row_index") -> DataFrame:
    """`full` with the values of a processed slice where it has some."""
    new = part.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = full.join(new, key, "left")
    old = lambda c: F.col(c) if c in full.columns else F.lit(None)
    return out.withColumns({c: F.coalesce(F.col(f"__new_{c}"), old(c)) for c in columns}).drop(*[f"__new_{c}" for c in columns])


def side_by_side(base: DataFrame, runs: dict[str, DataFrame], key: str = "cid") -> DataFrame:
    """`base` with the columns of each run under its prefix."""
    out = base
    for prefix, run in runs.items():
        out = out.join(run.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in run.columns if c != key]), key, "left")
    return out


def union_tagged(frames: dict[str, DataFrame], tag: str = "platform") -> DataFrame:
    """All rows with the name of their frame; missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def cluster_document(df: DataFrame, top: int = 10) -> DataFrame:
    """One JSON document: points, clusters, outliers, and each cluster's size, mean membership and representatives."""
    reps = top_k(df.filter("cluster_id >= 0"), ["cluster_id"], top, F.col("membership_prob").desc())
    inner = reps.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(F.col("topk_rank").alias("rank"), F.col("row_index").alias("local_index"), "membership_prob", "claim"))).alias("r"))
    sizes = df.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("membership_prob").alias("avg_membership_prob"))
    each = sizes.join(inner, "cluster_id").select("cluster_id", "size", "avg_membership_prob", F.transform("r", lambda x: x.dropFields("rank")).alias("representatives"))
    whole = df.agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), F.count_if(F.col("cluster_id") < 0).alias("n_outliers"))
    clusters = each.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "size", "avg_membership_prob", "representatives"))).alias("clusters"))
    return whole.crossJoin(clusters).select(F.to_json(F.struct("n_points", "n_clusters", "n_outliers", "clusters")).alias("document"))  # one row each


def drop_errors(df: DataFrame, column: str = "error") -> DataFrame:
    """Rows without an error, all rows where there is no such column."""
    return df.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) == "") if column in df.columns else df


def drop_absent(df: DataFrame, column: str, word: str = "Not present") -> DataFrame:
    """Rows whose column doesn't say that there is nothing; every other column, the row index too, stays."""
    return df.filter(F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))) != word.lower())


def drop_small(df: DataFrame, cluster: str = "cluster_id", least: int = 1, noise: int = -1) -> DataFrame:
    """Rows of clusters with `least` members and more, noise left out. (F16)"""
    clustered = df.filter(F.col(cluster) != noise)
    large = clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return clustered.join(large.select(cluster), cluster, "left_semi")


def pick_rows(df: DataFrame, group: list[str], most: int, by: Column | None = None, key: str = "row_index", seed: int = 42) -> DataFrame:
    """At most `most` rows of each group: the first by `by`, or a seeded random choice without it."""
    return top_k(df, group, most, F.xxhash64(F.col(key), F.lit(seed)) if by is None else by, key, "__pick").drop("__pick")


def available(df: DataFrame, metrics: list[str]) -> list[str]:
    """The metrics that have a value in any row, by one aggregate."""
    there = [m for m in metrics if m in df.columns]
    found = df.agg(*[F.count(F.nanvl(F.col(m).cast("double"), F.lit(None))).alias(m) for m in there]).first() if there else {}
    return [m for m in there if found[m]]


def choose(df: DataFrame, keep: list[str], drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """The columns to keep that are there, without those to drop, under new names."""
    return df.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in keep if c in df.columns and c not in drop])


def with_merged_id(df: DataFrame, merged: DataFrame, segment: str = "segment", cluster: str = "cluster_id") -> DataFrame:
    """`df` with the merged_id of its segment and cluster, null without one."""
    return df.join(merged.select(segment, cluster, "merged_id"), [segment, cluster], "left")


def map_values(column: str, names: dict) -> Column:
    """A column's values through a small map, null for values it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column))


def column_sets(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that both have, that only one has, and all of them, in order."""
    left, right = a.columns, b.columns
    return {"common": [c for c in left if c in right], "left": [c for c in left if c not in right], "right": [c for c in right if c not in left], "both": left + [c for c in right if c not in left]}
