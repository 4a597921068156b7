"""Two-sample comparison of many features in one aggregate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, df in batches:
        yield pd.Series([t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def stars(p: Column) -> Column:
    """***, **, * or ns."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def long_features(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(group, feature, value) from a wide frame, without nulls and NaN."""
    wide = df.select(group, *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features])
    return wide.unpivot([group], features, "feature", "value").filter(F.col("value").isNotNull())


def compare_groups(df: DataFrame, group: str, one: str, two: str, features: list[str], least: int = 5, p_values: bool = True) -> DataFrame:
    """Welch's t, Cohen's d and Bonferroni-corrected p of each feature with `least` values on both sides."""
    long = long_features(df.filter(F.col(group).isin(one, two)), group, features)
    side = lambda f, g: f(F.when(F.col(group) == g, F.col("value")))
    m = long.groupBy("feature").agg(*[side(f, g).alias(f"{k}{i}") for i, g in ((1, one), (2, two)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).filter(f"n1 >= {least} and n2 >= {least}")
    se1, se2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    out = m.select(
        "feature", "n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se1 + se2)).alias("t"),
        F.try_divide((se1 + se2) * (se1 + se2), se1 * se1 / (F.col("n1") - 1) + se2 * se2 / (F.col("n2") - 1)).alias("df"),
        F.when(pooled == 0, 0.0).otherwise(F.try_divide(F.col("m1") - F.col("m2"), pooled)).alias("cohens_d"),
    )
    if not p_values:
        return out
    tested = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # a row a feature
    out = out.withColumn("p", t_p_value("t", "df")).withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * tested))
    return out.withColumns({"sig": stars(F.col("p")), "sig_bonferroni": stars(F.col("p_bonferroni"))})


def min_max_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Two values scaled by their own range, 1 where the range is 0."""
    lo, span = F.least(a, b), F.abs(a - b)
    span = F.when(span == 0, 1.0).otherwise(span)
    return (a - lo) / span, (b - lo) / span


def pass_rates(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Mean of each 0/1 metric in percent by group."""
    return df.groupBy(group).agg(*[(F.avg(F.col(m)) * 100).alias(m) for m in metrics])


def z_heat_map(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Group means as z-scores over the groups, a zero deviation as 1."""
    means = df.groupBy(group).agg(*[F.avg(f).alias(f) for f in features])
    w = Window.partitionBy(F.lit(1))  # a row a group
    std = lambda f: F.when(F.coalesce(F.stddev_samp(f).over(w), F.lit(0.0)) == 0, 1.0).otherwise(F.stddev_samp(f).over(w))
    return means.select(group, *[((F.col(f) - F.avg(f).over(w)) / std(f)).alias(f) for f in features])


def quartiles(df: DataFrame, group: str, value: str, top: int = 10) -> DataFrame:
    """Quartiles of the `top` largest groups, by descending median."""
    q = df.groupBy(group).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.orderBy(F.col("n").desc(), group).limit(top).select(group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).orderBy(F.col("median").desc(), group)


def top_effects(df: DataFrame, n: int = 20, effect: str = "cohens_d") -> DataFrame:
    """The n features with the largest absolute effect."""
    return df.orderBy(F.abs(F.col(effect)).desc(), "feature").limit(n)
