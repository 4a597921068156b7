"""What the operators of this subpackage share: tables, scratch tables in the shared folder, joins that bear hot keys."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that part words in the contracts: U+0020 and U+0009 to U+000D.
BLANKS = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(c, _UPPER, _LOWER)


def fold(ids: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(ids).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a folder in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Parquet tables in the shared folder. Their lineage is cut: a lost executor costs the running tasks alone.

    Tables that a lazy result still reads must outlive it, so they go when the session ends; `drop` is for the rest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/argosift-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: list[str] = []
        atexit.register(_delete, spark, self.root)

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """`df` as a table, in a folder for each value of the column `by`."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._argosift_path = path
        self.paths.append(path)
        return out

    def drop(self, df: DataFrame | None) -> None:
        if path := getattr(df, "_argosift_path", None):
            _delete(self.spark, path)

    def keep(self, *tables: DataFrame) -> None:
        """Drop all tables but these; nothing may read the others any more."""
        kept = {t._argosift_path for t in tables}
        for path in self.paths:
            if path not in kept:
                _delete(self.spark, path)
        self.paths = [path for path in self.paths if path in kept]


#: A group counts as hot if it has more than 1/HOT_SHARE of the rows: so there are fewer than HOT_SHARE of them, which bounds what is broadcast.
HOT_SHARE = 512


#: Small rows (ids, hashes) that one task takes in a second: where no group can have more, none is treated as hot.
SMALL_ROWS = 100_000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, floor: int = 1000) -> DataFrame:
    """Inner join of `rows` with `groups`, one row per `key`, of which `size` is the number of `rows` it gets of `total`.

    Groups with more than total / HOT_SHARE rows, at most HOT_SHARE of them by counting, are broadcast, so their rows stay where
    they are; all others go by a shuffled join in which no key is large. Groups with `floor` rows or fewer never count as hot.
    """
    least = max(floor, total // HOT_SHARE)
    if total <= least:
        return rows.join(groups, key)
    hot = groups.filter(F.col(size) > least)
    got = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot", *got).join(groups.filter(F.col(size) <= least), key)
    return marked.filter(F.col("__hot")).drop("__hot").unionByName(cold)
