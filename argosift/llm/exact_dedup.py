"""Exact deduplication against a persistent digest index, bucketed and sorted by digest. DataFrame operations only."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import Scratch, attach, text_of

#: Batches that a whole table is added in.
PARTS = 4


def _forget(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class DigestIndex:
    """A table (digest, keep_id, batch), bucketed and sorted by the SHA-256 digest of a text.

    A batch is pre-aggregated by digest, sort-merge anti-joined with the index (whose side needs no shuffle, as its buckets are those of
    the join) and what is new gets appended. Decisions follow: of equal texts the row with the largest doc_id stays, unless an
    earlier batch has brought the text, whose row then stays.

    The caller names a batch. To add it again, after a failure or by mistake, changes nothing: what the index holds under the batch's own
    name, all or a part of it, counts as the batch's own. A batch without a name gets one of its own each time, so only the first try counts.

    A whole table (`decide`, `survivors`) is added as PARTS batches, from the largest doc_ids to the least, so of equal texts the one with the
    largest doc_id comes first and stays. Ids that aren't numbers, and tables in which one id makes most of the rows, are fewer batches.

    Null texts count as empty, and empty texts are equal to each other. Rows with a null doc_id lose against others; among rows
    that tie in doc_id and text exactly one stays. An index without a name lasts as long as the session. An empty batch gives no
    rows. Columns besides doc_id and text are ignored, by whatever name.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"argosift_digests_{uuid.uuid4().hex[:12]}"
        if not name:
            atexit.register(_forget, spark, self.name)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.exists():
            self.buckets = next(int(r[1]) for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if r[0] == "Num Buckets")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    @staticmethod
    def rows(docs: DataFrame) -> DataFrame:
        """(doc_id, digest, copies): equal rows counted, which spreads hot texts by doc_id."""
        hashed = docs.select("doc_id", F.sha2(text_of(), 256).alias("digest"))
        return hashed.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))

    def fresh(self, rows: DataFrame, batch: str) -> DataFrame:
        """What the batch `rows` would append: (digest, keep_id, batch) of the texts that the index lacks."""
        new = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            new = new.repartition(self.buckets, "digest")
        if self.exists():
            new = new.hint("merge").join(self.spark.table(self.name).select("digest"), "digest", "left_anti")
        return new.withColumn("batch", F.lit(batch))

    def _append(self, rows: DataFrame, batch: str) -> str:
        self.fresh(rows, batch).write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        return batch

    def add(self, docs: DataFrame, batch: str | None = None) -> str:
        """Append the digests of `docs` that the index lacks; returns the batch's name."""
        return self._append(self.rows(docs), batch or uuid.uuid4().hex)

    def dedup(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Index `docs` as one batch; returns (doc_id, keep_id, group_size, kept, text_sha256), a row for each row of `docs`.

        group_size counts the batch's rows with the text, and one more where an earlier batch holds the text.
        """
        rows = Scratch(self.spark, "digests").put(self.rows(docs), "rows")
        return self._decided(rows, [self._append(rows, batch or uuid.uuid4().hex)])

    def decide(self, docs: DataFrame, batch: str = "table", parts: int = PARTS) -> DataFrame:
        """The same for a whole table that is added in parts; without other batches group_size counts all rows with the text."""
        rows, names = self._in_parts(docs, batch, parts)
        return self._decided(rows, names)

    def _in_parts(self, docs: DataFrame, batch: str, parts: int) -> tuple[DataFrame, list[str]]:
        """Index `docs` from the largest doc_ids to the least; returns its rows, read from the texts once, and the batches' names."""
        bounds: list = []
        if parts > 1 and isinstance(docs.schema["doc_id"].dataType, NumericType):
            shares = [1 - i / parts for i in range(1, parts)]
            found = docs.agg(F.percentile_approx("doc_id", shares)).first()[0] or []
            bounds = sorted(set(found), reverse=True)
        part = F.lit(len(bounds))
        for i, least in reversed(list(enumerate(bounds))):
            part = F.when(F.col("doc_id") >= F.lit(least), i).otherwise(part)
        rows = Scratch(self.spark, "digests").put(self.rows(docs).withColumn("part", part), "rows", by="part")
        return rows, [self._append(rows.filter(F.col("part") == i), f"{batch}-{i}") for i in range(len(bounds) + 1)]

    def _decided(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        sizes = rows.groupBy("digest").agg(F.sum("copies").alias("here"))
        groups = sizes.join(self.spark.table(self.name), "digest").select("digest", "keep_id", "here", self._own(batches).alias("own"))
        done = attach(rows.select("doc_id", "digest", "copies"), groups, "digest", "here", rows.agg(F.sum("copies")).first()[0] or 0)
        each = done.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return each.select(
            "doc_id", "keep_id", (F.col("here") + F.when(F.col("own"), 0).otherwise(1)).cast("long").alias("group_size"),
            (F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"),
        )

    @staticmethod
    def _own(batches: list[str]) -> Column:
        return F.col("batch").isin(batches)

    def survivors(self, docs: DataFrame, batch: str = "table", parts: int = PARTS) -> DataFrame:
        """The rows of `docs` that stay, with all their columns; of rows that tie in doc_id and text, the least by all columns."""
        rows, names = self._in_parts(docs, batch, parts)
        won = self.spark.table(self.name).filter(self._own(names)).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id"))
        marked = docs.withColumn("__digest", F.sha2(text_of(), 256))
        tied = rows.filter("copies > 1").select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__keep_id"))
        on = lambda side: (marked["__digest"] == side["__digest"]) & marked["doc_id"].eqNullSafe(side["__keep_id"])
        staying = marked.join(won, on(won), "left_semi")
        single = staying.join(tied, (staying["__digest"] == tied["__digest"]) & staying["doc_id"].eqNullSafe(tied["__keep_id"]), "left_anti").drop("__digest")
        several = staying.join(tied, (staying["__digest"] == tied["__digest"]) & staying["doc_id"].eqNullSafe(tied["__keep_id"]), "left_semi")
        least = several.groupBy("__digest", "doc_id").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
        return single.unionByName(least)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "table") -> DataFrame:
    """Decisions of `DigestIndex.decide` for `docs`, against `index` or a new one."""
    return (index or DigestIndex(docs.sparkSession)).decide(docs, batch)
