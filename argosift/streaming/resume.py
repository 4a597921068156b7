"""Structured Streaming forms of resume-by-key and keep-first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import clean_post


def stream_posts(spark: SparkSession, path: str, schema: str = "cid string, text string, ts timestamp", form: str = "json") -> DataFrame:
    """Landed files of posts as a stream."""
    return spark.readStream.schema(schema).format(form).load(path)


def clean_stream(posts: DataFrame, least: int = 10) -> DataFrame:
    """Cleaned posts of `least` characters and more."""
    return posts.withColumn("clean_text", clean_post("text")).filter(F.length("clean_text") >= least)


def first_seen(posts: DataFrame, key: str = "cid", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of a key, its state dropped behind the watermark."""
    return posts.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows a window and key."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "cid", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends to Parquet at `path` the rows whose key it lacks, batch by batch; a replayed batch adds nothing.

    Of a batch's rows with one key the least by all columns is taken, so reruns agree. Of what is there only the keys are read.
    """

    def put(batch: DataFrame, _id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("__row")).select("__row.*")
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        (transform(fresh) if transform else fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
