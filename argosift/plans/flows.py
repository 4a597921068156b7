"""Queries through files and streams: round trips, resumed appends, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import files
from ..streaming import resume
from .registry import POSTS, query, table


def _path(spark: SparkSession, name: str) -> str:
    return files.scratch_path(spark, name)


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks through CSV, all strings, nulls as ''."""
    path = _path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return files.read_csv_strings(spark, path)


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with null keys kept."""
    path = _path(spark, "jsonl")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    files.write_jsonl(turns, path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS value FROM embeddings")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors made once, then read by their folder of a group."""
    path, rows = _path(spark, "vectors"), schemas.vectors(spark, sf_dir)
    files.write_embeddings(rows, path, by="label")
    cached = files.cached_embeddings(rows.select("id"), path, lambda ids: rows)
    each = cached.select("id", F.col("label").cast("int").alias("label"), F.posexplode("vector").alias("place", "value"))
    return each.select("id", "label", F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value"))


@query(f"WITH {POSTS} SELECT cid, lang FROM posts")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two runs; the second leaves out what is there."""
    path, posts = _path(spark, "append"), schemas.posts(spark, sf_dir).select("cid", "lang")
    files.append_new(posts.filter("lang = 'en'"), path)
    files.append_new(posts, path)
    return spark.read.schema(posts.schema).json(path)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming: events by hour and type, with a watermark."""
    path = _path(spark, "windows")
    kept = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kept).parquet(f"{sf_dir}/event[s].parquet")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = resume.windowed_counts(timed, "ts", "event_type").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")
    # Update mode: each batch brings the counts that it changed, and state behind the watermark goes. A replayed batch writes its folder anew.
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", files.scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query(f"WITH {POSTS} SELECT cid, text FROM posts WHERE text IS NOT NULL")
def streamed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16, W13 as a stream: each key appended once, replays included."""
    path = _path(spark, "stream")
    docs = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(docs).parquet(f"{sf_dir}/document[s].parquet")
    posts = stream.select(F.col("doc_id").cast("string").alias("cid"), "text").filter("text IS NOT NULL")
    for _ in range(2):  # a replay from the start adds nothing
        resume.append_once(posts, path, files.scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path)
