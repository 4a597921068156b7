"""Readers and writers: CSV in three tempers, JSON lines, text, paired logs, embeddings, nested documents."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

if TYPE_CHECKING:
    import pyarrow as pa

#: Texts hold quotes and line breaks.
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """`df` with consecutive numbers from 0 in file order, without bringing all rows to one task."""
    return place_rows(df.withColumn("__at", F.monotonically_increasing_id()), name)


def place_rows(at: DataFrame, name: str) -> DataFrame:
    """`at` with consecutive numbers from 0 in place of its column `__at`, a monotonically increasing id.

    Such ids hold for one execution of a plan only: planned twice, for the rows and for their counts, partitions may be coalesced
    differently. So the rows are written once to the shared folder, and both sides read them from there.
    """
    fixed = scratch_put(at, "rows")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = fixed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    return fixed.withColumn("__part", part).join(F.broadcast(before), "__part", "left").withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with quoted line breaks; without a schema all columns are strings, so ids stay as they are."""
    reader = spark.read.options(**_CSV)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_csv_strings(spark: SparkSession, path: str, trim: tuple[str, ...] = ()) -> DataFrame:
    """All strings, empty fields as '', the named columns trimmed."""
    df = spark.read.options(**_CSV).csv(path)
    return df.select(*[(strip(F.coalesce(F.col(c), F.lit(""))) if c in trim else F.coalesce(F.col(c), F.lit(""))).alias(c) for c in df.columns])


def read_csv_tolerant(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Latin-1, malformed rows dropped. (S3)"""
    reader = spark.read.options(**_CSV, encoding="ISO-8859-1", mode="DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails on a bad line, else it is dropped."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Lower-cased, trimmed lines that aren't blank; a list that a pattern can hold."""
    lines = spark.read.text(path).select(F.lower(strip("value")).alias("k"))
    return [r[0] for r in lines.filter("k <> ''").collect()]


def read_prompt(spark: SparkSession, path: str) -> str:
    """A whole text file, trimmed; fails if it is missing."""
    return spark.read.text(path, wholetext=True).first()[0].strip()


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists in whatever store it names."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The plain path of a folder in the file system that driver and executors mount; None in any other store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return path.toUri().getPath() if scheme == "file" else None


def read_paired_logs(spark: SparkSession, folder: str, tag: str = "assign", retry: int = 0) -> DataFrame:
    """(batch, prompt, response) of `{tag}_batch<n>_retry<r>_{prompt|response}.txt` files that come in pairs.

    In a mounted folder one task lists the names, they are paired, and all tasks read the files of their pairs: Spark's reader would hold each file's
    status in the driver and open a few of them a task. Of other stores it reads them.
    """
    import os

    pattern = rf"^{tag}_batch(\d+)_retry{retry}_(prompt|response)\.txt$"
    parts = lambda df: df.select("*", F.regexp_extract("name", pattern, 1).try_cast("int").alias("batch"), F.regexp_extract("name", pattern, 2).alias("kind"))
    pick = lambda df, k, c: df.filter(F.col("kind") == k).select("batch", F.col(c).alias(k))
    local = _mounted(spark, folder)
    if local is None or not os.path.isdir(local):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*.txt"))
        empty = [("", f.getPath().getName()) for f in listed if f.getLen() == 0]  # Spark's readers leave these out
        found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_name").alias("name"))
        named = parts(found.union(spark.createDataFrame(empty, "value string, name string")))
        return pick(named, "prompt", "value").join(pick(named, "response", "value"), "batch")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for _ in batches:
            with os.scandir(local) as found:
                while some := [e.name for e in islice(found, 10_000)]:
                    yield pa.RecordBatch.from_pydict({"name": pa.array(some, pa.string())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def content(name: str) -> bytes:
            with open(os.path.join(local, name), "rb") as f:
                return f.read()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                read = {k: pa.array(map(content, some.column(k).to_pylist()), pa.binary()) for k in ("prompt", "response")}
                yield pa.RecordBatch.from_pydict({"batch": some.column("batch"), **read})

    listed = parts(spark.range(0, 1, 1, 1).mapInArrow(names, "name string"))
    # A number of partitions of its own: by the size of the names alone all files would go to one task.
    pairs = pick(listed, "prompt", "name").join(pick(listed, "response", "name"), "batch").repartition(4 * spark.sparkContext.defaultParallelism)
    return pairs.mapInArrow(texts, "batch int, prompt binary, response binary").select("batch", F.col("prompt").cast("string"), F.col("response").cast("string"))


def write_paired_logs(df: DataFrame, folder: str, tag: str = "assign") -> None:
    """(batch, retry, prompt, response) as the files that `read_paired_logs` reads.

    Spark's writers don't name files by a row's values; so the tasks write them to a mounted folder, each under another name first, that a task which
    runs again leaves no half of a file. To other stores the driver writes them, one row at a time. `audit_rows` is the table for all calls.
    """
    import os

    spark = df.sparkSession
    local = _mounted(spark, folder)
    if local is not None:
        spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(local))

        def put(rows: Iterator[Row]) -> None:
            for row in rows:
                for kind in ("prompt", "response"):
                    if row[kind] is not None:
                        path = os.path.join(local, f"{tag}_batch{row['batch']}_retry{row['retry']}_{kind}.txt")
                        half = f"{path}.{uuid.uuid4().hex}"
                        with open(half, "wb") as f:
                            f.write(row[kind].encode("utf-8"))
                        os.replace(half, path)

        df.select("batch", "retry", "prompt", "response").foreachPartition(put)
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in df.toLocalIterator():
        for kind in ("prompt", "response"):
            if row[kind] is not None:
                out = fs.create(hadoop.Path(f"{folder}/{tag}_batch{row['batch']}_retry{row['retry']}_{kind}.txt"))
                out.write(bytearray(row[kind].encode("utf-8")))
                out.close()


def write_csv(df: DataFrame, path: str, floats: int | None = None) -> None:
    """CSV with a header; doubles with so many digits; blanks and line breaks at a text's ends stay, which Spark's writer drops by default."""
    if floats is not None:
        df = df.select(*[F.format_string(f"%.{floats}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.write.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with null keys kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: str = "cid", retry_errors: bool = False) -> DataFrame:
    """Appends rows whose key the output at `path` lacks, as JSON lines; returns them."""
    spark = df.sparkSession
    if first_existing(spark, [path]):
        done = spark.read.schema(df.schema).json(path)
        if retry_errors and "error" in df.columns:
            done = done.filter(F.coalesce("error", F.lit("")) == "")
        df = df.join(done.select(key), key, "left_anti")
    write_jsonl(df, path, "append")
    return df


def write_embeddings(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet of ids and vectors, a folder a group."""
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)


def cached_embeddings(df: DataFrame, path: str, make, key: str = "id") -> DataFrame:
    """The vectors at `path` if they cover exactly the ids of `df`, else made anew and written."""
    spark = df.sparkSession
    if first_existing(spark, [path]):
        old = spark.read.parquet(path)
        if df.join(old, key, "left_anti").isEmpty() and old.join(df, key, "left_anti").isEmpty():
            return old
    write_embeddings(make(df), path)
    return spark.read.parquet(path)


def audit_rows(df: DataFrame) -> DataFrame:
    """(batch, retry, prompt, response) of calls, for an audit table in place of debug files."""
    return df.select("batch", F.lit(0).alias("retry") if "retry" not in df.columns else F.col("retry"), "prompt", "response")


def shared_path(spark: SparkSession) -> str:
    """The folder for scratch files that driver and executors share: spark.checkpoint.dir, or where that is unset one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder in whatever store it is; one that isn't there is no error."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends: lazy results may read it until then."""
    path = f"{shared_path(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, path)
    return path


def scratch_put(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read again: its lineage is cut, so a lost executor costs running tasks only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
