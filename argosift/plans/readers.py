"""Queries through files that other tools leave: loose CSV, word lists, dictionaries, prompts, logs in pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import relational as R
from ..sources import files
from .registry import TOKENS, query, table


def _write(df: DataFrame, name: str) -> str:
    """One string column as text files."""
    path = files.scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query("SELECT p_partkey, p_size, p_brand FROM part")
def tolerant_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a CSV in Latin-1 in which every fiftieth row has a number that is none; such rows go, the others stay."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), "p_brand")
    bad = part.filter("p_partkey % 50 = 0").select(F.concat(F.lit("x"), "p_partkey").alias("p_partkey"), F.lit("many").alias("p_size"), "p_brand")
    path = files.scratch_path(spark, "loose")
    files.write_csv(part.unionAll(bad), path)
    return files.read_csv_tolerant(spark, path, "p_partkey long, p_size int, p_brand string")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")
def loaded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV read row by row with its schema, from an offset on, so many rows of it (the slice is the feature)."""
    path = files.scratch_path(spark, "rows")
    files.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), path)
    return R.slice_rows(files.read_csv(spark, path, "o_orderkey long, o_orderpriority string"), 300, 100, "o_orderkey")


#: A word list as people leave it: blanks, blank lines, capitals.
_KEYWORDS = ["  The ", "", "AND", " \t", "für"]


@query("SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{L}\\p{N}\\p{M}_])(the|and|für)($|[^\\p{L}\\p{N}\\p{M}_])') AS blocked, 'Mark each text.' AS prompt FROM documents")
def listed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and a prompt from text files, the prompt from the first path that exists."""
    words = files.read_keywords(spark, _write(spark.createDataFrame([(k,) for k in _KEYWORDS], "value string").coalesce(1), "words"))
    prompt = _write(spark.createDataFrame([("Mark each text. \n",)], "value string").coalesce(1), "prompt")
    there = files.first_existing(spark, [prompt + "-missing", prompt])
    told = files.read_prompt(spark, there)
    return table(spark, sf_dir, "documents").select("doc_id", T.blocked("text", words).alias("blocked"), F.lit(told).alias("prompt"))


_DIC = "%\n1\tcare\n2\tharm\n%\nhelp\t1\nsafe*\t1\t9\nhurt\t2\nwar*\t2\nkind\t1\t2\n"


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS k FROM documents)
SELECT doc_id, round((100.0 * len(list_filter(k, lambda w: w IN ('help', 'kind') OR starts_with(w, 'safe'))) / greatest(len(k), 1))::DOUBLE, 9) AS mfd2_care,
round((100.0 * len(list_filter(k, lambda w: w IN ('hurt', 'kind') OR starts_with(w, 'war'))) / greatest(len(k), 1))::DOUBLE, 9) AS mfd2_harm FROM t""")
def dictionary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file, parsed, and its token rates; without a file the built-in table stands in."""
    lexicon = L.read_dic(spark, _write(spark.createDataFrame([(_DIC,)], "value string").coalesce(1), "dic"))
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(c, 9).alias(k) for k, c in L.token_rates("text", lexicon).items()])


@query("SELECT conv_id::INTEGER AS batch, max(text) FILTER (role = 'user' AND turn = first_user) AS prompt, max(text) FILTER (role = 'assistant' AND turn = first_answer) AS response FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS first_user, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS first_answer FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0")
def paired_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of prompts and responses, one file each as debug dumps have it, read again in pairs."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    audit = turns.groupBy("conv_id").agg(first("user").alias("prompt"), first("assistant").alias("response")).select(F.col("conv_id").cast("int").alias("batch"), "prompt", "response")
    path = files.scratch_path(spark, "logs")
    files.write_paired_logs(files.audit_rows(audit), path)
    return files.read_paired_logs(spark, path)
