"""Queries over small shapes: filters, projections, label maps, sets of columns, names of things."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import lexicon as L
from ..functions import text as T
from ..operators import relational as R
from ..operators import stats as X
from .registry import POSTS, STANCE_POSTS, STANCES, TOKENS, query, table

_BLANK = r"[ \t\n\r\x0b\x0c]"


@query(rf"SELECT conv_id, turn, regexp_replace(role, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS role FROM conversations WHERE regexp_replace(role, '^{_BLANK}+|{_BLANK}+$', '', 'g') = 'user'")
def trimmed_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose trimmed label is exactly a word."""
    turns = table(spark, sf_dir, "conversations")
    return turns.filter(T.strip("role") == "user").select("conv_id", "turn", T.strip("role").alias("role"))


@query(f"WITH {POSTS} SELECT cid, text AS post, platform FROM posts")
def chosen_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """columns kept, dropped and renamed; the rest never leaves the file."""
    return R.choose(schemas.posts(spark, sf_dir), ["cid", "text", "platform", "lang"], drop=["lang"], rename={"text": "post"})


@query(f"""WITH {POSTS}, {STANCES}, pairs AS (SELECT DISTINCT stance AS segment, (row_index % 7)::VARCHAR AS cluster_id FROM stances WHERE stance IS NOT NULL),
merged AS (SELECT segment, cluster_id, dense_rank() OVER (ORDER BY segment, cluster_id) - 1 AS merged_id FROM pairs WHERE cluster_id <> '6')
SELECT s.cid, s.stance AS segment, (s.row_index % 7)::VARCHAR AS cluster_id, merged_id::INTEGER AS merged_id FROM stances s LEFT JOIN merged m ON m.segment = s.stance AND m.cluster_id = (s.row_index % 7)::VARCHAR""")
def merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's cluster with the id it was merged under, by segment and cluster; null where it was not."""
    rows = schemas.stances(spark, sf_dir).select("cid", F.col("stance").alias("segment"), (F.col("row_index") % 7).cast("string").alias("cluster_id"))
    pairs = rows.filter("segment IS NOT NULL AND cluster_id <> '6'").select("segment", "cluster_id").distinct()
    from pyspark.sql import Window

    numbered = pairs.withColumn("merged_id", F.dense_rank().over(Window.orderBy("segment", "cluster_id")) - 1)  # a row a cluster
    return R.with_merged_id(rows, numbered)


@query("SELECT vec_id AS id, label, CASE label WHEN 0 THEN 'Energy' WHEN 1 THEN 'Climate' WHEN 2 THEN 'Jobs' END AS topic_label FROM embeddings")
def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for cluster numbers from a small map; null without one."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", R.map_values("label", {0: "Energy", 1: "Climate", 2: "Jobs"}).alias("topic_label"))


@query(f"WITH t AS (SELECT doc_id, list_distinct({TOKENS}) AS k FROM documents) SELECT doc_id, len(k)::INTEGER AS n_types, len(list_intersect(k, [{', '.join(repr(w) for w in L.CALLS)}]))::INTEGER AS n_calls FROM t")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of each post, and how many of them a lexicon has."""
    found = T.tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(found)).alias("n_types"), F.size(F.array_intersect(found, F.array(*map(F.lit, L.CALLS)))).alias("n_calls"))


@query("SELECT 'common' AS kind, 'doc_id' AS name UNION ALL SELECT 'left', unnest(['text', 'lang', 'source', 'n_chars']) UNION ALL SELECT 'right', unnest(['quality', 'toxic']) UNION ALL SELECT 'both', unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic'])")
def column_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that two relations share, that only one has, and all of them."""
    sets = R.column_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return spark.createDataFrame([(k, c) for k, names in sets.items() for c in names], "kind string, name string")


@query(rf"""WITH a AS (SELECT conv_id, turn, regexp_replace('**"' || coalesce(text, '') || '"**', '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '^\*{{1,3}}\s*', ''), '\s*\*{{1,3}}$', '') AS t FROM a)
SELECT conv_id, turn, regexp_replace(regexp_replace(t, '^[`''"“”‘’]+|[`''"“”‘’]+$', '', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS bare FROM b""")
def bare_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the marks of emphasis and the quotes around a text."""
    wrapped = F.concat(F.lit('**"'), F.coalesce("text", F.lit("")), F.lit('"**'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_marks(wrapped).alias("bare"))


@query(f"WITH {STANCE_POSTS} SELECT row_index, CASE WHEN row_index % 5 = 4 THEN '-1' ELSE concat_ws('_', stance, (row_index % 5)::VARCHAR) END AS cluster FROM stance_posts")
def composite_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster's id within its segment, noise as -1."""
    label = F.when(F.col("row_index") % 5 == 4, -1).otherwise(F.col("row_index") % 5)
    return schemas.stance_posts(spark, sf_dir).select("row_index", T.composite_id(F.col("stance"), label).alias("cluster"))


@query("SELECT c_custkey, regexp_replace(n, '^(?:liwc_|mfd2_|nrc_|vader_)', '') AS name FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'nrc_' WHEN 1 THEN 'mfd2_' ELSE 'x_' END || lower(c_mktsegment) AS n FROM customer)")
def pretty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features' names without their family."""
    n = F.concat(F.when(F.col("c_custkey") % 3 == 0, "nrc_").when(F.col("c_custkey") % 3 == 1, "mfd2_").otherwise("x_"), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.pretty_feature(n).alias("name"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE trim(regexp_extract(substr(t, 1, 115), '^(.*?)(?:\s+\S*)?$', 1) || ' [...]') END AS snippet FROM t""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words up to 120 characters (the cut is the feature)."""
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query("""WITH g AS (SELECT p_type AS feature, count(*) FILTER (p_size <= 25) AS a, count(*) FILTER (p_size > 25) AS b, avg(p_retailprice) FILTER (p_size <= 25) - avg(p_retailprice) FILTER (p_size > 25) AS d FROM part GROUP BY 1)
SELECT feature, round(d, 6) AS d FROM g WHERE d IS NOT NULL ORDER BY abs(d) DESC, feature LIMIT 20""")
def largest_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest absolute effects."""
    small = F.col("p_size") <= 25
    each = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("feature")).agg((F.avg(F.when(small, F.col("p_retailprice"))) - F.avg(F.when(~small, F.col("p_retailprice")))).alias("d"))
    return X.top_effects(each.filter("d IS NOT NULL"), 20, "d").select("feature", F.round("d", 6).alias("d"))
