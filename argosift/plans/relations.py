"""Queries of recurring relational shapes: lookups, semi and anti joins, ranks, pivots, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import models as M
from ..operators import relational as R
from .registry import POSTS, STANCE_POSTS, STANCES, query, table

_LABEL_LOOKUPS = "toxic AS (SELECT CAST(doc_id AS VARCHAR) AS cid, 'Pro-Energy' AS stance FROM labels WHERE toxic = 1), good AS (SELECT CAST(doc_id AS VARCHAR) AS cid, 'Pro-Climate' AS stance FROM labels WHERE quality = 1), rest AS (SELECT CAST(doc_id AS VARCHAR) AS cid, 'Neutral' AS stance FROM labels)"


@query(f"WITH {POSTS}, {_LABEL_LOOKUPS} SELECT p.cid, coalesce(t.stance, g.stance, r.stance) AS stance FROM posts p LEFT JOIN toxic t USING (cid) LEFT JOIN good g USING (cid) LEFT JOIN rest r USING (cid)")
def priority_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stance from the first of three lookups that has the post."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("cid"), F.col("doc_id").alias("row_index"), "quality", "toxic")
    named = [labels.filter(cond).withColumn("stance", F.lit(stance)) for cond, stance in (("toxic = 1", "Pro-Energy"), ("quality = 1", "Pro-Climate"), ("true", "Neutral"))]
    lookups = [R.lookup(x, "cid", "stance") for x in named]
    return R.attach_by_priority(schemas.posts(spark, sf_dir).select("cid"), lookups, "cid", "stance")


_COHERENT = "coherent AS (SELECT DISTINCT label FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) WHERE n >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)))"


def coherent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with no fewer members than the mean."""
    sizes = schemas.vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.avg("n").alias("mean")))).filter("n >= mean").select("label")  # one row


@query(f"WITH {_COHERENT} SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM coherent)")
def coherent_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of coherent clusters."""
    return R.semi(schemas.vectors(spark, sf_dir).select("id", "label"), coherent_labels(spark, sf_dir).distinct(), ["label"])


@query(f"WITH {_COHERENT} SELECT vec_id AS id, label IN (SELECT label FROM coherent) AS kept FROM embeddings")
def kept_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept and the removed, which together are all."""
    rows, keep = schemas.vectors(spark, sf_dir).select("id", "label"), coherent_labels(spark, sf_dir)
    return R.semi(rows, keep, ["label"]).select("id", F.lit(True).alias("kept")).unionByName(R.anti(rows, keep, ["label"]).select("id", F.lit(False).alias("kept")))


@query(f"WITH {POSTS}, {STANCES} SELECT cid, text FROM posts WHERE cid NOT IN (SELECT cid FROM stances WHERE cid IS NOT NULL)")
def train_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts outside the training set, or not done yet."""
    return R.anti(schemas.posts(spark, sf_dir).select("cid", "text"), schemas.stances(spark, sf_dir), ["cid"])


_VECTOR_PROB = "v AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS prob FROM embeddings)"


def ranked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered claims with a membership score, for which the first coordinate stands."""
    return schemas.vectors(spark, sf_dir).select("id", "label", F.get("vector", F.lit(0)).cast("double").alias("prob"))


@query(f"WITH {_VECTOR_PROB}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY prob DESC, id) AS topk_rank FROM v) SELECT id, label, topk_rank::INTEGER AS topk_rank FROM r WHERE topk_rank <= 5")
def topk_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five members of each cluster with the highest score."""
    return R.top_k(ranked_vectors(spark, sf_dir), ["label"], 5, F.col("prob").desc(), "id").select("id", "label", "topk_rank")


@query(f"""WITH {_VECTOR_PROB}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY prob DESC, id) AS k FROM v)
SELECT label, string_agg('Text ' || k || ': ' || id, chr(10) ORDER BY k) AS prompt FROM r WHERE k <= 5 GROUP BY label""")
def cluster_text_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top texts of a cluster as numbered lines."""
    named = ranked_vectors(spark, sf_dir).withColumn("text", F.col("id").cast("string"))
    top = R.top_texts(R.top_k(named, ["label"], 5, F.col("prob").desc(), "id"), ["label"])
    return top.select("label", T.numbered(F.filter("texts", lambda t: t != ""), "Text {i}: {x}").alias("prompt"))


@query(f"""WITH {STANCE_POSTS}, s AS (SELECT platform, coalesce(stance, '-1') AS cluster_id, count(*) AS size FROM stance_posts GROUP BY ALL)
SELECT platform, sum(size)::BIGINT AS n_total, coalesce(sum(size) FILTER (cluster_id = '-1'), 0)::BIGINT AS n_outliers, round(coalesce(sum(size) FILTER (cluster_id = '-1'), 0) / sum(size), 9) AS pct_outliers,
count(*) FILTER (cluster_id <> '-1') AS n_clusters, coalesce(max(size) FILTER (cluster_id <> '-1'), 0)::BIGINT AS largest_cluster, coalesce(median(size) FILTER (cluster_id <> '-1'), 0)::DOUBLE AS median_cluster_size FROM s GROUP BY platform""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers and cluster sizes by group."""
    rows = schemas.stance_posts(spark, sf_dir).withColumn("cluster_id", F.coalesce("stance", F.lit("-1")))
    return R.cluster_stats(rows, "platform").withColumn("pct_outliers", F.round("pct_outliers", 9))


@query()
def cluster_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters as one JSON document."""
    rows = ranked_vectors(spark, sf_dir).select(F.col("label").alias("cluster_id"), F.col("prob").alias("membership_prob"), F.col("id").alias("row_index"), F.col("id").cast("string").alias("claim"))
    return R.cluster_document(rows)


@query(f"""WITH {POSTS}, c AS (SELECT coalesce(lang, 'none') AS topic, count(*) FILTER (platform = 'Bluesky') AS b, count(*) FILTER (platform = 'Meta') AS m FROM posts WHERE lang IS NOT NULL GROUP BY topic), t AS (SELECT sum(b) AS tb, sum(m) AS tm FROM c)
SELECT topic, b AS Bluesky_n, m AS Meta_n, round_even(100 * b / tb, 1) AS Bluesky_pct, round_even(100 * m / tm, 1) AS Meta_pct, round_even(100 * b / tb - 100 * m / tm, 1) AS pct_diff FROM c, t""")
def topic_platform_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by platform, counts and shares."""
    topics = schemas.posts(spark, sf_dir).withColumn("topic", F.coalesce("lang", F.lit("Uncategorized"))).filter("topic <> 'Uncategorized'")
    return R.pivot_shares(topics, "topic", "platform", ["Bluesky", "Meta"])


@query(f"WITH {STANCE_POSTS} SELECT coalesce(lang, 'none') AS topic, platform, coalesce(stance, 'none') AS segment, count(*) AS n FROM stance_posts GROUP BY ALL")
def segment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: rows by topic, platform and segment."""
    named = schemas.stance_posts(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("topic"), "platform", F.coalesce("stance", F.lit("none")).alias("segment"))
    return named.groupBy("topic", "platform", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id")
def join_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a key in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("row_index"), F.coalesce("text", F.lit("")).alias("text"))
    return R.join_texts(turns, "conv_id")


@query(f"""WITH {POSTS}, {STANCES}, a AS (SELECT cid, stance FROM stances WHERE stance <> 'Neutral') SELECT p.cid, a.stance AS first_stance, b.stance AS second_stance FROM posts p LEFT JOIN a USING (cid) LEFT JOIN stances b USING (cid)""")
def combine_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side."""
    runs = schemas.stances(spark, sf_dir).select("cid", "stance")
    return R.side_by_side(schemas.posts(spark, sf_dir).select("cid"), {"first": runs.filter("stance <> 'Neutral'"), "second": runs})


_SEGMENTS = "claims AS (SELECT * FROM (VALUES ('a', 'Pro-Energy', '**\"one\"**'), ('b', ' pro-energy', 'two'), ('c', 'Pro-Climate', 'three')) t(cluster_id, segment, cluster_claim))"


@query(f"""WITH {STANCE_POSTS}, {_SEGMENTS}, n AS (SELECT lower(trim(segment)) AS seg, cluster_id, trim(cluster_claim, '*"') AS cluster_claim, row_number() OVER (PARTITION BY lower(trim(segment)) ORDER BY cluster_id) AS ordinal FROM claims)
SELECT p.cid, n.cluster_id, n.cluster_claim, n.ordinal::VARCHAR AS ordinal, CASE WHEN n.seg IS NULL THEN 'no_claims_for_segment' END AS assign_reason FROM stance_posts p LEFT JOIN n ON lower(trim(coalesce(p.stance, ''))) = n.seg""")
def segment_restricted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post with the numbered claims of its segment, or the reason why there are none."""
    claims = spark.createDataFrame([("a", "Pro-Energy", '**"one"**'), ("b", " pro-energy", "two"), ("c", "Pro-Climate", "three")], "cluster_id string, segment string, cluster_claim string")
    some, none = R.segment_candidates(schemas.stance_posts(spark, sf_dir).select("cid", F.col("stance").alias("segment")), claims)
    both = R.union_tagged({"some": some, "none": none}, "which")
    return both.select("cid", "cluster_id", "cluster_claim", F.col("ordinal").cast("string").alias("ordinal"), "assign_reason")


@query("SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch FROM documents")
def microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of twenty rows in order."""
    return R.batches(table(spark, sf_dir, "documents").select("doc_id", "text"), 20, "doc_id").select("doc_id", "text", F.col("batch").cast("long").alias("batch"))


@query(f"""WITH {POSTS}, {STANCES} SELECT p.row_index, coalesce(s.stance, p.lang) AS lang FROM posts p LEFT JOIN stances s USING (row_index)""")
def merge_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processed slice back in its place."""
    done = schemas.stances(spark, sf_dir).select("row_index", F.col("stance").alias("lang"))
    return R.merge_back(schemas.posts(spark, sf_dir).select("row_index", "lang"), done, ["lang"]).select("row_index", "lang")


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of a conversation wins."""
    return R.keep_last(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "text")


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows without replacement, the same each time. (No SQL: Spark's hash.)"""
    return R.sample_n(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, "doc_id")


@query(f"WITH {POSTS} SELECT 'all' AS part, cid FROM posts UNION ALL SELECT 'english' AS part, cid FROM posts WHERE lang = 'en'")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames under their names."""
    posts = schemas.posts(spark, sf_dir).select("cid", "lang")
    return R.union_tagged({"all": posts.drop("lang"), "english": posts.filter("lang = 'en'").drop("lang")}, "part")


@query("""SELECT conv_id, turn, 'system|Answer in one line.|user|' || coalesce(text, '') || '|assistant|' || coalesce(role, '') AS messages FROM conversations""")
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples as messages."""
    messages = M.sft_messages("Answer in one line.", F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("")))
    flat = F.array_join(F.flatten(F.transform(messages, lambda m: F.array(m["role"], m["content"]))), "|")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", flat.alias("messages"))


@query(f"""WITH {STANCE_POSTS}, g AS (SELECT stance, platform, min_by(cid, cid) AS cid, count(*) AS n FROM stance_posts WHERE stance IS NOT NULL GROUP BY ALL) SELECT * FROM g""")
def group_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the least id, as a string, stands for its group."""
    from ..operators.cluster import representatives

    posts = schemas.stance_posts(spark, sf_dir).filter("stance IS NOT NULL").select("stance", "platform", "cid")
    sizes = posts.groupBy("stance", "platform").agg(F.count(F.lit(1)).alias("n"))
    return representatives(posts, ["stance", "platform"], "cid").join(sizes, ["stance", "platform"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest groups."""
    return R.value_counts(table(spark, sf_dir, "events"), "event_type", nulls=True).orderBy(F.col("n").desc(), "event_type").limit(3)


@query("""WITH s AS (SELECT try_cast(source_id AS DOUBLE) AS num, source FROM (SELECT DISTINCT source, substr(source, 4) AS source_id FROM documents)) SELECT source, num, row_number() OVER (ORDER BY num ASC NULLS LAST, source)::INTEGER AS place FROM s""")
def numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names ordered by the number in them, those without one last."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "documents").select("source").distinct().withColumn("num", F.substring("source", 4, 9).try_cast("double"))
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.col("num").asc_nulls_last(), "source")))  # a row a source


@query("SELECT doc_id FROM documents WHERE lower(trim(coalesce(lang, ''))) <> 'de' AND trim(coalesce(source, '')) <> ''")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows without an error and without the word for nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("error", F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "no source"))
    return R.drop_absent(R.drop_errors(docs), "lang", "DE").select("doc_id")


@query("WITH s AS (SELECT label FROM embeddings WHERE label <> 0 GROUP BY label HAVING count(*) >= 50), r AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS k FROM embeddings WHERE label IN (SELECT label FROM s)) SELECT id, label FROM r WHERE k <= 7")
def picked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven first members of every cluster that is large enough; cluster 0 stands for noise."""
    large = R.drop_small(ranked_vectors(spark, sf_dir), "label", 50, noise=0)
    return R.pick_rows(large, ["label"], 7, F.col("prob").desc(), "id").select("id", "label")


@query()
def sampled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded choice of seven members of each cluster. (No SQL: Spark's hash.)"""
    return R.pick_rows(ranked_vectors(spark, sf_dir), ["label"], 7, key="id").select("id", "label")


@query("SELECT source, count(n_chars) AS n_chars FROM documents GROUP BY source")
def available_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """only metrics that have values are counted; missing columns count as empty."""
    docs = schemas.with_columns_of(table(spark, sf_dir, "documents"), {"fluency": F.lit(None).cast("double")})
    return docs.groupBy("source").agg(*[F.count(m).alias(m) for m in R.available(docs, ["n_chars", "fluency", "absent"])])
