"""Queries over vectors, clusters and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import cluster as C
from ..operators import models as M
from ..operators import stance as S
from ..operators import vectors as V
from .registry import POSTS, query, table

_UNITS = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_MEANS = "s AS (SELECT label, i, sum(x) AS t, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY ALL), m AS (SELECT label, any_value(n) AS n, list(t / n ORDER BY i) AS c FROM s GROUP BY label)"
_UNIT_MEANS = f"{_MEANS}, c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM m)"
#: The similarities of these vectors are low; thresholds that give something to see.
NEAR, MERGE = 0.3, 0.18
GRID = [0.15, 0.2, 0.25, 0.3]


@query(f"WITH {_UNITS} SELECT x.label, x.id AS a, y.id AS b, round(list_inner_product(x.v, y.v), 6) AS sim FROM u x JOIN u y ON x.label = y.label AND x.id < y.id WHERE list_inner_product(x.v, y.v) >= {NEAR}")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a label that are similar enough."""
    return V.similar_pairs(schemas.vectors(spark, sf_dir), NEAR).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_UNITS}, {_UNIT_MEANS} SELECT label, round(unnest(c), 6) AS value, generate_subscripts(c, 1) - 1 AS place FROM c")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors by cluster, of length 1."""
    found = V.centroids(schemas.vectors(spark, sf_dir), ["label"])
    return found.select("label", F.posexplode("centroid").alias("place", "value")).select("label", F.round("value", 6).alias("value"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_UNITS}, {_MEANS}, p AS (SELECT u.id, u.label, u.label AS own, 0 AS k FROM u),
d AS (SELECT u.id, u.label, m.label AS other, CASE WHEN u.label = m.label THEN (m.n - m.n * list_inner_product(u.v, m.c)) / (m.n - 1) ELSE 1 - list_inner_product(u.v, m.c) END AS dist FROM u JOIN u AS x ON u.id = x.id CROSS JOIN m WHERE m.n > 1),
w AS (SELECT id, max(dist) FILTER (label = other) AS a, min(dist) FILTER (label <> other) AS b FROM d GROUP BY id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM w WHERE a IS NOT NULL""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: cosine silhouette by label, without forming pairs of points."""
    return V.silhouette(schemas.vectors(spark, sf_dir), ["label"]).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"""WITH {_UNITS}, {_MEANS}, g AS (SELECT u.label, avg(list_distance(u.v, m.c)) AS s, any_value(m.c) AS c FROM u JOIN m USING (label) GROUP BY u.label),
r AS (SELECT x.label, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM g x JOIN g y ON x.label <> y.label GROUP BY x.label) SELECT round(avg(r), 6) AS dbi FROM r""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Davies-Bouldin index by label."""
    return V.davies_bouldin(schemas.vectors(spark, sf_dir), ["label"]).select(F.round("dbi", 6).alias("dbi"))


@query(f"""WITH RECURSIVE {_UNITS}, {_UNIT_MEANS}, e AS (SELECT x.label AS a, y.label AS b FROM c x JOIN c y ON list_inner_product(x.c, y.c) >= {MERGE} OR x.label = y.label),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), roots AS (SELECT a AS label, min(b) AS root FROM reach GROUP BY a)
SELECT label, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS merged_label FROM roots""")
def centroid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose centroids are chained by similarity become one."""
    return V.centroid_merge(schemas.vectors(spark, sf_dir), MERGE)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.vectors(spark, sf_dir).select(F.col("label").alias("segment"), F.col("id").alias("row_index"), "vector")


_GREEDY = f"""{_UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS i FROM u),
n AS (SELECT x.label, x.i, list(y.i) FILTER (y.i < x.i AND list_inner_product(x.v, y.v) >= 0.2) AS near FROM o x JOIN o y ON x.label = y.label GROUP BY x.label, x.i),
walk AS (SELECT label, 1::BIGINT AS i, [1::BIGINT] AS seeds FROM n WHERE i = 1
UNION ALL SELECT n.label, n.i, CASE WHEN len(list_intersect(w.seeds, coalesce(n.near, []))) = 0 THEN list_append(w.seeds, n.i) ELSE w.seeds END FROM walk w JOIN n ON n.label = w.label AND n.i = w.i + 1)"""


@query(f"""WITH RECURSIVE {_GREEDY}, f AS (SELECT label, arg_max(seeds, i) AS seeds FROM walk GROUP BY label)
SELECT o.label AS segment, o.id AS row_index, (list_position(f.seeds, CASE WHEN list_contains(f.seeds, o.i) THEN o.i ELSE list_min(list_intersect(f.seeds, n.near)) END) - 1)::INTEGER AS merged_id FROM o JOIN n USING (label, i) JOIN f USING (label)""")
def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: seeds in row order, each with what is near."""
    return C.greedy_merge(_claims(spark, sf_dir), [0.2]).select("segment", "row_index", "merged_id")


@query()
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold of the grid judged and ranked. (No SQL: one recursive walk a threshold.)"""
    swept = C.threshold_sweep(_claims(spark, sf_dir), GRID)
    return swept.select("segment", "threshold", *[F.round(c, 6).alias(c) for c in ("silhouette", "dbi", "sil_norm", "dbi_norm", "score")], "n_groups", "n_singletons", "place")


#: A recorded sweep: threshold, silhouette, Davies-Bouldin index; groups and singletons don't enter the score.
_SWEEP = [(0.6, 0.5, 0.9), (0.62, 0.6, 0.7), (0.64, 0.6, 0.7), (0.66, None, None), (0.68, 0.2, 0.4)]
_SWEEP_SQL = ", ".join(f"({t}, {'NULL' if s is None else s}, {'NULL' if d is None else d})" for t, s, d in _SWEEP)


@query(f"""WITH t AS (SELECT * FROM (VALUES {_SWEEP_SQL}) x(threshold, silhouette, dbi)), n AS (SELECT threshold::DOUBLE AS threshold, silhouette::DOUBLE AS silhouette, (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) AS a, 1 - (dbi - min(dbi) OVER ()) / (max(dbi) OVER () - min(dbi) OVER ()) AS b FROM t)
SELECT threshold, round(coalesce(a, 0) + coalesce(b, 0), 6) AS score, (row_number() OVER (ORDER BY coalesce(a, 0) + coalesce(b, 0) DESC, silhouette DESC NULLS LAST, threshold))::INTEGER AS place FROM n""")
def sweep_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and order of a given sweep."""
    given = spark.createDataFrame([("all", *r) for r in _SWEEP], "segment string, threshold double, silhouette double, dbi double")
    return C.rank_sweep(given).select("threshold", F.round("score", 6).alias("score"), "place")


@query(f"WITH {POSTS}, c AS (SELECT lang, count(*) FILTER (platform = 'Meta') AS m, count(*) FILTER (platform = 'Bluesky') AS b FROM posts GROUP BY lang) SELECT lang, m AS meta_size, b AS blue_size, round(ln((m + 1) / (b + 1)), 9) AS log_ratio FROM c")
def log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log ratio of matched group sizes."""
    side = lambda p: F.count_if(F.col("platform") == p)
    sizes = schemas.posts(spark, sf_dir).groupBy("lang").agg(side("Meta").alias("meta_size"), side("Bluesky").alias("blue_size"))
    return sizes.select("lang", "meta_size", "blue_size", F.round(V.log_ratio("meta_size", "blue_size"), 9).alias("log_ratio"))


# Without SQL: iterative or model-backed.


@query()
def hdbscan_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: density clusters within each label; label -1 is noise. (No SQL: iterative.)"""
    return C.density_clusters(schemas.vectors(spark, sf_dir).withColumnRenamed("label", "segment"), "segment", least=5, samples=3)


@query()
def kmeans_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the form that scales: spherical k-means with small clusters as noise. (No SQL: iterative.)"""
    return C.kmeans_clusters(schemas.vectors(spark, sf_dir), 10)


@query()
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components of each vector. (No SQL: eigenvectors.)"""
    found = C.reduce_pca(schemas.vectors(spark, sf_dir), 2)
    return found.select("id", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))


@query()
def stance_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stances learned from labelled posts, predicted for all. (No SQL: a fitted model.)"""
    posts = schemas.stance_posts(spark, sf_dir).select("cid", "text", "stance")
    return S.predict_stance(S.fit_stance(posts), posts).drop("text")


def _flag(prompt: str) -> str:
    """What an offline model replies: a claim where the prompt has an exclamation mark behind `Post:`."""
    post = prompt.partition("Post:")[2]
    return '{"claim": "%s", "confidence": 90, "evidence": "", "reason": ""}' % ("claim" if "!" in post else "no claim")


@query("SELECT doc_id, CASE WHEN contains(substr(coalesce(text, ''), 1, 1200), '!') THEN 'Claim' ELSE 'No Claim' END AS claim, 90 AS confidence FROM documents")
def model_claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model call a post, with an offline model."""
    got = M.SPECS["claim_flag"].run(table(spark, sf_dir, "documents").select("doc_id", "text"), M.EchoClient(_flag))
    return got.select("doc_id", F.col("claim_flag.claim").alias("claim"), F.col("claim_flag.confidence").alias("confidence"))


def _relevant(prompt: str) -> str:
    return "\n".join("RELEVANT" if "!" in line or "?" in line else "IRRELEVANT" for line in prompt.splitlines()[1:])


@query("SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[!?]') THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS relevance FROM documents")
def model_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model call for twenty posts, their whole texts in the prompt; the offline model looks for marks of address."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("clean_text"))
    return M.relevance(rows, M.EchoClient(_relevant), order="doc_id")


def _choice(prompt: str) -> str:
    return "\n".join("2" if "@" in line else "1" if "!" in line else "none" for line in prompt.split("one a line.\n")[1].splitlines())


@query("""WITH c AS (SELECT doc_id, CASE WHEN contains(coalesce(text, ''), '@') THEN 'b' WHEN contains(coalesce(text, ''), '!') THEN 'a' END AS assigned_cluster_id FROM documents)
SELECT doc_id, assigned_cluster_id, CASE WHEN assigned_cluster_id IS NULL THEN 'llm_missing' ELSE 'llm_claim_assign' END AS assign_reason, CASE WHEN assigned_cluster_id IS NULL THEN 'non_matching' ELSE 'matched' END AS match_status FROM c""")
def model_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: claims assigned by number, ten whole posts a call, unreadable answers asked again."""
    claims = [{"cluster_id": "a", "cluster_claim": "One.", "segment": "s"}, {"cluster_id": "b", "cluster_claim": "Two.", "segment": "s"}]
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.assign(rows, claims, M.EchoClient(_choice), retries=1, order="doc_id").select("doc_id", "assigned_cluster_id", "assign_reason", "match_status")


@query()
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: embeddings of all documents by the offline embedder. (No SQL: hashed n-grams.)"""
    return M.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "vector")
