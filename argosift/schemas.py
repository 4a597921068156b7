"""Schemas of the domain's relations, column checks, and views of the test tables as those relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "posts": "row_index long, cid string, text string",
    "clean_posts": "cid string, text string, clean_text string, text_len int",
    "claim_flags": "row_id long, cid string, text string, claim string, confidence int, evidence string, reason string, error string",
    "stance_lookup": "cid string, stance string",
    "claims_clustered": "cid string, text string, claim string, stance string, cluster_id string, cluster_prob double",
    "cluster_claims": "segment string, cluster_id string, cluster_claim string, num_texts int, error string, model_used string",
    "merge_map": "segment string, cluster_id string, merged_id int, cluster_claim string",
    "coherency": "segment string, cluster_id string, verdict string, num_texts int, error string",
    "assignments": "cid string, text string, assigned_cluster_id string, assigned_claim string, assigned_claim_segment string, assign_reason string, llm_label string, match_status string",
    "toulmin": "claim string, ground string, warrant string",
    "topics": "cluster_claim string, segment string, platform string, topic_cluster int, topic_label string",
    "messages": "messages array<struct<role:string,content:string>>",
}

#: Names under which other producers write a column.
RENAMES = {"Stance": "stance", "ad_archive_id": "cid", "ad_creative_bodies": "text", "predicted_label": "stance"}


class MissingColumns(ValueError):
    """A relation lacks columns that it must have."""


def require_cols(df: DataFrame, columns: list[str], name: str = "input") -> DataFrame:
    """`df`, if it has all `columns`; raises on the driver before any job otherwise."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise MissingColumns(f"{name} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def unify(df: DataFrame, renames: dict[str, str] = RENAMES) -> DataFrame:
    """Columns under their canonical names; a rename is left out where the canonical name is taken."""
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})


def with_columns_of(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with the columns it lacks, each with its default."""
    return df.withColumns({c: v for c, v in columns.items() if c not in df.columns})


# Views of the test tables.


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def platform() -> Column:
    """Meta for sources with an even number, Bluesky for odd ones."""
    return F.when(F.try_to_number(F.substring("source", 4, 9), F.lit("999999999")).cast("int") % 2 == 0, "Meta").otherwise("Bluesky")


def segment(quality: Column, toxic: Column) -> Column:
    """A stance by the labels; null without labels."""
    return F.when(toxic == 1, "Pro-Energy").when(quality == 1, "Pro-Climate").when(quality == 0, "Neutral")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts: row_index, cid, text, lang, source, platform."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("cid"), "text", "lang", "source", platform().alias("platform"))


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a stance lookup: row_index, cid, stance."""
    return _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("cid"), segment(F.col("quality"), F.col("toxic")).alias("stance"))


def stance_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts with their stance, null where unlabelled."""
    return posts(spark, sf_dir).join(stances(spark, sf_dir).drop("row_index"), "cid", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as clustered claims: id, vector, label."""
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
