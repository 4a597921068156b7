"""The register of queries, and what their DuckDB SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its DuckDB SQL if there is any."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Common table expressions that mirror the views in `argosift.schemas`.
POSTS = """posts AS (SELECT doc_id AS row_index, CAST(doc_id AS VARCHAR) AS cid, text, lang, source, CASE WHEN try_cast(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'Meta' ELSE 'Bluesky' END AS platform FROM documents)"""
STANCES = """stances AS (SELECT doc_id AS row_index, CAST(doc_id AS VARCHAR) AS cid, CASE WHEN toxic = 1 THEN 'Pro-Energy' WHEN quality = 1 THEN 'Pro-Climate' WHEN quality = 0 THEN 'Neutral' END AS stance FROM labels)"""
STANCE_POSTS = f"""{POSTS}, {STANCES}, stance_posts AS (SELECT p.*, s.stance FROM posts p LEFT JOIN stances s USING (cid))"""
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
#: A letter, digit or underscore of any script.
W = r"[\p{L}\p{N}_]"


def clean_sql(text: str) -> str:
    """DuckDB SQL of `clean_post`."""
    from ..functions.text import EMOJI, PROMO, URL_DOMAINS

    out = f"lower(coalesce({text}, ''))"
    steps = [rf"https?://[^\s]+|www\.[^\s]+|{W}+\.(?:{'|'.join(URL_DOMAINS)})[^\s]*", f"@{W}+", f"#{W}+", EMOJI, *PROMO]
    for p in steps:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"
