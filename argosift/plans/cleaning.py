"""Queries over posts: cleaning, filters, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import relational as R
from .registry import POSTS, STANCES, TOKENS, W, clean_sql, query, table

#: Words that occur in the test tables, in the place of a topic's blocklist.
BLOCKLIST = ["worthless", "clown", "in the", "***"]
_BLOCKED_SQL = rf"regexp_matches(coalesce(text, ''), '(?i)(^|[^\p{{L}}\p{{N}}_])(worthless|clown|in the)($|[^\p{{L}}\p{{N}}_])|\*\*\*')"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with clean_text and text_len."""
    return schemas.posts(spark, sf_dir).withColumn("clean_text", T.clean_post("text")).withColumn("text_len", F.length("clean_text"))


@query(f"WITH {POSTS}, c AS (SELECT cid, {clean_sql('text')} AS clean_text FROM posts WHERE lang = 'en') SELECT cid, clean_text, length(clean_text)::INTEGER AS text_len FROM c WHERE length(clean_text) >= 10")
def clean_text_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned English posts of ten characters and more."""
    return cleaned(spark, sf_dir).filter("lang = 'en' AND text_len >= 10").select("cid", "clean_text", "text_len")


@query(f"""WITH {POSTS}, c AS (SELECT source, coalesce(lang = 'en' AND length({clean_sql('text')}) >= 10 AND NOT {_BLOCKED_SQL}, false) AS kept FROM posts)
SELECT source, count(*) AS "before", count(*) FILTER (kept) AS "after", count(*) FILTER (NOT kept) AS removed, round(count(*) FILTER (NOT kept) * 100.0 / count(*), 2) AS removal_rate FROM c GROUP BY source""")
def removal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts before and after all filters, by source. The flagship query."""
    kept = (F.col("lang") == "en") & (F.col("text_len") >= 10) & ~T.blocked("text", BLOCKLIST)
    return R.removal_summary(cleaned(spark, sf_dir).select("source", F.coalesce(kept, F.lit(False)).alias("kept")), "source", F.col("kept"))


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(lang) FROM documents), 9) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: shares of languages among posts that have one."""
    return R.value_counts(table(spark, sf_dir, "documents"), "lang", normalize=True).withColumn("share", F.round("share", 9))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: posts a language, nulls counted."""
    return R.value_counts(table(spark, sf_dir, "documents"), "lang", nulls=True)


@query(f"WITH {POSTS} SELECT cid, {_BLOCKED_SQL} AS blocked FROM posts")
def keyword_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a post has a blocked keyword."""
    return schemas.posts(spark, sf_dir).select("cid", T.blocked("text", BLOCKLIST).alias("blocked"))


@query("""WITH x AS (SELECT n_chars::DOUBLE AS v FROM documents WHERE n_chars IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 50 AS w FROM x)
SELECT CASE WHEN w = 0 THEN 0 ELSE least(floor((v - lo) / w), 49) END::INTEGER AS bin, count(*) AS n FROM x, e GROUP BY bin""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths in 50 bins of equal width."""
    return R.histogram(table(spark, sf_dir, "documents"), "n_chars", 50)


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS one FROM documents)
SELECT doc_id, one AS collapsed, lower(one) AS label, CASE WHEN length(one) > 60 THEN substr(one, 1, 60) || ' …' ELSE one END AS truncated, regexp_replace(one, '[^A-Za-z0-9_\-]+', '_', 'g') AS safe FROM t""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed, as a label, truncated, and fit for a file name."""
    one = T.collapse("text")
    return table(spark, sf_dir, "documents").select("doc_id", one.alias("collapsed"), T.normalize_label("text").alias("label"), T.truncate("text", 60, collapsed=True).alias("truncated"), T.safe_name(one).alias("safe"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(ls[1], ''), '^(?i:claim)\s*:\s*', ''), '^[-•*\d).]+\s*', '')) AS t FROM l),
q AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')) AS t FROM f)
SELECT doc_id, CASE WHEN regexp_extract(t, '^(.+?[.!?])\s+.+$', 1) <> '' THEN trim(regexp_extract(t, '^(.+?[.!?])\s+.+$', 1)) ELSE t END AS sentence FROM q""")
def reply_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of a reply."""
    return table(spark, sf_dir, "documents").select("doc_id", T.one_sentence("text").alias("sentence"))


@query(rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://[^\s]+|www\.[^\s]+|{W}+\.(?:com|org|net|edu|gov|io|co|st|ly|ca|uk)[^\s]*', ' ', 'g'), '[^a-z0-9 \t\n\r]', ' ', 'g') AS a,
regexp_replace(lower(coalesce(text, '')), '[^a-z0-9s\\]', ' ', 'g') AS b FROM documents)
SELECT doc_id, trim(regexp_replace(a, '\s+', ' ', 'g')) AS intended, trim(regexp_replace(b, '\\s+', ' ', 'g'), ' ') AS as_run FROM c""")
def cluster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as it goes into clustering, as intended and as run."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_claim("text").alias("intended"), T.clean_claim("text", "as_run").alias("as_run"))


@query(rf"""SELECT doc_id, len({TOKENS})::INTEGER AS n_tokens, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')))::INTEGER AS exclaims, len(regexp_extract_all(coalesce(text, ''), '@{W}+'))::INTEGER AS mentions,
len(regexp_extract_all(coalesce(text, ''), '#{W}+'))::INTEGER AS hashtags, regexp_matches(coalesce(text, ''), 'https?://') AS has_url FROM documents""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, marks, tags and urls."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), T.count_char("text", "!").alias("exclaims"), T.count_tags("text", "@").alias("mentions"), T.count_tags("text", "#").alias("hashtags"), T.has_url("text").alias("has_url"))


@query("""SELECT a.item_id AS item_id, round(levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text), 1), 9) AS ratio
FROM (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM benchmark) a JOIN (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM benchmark) b ON a.item_id + 1 = b.item_id""")
def levenshtein_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of the whole text of each benchmark item to that of the next one, by the longer length.

    DuckDB's distance counts bytes, so on both sides a non-ASCII character is first made one mark; `levenshtein_whole` takes texts as they are.
    """
    t = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    after = t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after"))
    return t.join(after, "item_id").select("item_id", F.round(T.levenshtein_ratio("text", "after"), 9).alias("ratio"))


@query()
def levenshtein_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the characters of the texts as they are. (No SQL: DuckDB counts bytes.)"""
    t = table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after"))
    return t.join(after, "item_id").select("item_id", F.round(T.levenshtein_ratio("text", "after"), 9).alias("ratio"))


def _stop_sql() -> str:
    counts = [f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in own)}))) AS {lang}" for lang, own in sorted(T.STOP_WORDS.items())]
    return f"""WITH s AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM documents), c AS (SELECT doc_id, {', '.join(counts)} FROM s)
SELECT doc_id, CASE greatest(de, en, es, fr) WHEN 0 THEN NULL WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END AS detected FROM c"""


@query(_stop_sql())
def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by stop words, the offline default."""
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language("text").alias("detected"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 50 OFFSET 20")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset and a limit, in row order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").filter("doc_id IS NOT NULL")
    return R.slice_rows(docs, 20, 50, "doc_id")


@query("SELECT doc_id, lang IS NULL OR lower(trim(lang)) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '[]', '{}', '()', 'empty') AS nothing, coalesce(trim(source), '') AS source FROM documents")
def empty_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """empty-like fields, filled and trimmed strings."""
    return table(spark, sf_dir, "documents").select("doc_id", T.is_empty_like("lang").alias("nothing"), T.strip(F.coalesce("source", F.lit(""))).alias("source"))


@query(f"""WITH {POSTS}, {STANCES}, t AS (SELECT p.cid, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY p.row_index) AS r FROM posts p) SELECT cid FROM t WHERE r = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first post of each text. The text's digest is what moves."""
    keyed = schemas.posts(spark, sf_dir).select("cid", "row_index", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return keyed.groupBy("digest").agg(F.min_by("cid", "row_index").alias("cid")).select("cid")
