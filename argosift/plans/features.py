"""Queries over lexicon features and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import lexicon as L
from ..operators import relational as R
from ..operators import stats as X
from .registry import POSTS, STANCE_POSTS, TOKENS, W, query, table

#: A small emotion lexicon over words of the test tables.
EMOTIONS = {"anger": ["idiot", "moron", "scum", "stupid", "trash"], "disgust": ["disgusting", "pathetic", "trash", "worthless"], "trust": ["and", "the", "with"]}


def _rounded(columns: dict) -> list:
    return [F.round(c.cast("double"), 9).alias(k) for k, c in columns.items()]


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_N = "greatest(len(k), 1)"
_TOKENS_CTE = f"t AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS x, {TOKENS} AS k FROM documents)"
_REGISTER = {
    "avg_word_len": "CASE WHEN len(k) > 0 THEN list_sum(list_transform(k, lambda w: length(w))) / len(k) ELSE 0 END", "ttr": f"len(list_distinct(k)) / {_N}", "n_words": _N,
    "modal_rate": f"len(list_filter(k, lambda w: w IN {_in(L.MODALS)})) / {_N} * 100", "imperative_rate": f"len(list_filter(k, lambda w: w IN {_in(L.CALLS)})) / {_N} * 100",
    "question_rate": f"(length(x) - length(replace(x, '?', ''))) / {_N} * 100", "exclaim_rate": f"(length(x) - length(replace(x, '!', ''))) / {_N} * 100",
    "hashtag_rate": f"len(regexp_extract_all(x, '#{W}+')) / {_N} * 100", "mention_rate": f"len(regexp_extract_all(x, '@{W}+')) / {_N} * 100", "has_url": "CASE WHEN regexp_matches(x, 'https?://') THEN 1 ELSE 0 END",
}


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tokenised(table(spark, sf_dir, "documents").select("doc_id", "text"), types=EMOTIONS)


def _select(columns: dict[str, str], more: str = "doc_id") -> str:
    return f"SELECT {more}, " + ", ".join(f"round(({v})::DOUBLE, 9) AS \"{k}\"" for k, v in columns.items())


@query(f"WITH {_TOKENS_CTE} {_select(_REGISTER)} FROM t")
def register_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word length, variety, modal and call words, marks, tags, urls."""
    return _tokenised(spark, sf_dir).select("doc_id", *_rounded(L.register_features("text", F.col("__made"))))


@query(f"WITH {_TOKENS_CTE} " + _select({
    "fk_grade": f"0.39 * (len(k) / greatest(len(regexp_extract_all(x, '[.!?]+(?:\\s|$)')), 1)) + 11.8 * (coalesce(list_sum(list_transform(k, lambda w: greatest(1, len(regexp_extract_all(regexp_replace(w, 'e$', ''), '[aeiouy]+'))))), 0) / {_N}) - 15.59",
    "flesch_ease": f"206.835 - 1.015 * (len(k) / greatest(len(regexp_extract_all(x, '[.!?]+(?:\\s|$)')), 1)) - 84.6 * (coalesce(list_sum(list_transform(k, lambda w: greatest(1, len(regexp_extract_all(regexp_replace(w, 'e$', ''), '[aeiouy]+'))))), 0) / {_N})",
}) + " FROM t")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate readability."""
    return _tokenised(spark, sf_dir).select("doc_id", *_rounded(L.readability("text", F.col("__made"))))


def _pattern_sql(words: list[str]) -> str:
    exact, stems = [w for w in words if not w.endswith("*")], [w[:-1] for w in words if w.endswith("*")]
    tests = [f"w IN {_in(exact)}"] * bool(exact) + [f"starts_with(w, '{s}')" for s in stems]
    return f"len(list_filter(k, lambda w: {' OR '.join(tests)})) / {_N} * 100"


@query(f"WITH {_TOKENS_CTE} {_select({'mfd2_' + k: _pattern_sql(v) for k, v in L.MORAL_FOUNDATIONS.items()})} FROM t")
def mfd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2, L4: token rates of the moral foundations."""
    return _tokenised(spark, sf_dir).select("doc_id", *_rounded(L.token_rates("text", made=F.col("__made"))))


@query(f"WITH {_TOKENS_CTE} " + _select({"nrc_" + k: f"len(list_filter(list_distinct(k), lambda w: w IN {_in(v)})) / {_N} * 100" for k, v in EMOTIONS.items()}) + " FROM t")
def nrc_style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: rates of distinct lexicon words."""
    return _tokenised(spark, sf_dir).select("doc_id", *_rounded(L.type_rates("text", EMOTIONS, made=F.col("__made"))))


@query("WITH p AS (SELECT unnest(['idiot', 'moron', 'scum', 'trash', 'trash', 'worthless']) AS word, unnest(['anger', 'anger', 'anger', 'anger', 'disgust', 'disgust']) AS category) SELECT category, string_agg(word, ',' ORDER BY word) AS words FROM p GROUP BY category")
def inverted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: words to categories, turned into categories to words."""
    rows = [("idiot", "anger"), ("moron", "anger"), ("scum", "anger"), ("trash", "anger"), ("trash", "disgust"), ("worthless", "disgust")]
    return L.invert(spark.createDataFrame(rows, "word string, category string")).select("category", F.array_join("words", ",").alias("words"))


@query(rf"""SELECT item_id, CASE WHEN len(list_intersect(regexp_extract_all(lower(coalesce(text, '')), '{W}+'), [{', '.join(repr(w) for w in L.PRONOUNS + L.DEICTIC)}])) > 0 THEN 0 ELSE 1 END::INTEGER AS alone FROM benchmark""")
def decontext_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a claim stands alone."""
    return table(spark, sf_dir, "benchmark").select("item_id", L.stands_alone("text").alias("alone"))


_POS, _NEG = ([w for w, v in L.VALENCE.items() if (v > 0) == up] for up in (True, False))
_PN = f"len(list_filter(k, lambda w: w IN {_in(_POS)}))", f"len(list_filter(k, lambda w: w IN {_in(_NEG)}))"


@query(f"WITH {_TOKENS_CTE}, c AS (SELECT doc_id, k, {_PN[0]} AS p, {_PN[1]} AS n, ({_PN[0]} - {_PN[1]}) * 0.6 * 4 AS raw FROM t) " + _select({"vader_compound": "raw / sqrt(raw * raw + 15)", "vader_pos": f"p / {_N}", "vader_neg": f"n / {_N}", "vader_neu": f"(len(k) - p - n) / {_N}"}) + " FROM c")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in valence scores."""
    return _tokenised(spark, sf_dir).select("doc_id", *_rounded(L.polarity("text", made=F.col("__made"))))


@query(rf"WITH {_TOKENS_CTE} " + _select({"ner_money": rf"len(regexp_extract_all(x, '[$€£]\s?[0-9][0-9.,]*')) / {_N} * 100", "ner_percent": rf"len(regexp_extract_all(x, '[0-9]+(?:\.[0-9]+)?\s?%')) / {_N} * 100", "ner_date": rf"len(regexp_extract_all(x, '\b(?:19|20)[0-9]{{2}}\b')) / {_N} * 100"}, "doc_id, " + ", ".join(f"NULL::DOUBLE AS ner_{k}" for k in ("org", "person", "gpe", "loc", "law"))) + " FROM t")
def entity_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern entities; labels that need a recogniser are null."""
    return _tokenised(spark, sf_dir).select("doc_id", *_rounded(L.entity_rates("text", F.col("__made"))))


@query("""WITH d AS (SELECT item_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS a FROM benchmark)
SELECT x.item_id AS item_id, CASE WHEN len(y.a) > 0 THEN round(2 * len(list_intersect(x.a, y.a)) / greatest(len(x.a) + len(y.a), 1), 9) END AS faithfulness_f1 FROM d x LEFT JOIN d y ON x.item_id + 1 = y.item_id""")
def faithfulness_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of a claim with its source, here the next item; null without one."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    source = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("source"))
    return items.join(source, "item_id", "left").select("item_id", F.round(L.overlap_f1("text", "source"), 9).alias("faithfulness_f1"))


# Statistics over features.


def _every() -> dict[str, Column]:
    """Every feature of a text, dots in the names as underscores; entity labels that need a recogniser are null."""
    return {k.replace(".", "_"): c for k, c in (L.all_features("text", F.col("__made")) | L.type_rates("text", EMOTIONS, made=F.col("__made"))).items()}


def platform_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of every post, with its platform."""
    return L.tokenised(schemas.posts(spark, sf_dir), types=EMOTIONS).select("platform", *[c.alias(k) for k, c in _every().items()])


FEATURES = ["avg_word_len", "ttr", "n_words", "modal_rate", "exclaim_rate", "question_rate"]
_SIDES = ", ".join(f"count(v) FILTER (platform = '{p}') AS n{i}, avg(v) FILTER (platform = '{p}') AS m{i}, var_samp(v) FILTER (platform = '{p}') AS v{i}" for i, p in ((1, "Meta"), (2, "Bluesky")))
_LONG = " UNION ALL ".join(f"SELECT platform, '{f}' AS feature, ({_REGISTER[f]})::DOUBLE AS v FROM p" for f in FEATURES)


@query(f"""WITH {POSTS}, p AS (SELECT platform, coalesce(text, '') AS x, {TOKENS} AS k FROM posts), l AS ({_LONG}), s AS (SELECT feature, {_SIDES} FROM l GROUP BY feature),
c AS (SELECT *, v1 / n1 AS a, v2 / n2 AS b, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS pooled FROM s WHERE n1 >= 5 AND n2 >= 5)
SELECT feature, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, CASE WHEN a + b > 0 THEN round((m1 - m2) / sqrt(a + b), 6) END AS t,
CASE WHEN a + b > 0 THEN round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 3) END AS df, CASE WHEN pooled = 0 THEN 0 ELSE round((m1 - m2) / pooled, 6) END AS cohens_d FROM c""")
def platform_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's t and Cohen's d of each feature between platforms."""
    out = X.compare_groups(platform_features(spark, sf_dir), "platform", "Meta", "Bluesky", FEATURES, p_values=False)
    return out.select("feature", "n1", "n2", *[F.round(c, 3 if c == "df" else 6).alias(c) for c in ("mean1", "mean2", "t", "df", "cohens_d")])


@query()
def platform_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p, its Bonferroni correction and stars; strongest effects first. (No SQL: Student's t.)"""
    every = list(_every())
    return X.top_effects(X.compare_groups(platform_features(spark, sf_dir), "platform", "Meta", "Bluesky", every), len(every))


@query(f"""WITH {POSTS}, p AS (SELECT platform, coalesce(text, '') AS x, {TOKENS} AS k FROM posts), m AS (SELECT avg({_REGISTER['ttr']}) FILTER (platform = 'Meta') AS a, avg({_REGISTER['ttr']}) FILTER (platform = 'Bluesky') AS b FROM p)
SELECT round(CASE WHEN a = b THEN 0 ELSE (a - least(a, b)) / abs(a - b) END, 9) AS meta, round(CASE WHEN a = b THEN 0 ELSE (b - least(a, b)) / abs(a - b) END, 9) AS bluesky FROM m""")
def radar_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature's two platform means scaled by their own range."""
    side = lambda p: F.avg(F.when(F.col("platform") == p, F.col("ttr")))
    means = platform_features(spark, sf_dir).agg(side("Meta").alias("a"), side("Bluesky").alias("b"))
    a, b = X.min_max_pair(F.col("a"), F.col("b"))
    return means.select(F.round(a, 9).alias("meta"), F.round(b, 9).alias("bluesky"))


@query(f"""WITH {STANCE_POSTS}, p AS (SELECT stance, coalesce(text, '') AS x, {TOKENS} AS k FROM stance_posts WHERE stance IS NOT NULL), m AS (SELECT stance, avg({_REGISTER['ttr']}) AS ttr, avg({_REGISTER['exclaim_rate']}) AS exclaim_rate FROM p GROUP BY stance)
SELECT stance, round((ttr - avg(ttr) OVER ()) / coalesce(nullif(stddev_samp(ttr) OVER (), 0), 1), 6) AS ttr, round((exclaim_rate - avg(exclaim_rate) OVER ()) / coalesce(nullif(stddev_samp(exclaim_rate) OVER (), 0), 1), 6) AS exclaim_rate FROM m""")
def stance_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance means as z-scores over the stances."""
    found = L.register_features("text")
    posts = schemas.stance_posts(spark, sf_dir).filter("stance IS NOT NULL").select("stance", found["ttr"].alias("ttr"), found["exclaim_rate"].alias("exclaim_rate"))
    return X.z_heat_map(posts, "stance", ["ttr", "exclaim_rate"]).select("stance", F.round("ttr", 6).alias("ttr"), F.round("exclaim_rate", 6).alias("exclaim_rate"))


@query("""WITH g AS (SELECT CASE WHEN grouping(source) = 1 THEN 'Overall' ELSE source END AS source, count(*) AS n, avg(n_chars) AS m, stddev_samp(n_chars) AS s, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY GROUPING SETS ((source), ()))
SELECT source, n, round(m, 4) AS n_chars_mean, round(s, 4) AS n_chars_std, round(lo::DOUBLE, 4) AS n_chars_min, round(hi::DOUBLE, 4) AS n_chars_max FROM g""")
def segment_stats_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, least and greatest by segment and overall."""
    return R.describe_with_overall(table(spark, sf_dir, "documents"), "source", ["n_chars"])


@query("SELECT source, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) * 100, 6) AS english, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END) * 100, 6) AS long FROM documents GROUP BY source")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates in percent by segment."""
    flags = table(spark, sf_dir, "documents").select("source", (F.coalesce(F.col("lang"), F.lit("")) == "en").cast("int").alias("english"), (F.coalesce(F.col("n_chars"), F.lit(0)) > 1000).cast("int").alias("long"))
    out = X.pass_rates(flags, "source", ["english", "long"])
    return out.select("source", F.round("english", 6).alias("english"), F.round("long", 6).alias("long"))


@query("""WITH g AS (SELECT source, count(n_chars) AS n, quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10)
SELECT source, n, q[1]::DOUBLE AS q1, q[2]::DOUBLE AS median, q[3]::DOUBLE AS q3 FROM g""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the ten largest themes."""
    return X.quartiles(table(spark, sf_dir, "documents"), "source", "n_chars")
