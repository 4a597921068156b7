"""Queries that take whole inputs, against brute force on small tables."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from argosift.functions import lexicon as L
from argosift.operators import stance as S
from argosift.plans import catalogue
from argosift.plans.features import EMOTIONS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_levenshtein_of_whole_texts(spark, tmp_path):
    """Differences past 300 characters, in case, digits, marks and letters of other scripts count."""
    long = "ab cd " * 60
    texts = [long + "x", long + "yz", "Item 1.", "item 2!", "été", "ete", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.ratio for r in catalogue.queries()["levenshtein_whole"](spark, str(tmp_path)).collect()}
    pairs = [(a or "", b or "") for a, b in zip(texts, texts[1:])]
    assert got == {i: pytest.approx(distance(a, b) / max(len(a), len(b), 1)) for i, (a, b) in enumerate(pairs)}
    assert got[0] > 0 and got[2] > 0 and got[4] > 0


def test_stance_terms_are_all_kept(spark):
    """More terms than 1 << 18, each in one of two texts: words, and pairs of words."""
    n = 100_000
    words = F.array_join(F.transform(F.sequence("low", F.col("low") + n - 1), lambda i: F.concat(F.lit("w"), i)), " ")
    df = spark.createDataFrame([(n,), (2 * n,)], "low long").select(words.alias("text"))
    fitted = Pipeline(stages=S.features(min_df=1)).fit(df)
    assert len(fitted.stages[-2].vocabulary) == 2 * n + 2 * (n - 1)


def test_every_feature_is_compared(spark, sf):
    """Each family of features is tested, and p is corrected by their number."""
    got = catalogue.queries()["platform_significance"](spark, sf).collect()
    names = {r.feature for r in got}
    assert {"ttr", "fk_grade", "vader_compound", "ner_money", "ner_percent", "ner_date"} <= names and any(n.startswith("mfd2_") for n in names) and any(n.startswith("nrc_") for n in names)
    assert all(r.p_bonferroni == pytest.approx(min(1, r.p * len(got))) for r in got if r.p is not None)


ODD = [
    None, "", " ", "a", "e", "The theme: able apple ye eye see e.", "Can't COULD would! should? Join us", "İstanbul Iİi Kelvin marK", "cafés naïve Ångström 日本 abc日def",
    "abc", "def", "Kind kindness unkind lawless law laws dirty dirtying", "idiot Idiot moron trash trash the and with the", "good bad best worst hopeful", "#tag ##x # y @me a@b @ é# #é",
    "costs $5, € 6.50 and £x; 5% of 7.5 % in 1999, 20201 and 2020", "http://x.y HTTPS://Z", "one.two. three!? four...\nfive.", "x\x00y\tz q. ", "\U0001f600 smile\U0001f600smile " * 9,
]


@pytest.mark.parametrize("block", [L.BLOCK, 16])
def test_counts_of_tokens_are_those_of_expressions(spark, monkeypatch, block):
    """Every feature from the counts made once a text is bit by bit what the expressions over its tokens give, however texts share blocks."""
    monkeypatch.setattr(L, "BLOCK", block)
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").coalesce(1)

    def features(df, made=None):
        found = L.all_features("text", made) | L.type_rates("text", EMOTIONS, made=made)
        return [tuple(r) for r in df.select("id", *[c.alias(k.replace(".", "_")) for k, c in found.items()]).orderBy("id").collect()]

    assert features(L.tokenised(df, types=EMOTIONS), F.col("__made")) == features(df)


def test_significance_walks_tokens_once(spark, sf):
    """No feature is interpreted a token at a time, and one step counts the tokens for all."""
    plan = catalogue.queries()["platform_significance"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "regexp_extract_all(lower" not in plan
    assert plan.count("pythonUDF") > 0 and sum("each(" in line and "ArrowEvalPython" in line for line in plan.splitlines()) == 1
