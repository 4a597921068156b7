"""Quality, toxicity and language: held-out accuracy, edges, what a score may depend on."""

import zlib

import pytest
from pyspark.sql import functions as F

from argosift.llm.language import BloomLanguages
from argosift.llm.quality import CompressionQuality
from argosift.llm.queries import op1_toxicity, op5_quality, op9_language
from argosift.llm.toxicity import SubwordToxicity

from .conftest import edge_rows

BIG = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks, at = [0.0] * len(scores), 0
    while at < len(order):
        end = at
        while end + 1 < len(order) and scores[order[end + 1]] == scores[order[at]]:
            end += 1
        for i in order[at : end + 1]:
            ranks[i] = (at + end) / 2 + 1
        at = end + 1
    good = sum(labels)
    return (sum(r for r, y in zip(ranks, labels, strict=True) if y) - good * (good + 1) / 2) / (good * (len(labels) - good))


@pytest.mark.parametrize(("op", "label", "modulus", "held", "cut", "least"), [(op1_toxicity, "toxic", 3, 1, 0.7, 0.9), (op5_quality, "quality", 5, 0, 0.3, 0.95)])
def test_held_out(spark, op, label, modulus, held, cut, least):
    got = op(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id", "left").collect()
    assert len(got) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    fresh = [r for r in got if r.held_out and r[label] is not None]
    assert auc([r.score for r in fresh], [r[label] for r in fresh]) > least


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    got = op9_language(spark, BIG).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    fresh = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in fresh) / len(fresh) > 0.98


@pytest.fixture(scope="module")
def models():
    toxic = [(f"a fine text about {w} and more of it", 0) for w in "rivers birds stones trees clouds roads songs boats".split()] * 4 + [(f"you {w} are a blithering nincompoop today", 1) for w in "rivers birds stones trees clouds roads songs boats".split()] * 4
    good = [("The river bends slowly towards the sea and the birds follow it. " * 4, 1), ("Stones lie on the road; the boat waits by the trees. " * 5, 1), ("buy now!!! $$$ click $$$ buy now!!! " * 9, 0), ("%%% ### %%% ### win win win %%% " * 9, 0)] * 6
    lang = [("the birds and the river in the town", "en"), ("der Vogel und die Stadt mit dem Fluss", "de"), ("la ville et les oiseaux dans la rue", "fr")] * 3
    return SubwordToxicity(toxic), CompressionQuality(good), BloomLanguages(lang)


def test_edge_rows(models, edge, clashing, empty):
    for model in models:
        for df in (edge, clashing):
            got = model.score(df)
            rows = got.collect()
            assert len(rows) == len(edge_rows()) and len(set(got.columns)) == len(got.columns) and all(0 <= r.score <= 1 for r in rows)
        assert model.score(empty).count() == 0
    rows = models[2].score(edge).collect()
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in rows)


def test_unseen_misspellings_share_n_grams(models):
    clean, toxic, odd = models[0].scores(["a fine text about rivers and more of it", "you birds are a blithering nincompoop today", "you birds are a blitherinng ninncompoop today"])
    assert toxic > 0.7 and clean < 0.3 and odd > 0.5


def test_one_toxic_passage_in_a_long_text(models):
    long = "a fine text about stones and more of it. " * 200
    clean, toxic = models[0].scores([long, long + "you boats are a blithering nincompoop today. " + long])
    assert toxic > clean + 0.3


def test_scores_depend_on_text_alone(models, edge):
    for model in models:
        one = {r.text: r.score for r in model.score(edge).collect()}
        two = {r.text: r.score for r in model.score(edge.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.lit(0).cast("long")}).repartition(3)).collect()}
        assert one == two


def test_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for model in (SubwordToxicity.fit(edge, labels), CompressionQuality.fit(edge, labels)):
            assert all(0 <= r.score <= 1 for r in model.score(edge).collect())
    assert {r.lang_pred for r in BloomLanguages.fit(edge.withColumn("lang", F.lit(None).cast("string"))).score(edge).collect()} == {"und"}


def test_bloom_filters_hold_what_they_learned():
    model = BloomLanguages([("zebra quagga gnu zebra", "a"), ("zebra quagga gnu", "a"), ("yttrium xenon argon", "b"), ("yttrium xenon argon", "b")])
    assert model.corrected("zebra")[0] == 1.0 and model.corrected("yttrium")[1] == 1.0
    assert model.predict("zebra gnu")[0] == "a" and model.predict("xenon")[0] == "b"


def test_many_languages():
    sample = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}qu {chr(97 + i % 26)}{chr(97 + i // 26)}xa", f"l{i:02}") for i in range(70)] * 2
    model = BloomLanguages(sample)
    assert sum(model.predict(t)[0] == lang for t, lang in sample[:70]) > 66
