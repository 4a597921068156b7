"""Text functions and lexicons on hand-computed vectors."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from argosift.functions import lexicon as L
from argosift.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("Visit https://a.b/c?d NOW", "visit now"), ("see www.x.y/z and foo.org/bar ok", "see and ok"), ("@Jörg #Énergie hello", "hello"), ("go \U0001f600❤ on", "go on"), ("漢字 kana", "kana"),
    ("Click here to LEARN MORE", "to"), ("a  b\t\nc", "a b c"), (None, ""), ("", ""), ("  ", ""), ("1234567890", "1234567890"), ("a\x1cb", "a b"),
])
def test_clean_post(spark, text, want):
    assert one(spark, T.clean_post("t"), t=text) == want


@pytest.mark.parametrize(("text", "mode", "want"), [
    ("Go: https://x.y/z NOW!", "intended", "go now"), ("a  b", "intended", "a b"), ("Gosh: a  b!", "as_run", "gosh  a  b"), ("a\\sb", "as_run", "a b"), (None, "as_run", ""),
])
def test_clean_claim(spark, text, mode, want):
    assert one(spark, T.clean_claim("t", mode), t=text) == want


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.collapse, " a\n\n b ", "a b"), (T.normalize_label, " Pro  Energy ", "pro energy"), (T.strip_marks, "**“Claim”**", "Claim"), (T.strip_marks, "`x`", "x"), (T.strip_marks, None, ""),
    (T.one_sentence, "\n\nClaim: - \"The U.S. leads. It does.\"\nmore", "The U.S."), (T.one_sentence, "no end mark", "no end mark"), (T.one_sentence, "", ""), (T.one_sentence, "3) Gas is clean! Yes.", "Gas is clean!"),
    (T.safe_name, "Pro Energy/1", "Pro_Energy_1"), (T.pretty_feature, "mfd2_care.vice", "care.vice"), (T.pretty_feature, "ttr", "ttr"), (T.detect_language, "le chat et la souris sont dans une boîte", "fr"), (T.detect_language, "xyz", None),
    (lambda c: T.truncate(c, 5), "abcdefg", "abcde …"), (lambda c: T.truncate(c, 7), " abcdefg ", "abcdefg"), (lambda c: T.snippet(c, 20), "one two three four five six", "one two three [...]"), (lambda c: T.snippet(c, 20), "short", "short"),
    (lambda c: T.count_char(c, "?"), "a??b?", 3), (lambda c: T.count_tags(c, "#"), "#a # #é", 2), (T.has_url, "see http://x", True), (T.is_empty_like, " N/A ", True), (T.is_empty_like, "0", False),
])
def test_scalars(spark, f, text, want):
    assert one(spark, f("t"), t=text) == want


def test_arrays_and_templates(spark):
    assert one(spark, T.numbered("a", "Text {i}: {x}"), a=["p", "q"]) == "Text 1: p\nText 2: q"
    assert one(spark, T.template("{a} and {b}!", a="x", b="y"), x="1", y=None) == "1 and !"
    assert one(spark, T.cid_of_lines("t"), t="1. [cid=a1] x [cid=b]\nno\n2. [cid=07]") == ["a1", "07"]
    assert one(spark, T.composite_id("g", "n"), g="Pro", n=-1) == "-1" and one(spark, T.composite_id("g", "n"), g="Pro", n=3) == "Pro_3"
    assert one(spark, T.levenshtein_ratio("a", "b"), a="cat", b="dog") == 1.0 and one(spark, T.levenshtein_ratio("a", "b"), a="", b=None) == 0.0
    assert one(spark, T.tokens("t"), t="Café au lait-2") == ["caf", "au", "lait"]


@pytest.mark.parametrize(("text", "want"), [("a dragon!", True), ("dragonfly", False), ("DRAGON", True), ("x #oc y", True), ("x#oc", True), ("#ocean", False), (None, False), ("nighté", False), ("city  light", False), ("city light", True)])
def test_blocklist(spark, text, want):
    assert one(spark, T.blocked("t", ["dragon", "night", "#oc", "city light", ""]), t=text) is want
    assert one(spark, T.blocked("t", []), t=text) is False


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ @#é.\n/:w\U0001f600", max_size=30), min_size=1, max_size=20))
def test_cleaning_is_trimmed_and_lower(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_post("t").alias("x")).collect()
    assert all(r.x == r.x.strip() == r.x.lower() and "  " not in r.x for r in got)


DIC = "%\n1\tcare\n2\tharm\n%\nkind*\t1\nHurt\t2 1\nodd\t9\n"


def test_dictionaries(spark, tmp_path):
    assert L.parse_dic(DIC) == {"care": ["kind*", "hurt"], "harm": ["hurt"]}
    (tmp_path / "x.dic").write_text(DIC)
    assert L.read_dic(spark, str(tmp_path / "x.dic"))["harm"] == ["hurt"]
    assert L.read_dic(spark, None) is L.MORAL_FOUNDATIONS
    scores = spark.createDataFrame([("Kindness hurt hurts hurt",), (None,)], "t string").select(*[c.alias(k) for k, c in L.token_rates("t", L.parse_dic(DIC), "").items()]).collect()
    assert [tuple(r) for r in scores] == [(75.0, 50.0), (0.0, 0.0)]
    types = spark.createDataFrame([("hurt hurt kind x",)], "t string").select(*[c.alias(k) for k, c in L.type_rates("t", {"harm": ["hurt"]}, "").items()]).first()
    assert types.harm == 25.0


def test_register(spark):
    row = spark.createDataFrame([("Can you join us? Stop! #a @b http://x.y",), ("",), (None,)], "t string").select(*[c.alias(k) for k, c in L.register_features("t").items()]).collect()
    assert row[0].n_words == 10 and row[0].modal_rate == 10.0 and row[0].imperative_rate == 20.0 and row[0].question_rate == row[0].exclaim_rate == row[0].hashtag_rate == row[0].mention_rate == 10.0 and row[0].has_url == 1
    assert row[1] == row[2] and row[1].n_words == 1 and row[1].avg_word_len == 0.0


def test_alone_fluent_overlap(spark):
    assert one(spark, L.stands_alone("t"), t="The US acts") == 0 and one(spark, L.stands_alone("t"), t="Gas heats homes") == 1
    df = spark.createDataFrame([("a b", "a b", 5.0, 5.0), ("abcdefghij", "abcdefghik", 5.0, 4.0), ("abcdefghij", "abcdefghik", 4.0, 5.0), ("ab", "xyz", 5.0, 4.0)], "o string, c string, p double, q double")
    assert [r.x for r in df.select(L.fluent(F.col("o"), F.col("c"), F.col("p"), F.col("q")).alias("x")).collect()] == [1, 0, 1, 1]
    assert one(spark, L.overlap_f1("a", "b"), a="gas is clean", b="clean gas") == pytest.approx(0.8) and one(spark, L.overlap_f1("a", "b"), a="gas", b=None) is None


def test_language_splits_a_text_once(spark):
    """One split in the whole plan; ties go to the first code, words of two languages count in both."""
    df = spark.createDataFrame([("Der Hund und la le",), ("la",), ("EL por_la para é",), ("xyz",), (None,)], "t string")
    found = df.select(T.detect_language("t").alias("d"))
    assert [r.d for r in found.collect()] == ["de", "es", "es", None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
