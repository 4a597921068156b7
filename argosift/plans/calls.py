"""Queries through model calls and scorers, with offline models that answer from the prompt's own text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import models as M
from .registry import query, table

#: The texts of a conversation in order, as one array; those of the offline models' prompts.
_TURNS = "SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS texts FROM conversations GROUP BY conv_id"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: x["text"]).alias("texts"))


def _coherent(prompt: str) -> str:
    return "Coherent." if "?" in prompt.split("\n", 1)[1] else "incoherent"


@query(f"""WITH c AS ({_TURNS}) SELECT conv_id, CASE WHEN len(list_filter(texts, lambda t: contains(substr(trim(t, ' ' || chr(9) || chr(10) || chr(13)), 1, 2000), '?'))) > 0 THEN 'Coherent' ELSE 'Incoherent' END AS verdict FROM c""")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: one verdict for the texts of a cluster (2,000 characters of each go into the prompt, as its limit says)."""
    return M.SPECS["verdict"].run(_texts(spark, sf_dir), M.EchoClient(_coherent)).select("conv_id", "verdict")


def _claim(prompt: str) -> str:
    lines = [x for x in prompt.split("\n")[1:] if x.startswith("- ")]
    return f'Claim: "There are {len(lines)} texts, {sum("!" in x for x in lines)} of them loud. More follows."'


@query(rf"""WITH c AS ({_TURNS}) SELECT conv_id, 'There are ' || len(texts) || ' texts, ' || len(list_filter(texts, lambda t: contains(substr(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 2500), '!'))) || ' of them loud.' AS cluster_claim FROM c""")
def model_cluster_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each cluster, cut to its first sentence."""
    return M.SPECS["cluster_claim"].run(_texts(spark, sf_dir), M.EchoClient(_claim)).select("conv_id", "cluster_claim")


def _toulmin(prompt: str) -> str:
    text = prompt.split("Text: ", 1)[1]
    return f'Here it is:\n```json\n{{"claim": "{len(text)}", "ground": null{", " + chr(34) + "warrant" + chr(34) + ": " + chr(34) + "so" + chr(34) if "because" in text else ""}}}\n```'


@query("SELECT doc_id, length(coalesce(text, ''))::VARCHAR AS claim, NULL::VARCHAR AS ground, CASE WHEN contains(coalesce(text, ''), 'because') THEN 'so' ELSE 'Not present' END AS warrant FROM documents")
def model_toulmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: claim, ground and warrant of each whole text."""
    got = M.SPECS["toulmin"].run(table(spark, sf_dir, "documents").select("doc_id", "text"), M.EchoClient(_toulmin))
    return got.select("doc_id", *[F.col(f"toulmin.{k}").alias(k) for k in ("claim", "ground", "warrant")])


def _valid(prompt: str) -> str:
    return "VALID" if prompt.count("\n") % 2 else "It is invalid."


@query("SELECT doc_id, CASE WHEN (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) % 2 = 1 THEN 'VALID' ELSE 'INVALID' END AS validation FROM documents")
def model_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: whether an output follows from its text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input_text"))
    return M.SPECS["validation"].run(rows, M.EchoClient(_valid)).select("doc_id", "validation")


def _label(prompt: str) -> str:
    return f" Topic  of {prompt.count(chr(10) + '- ')} claims "


@query(f"""WITH c AS ({_TURNS}), n AS (SELECT conv_id, len(list_filter(texts, lambda t: NOT contains(t, chr(10) || '- '))) AS whole, texts FROM c)
SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'Uncategorized' ELSE 'Topic of ' || (SELECT sum(1 + (length(t) - length(replace(t, chr(10) || '- ', ''))) // 3) FROM unnest(texts) AS u(t))::BIGINT || ' claims' END AS topic FROM n""")
def model_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: a topic label for each cluster, none for noise."""
    rows = _texts(spark, sf_dir).withColumnRenamed("texts", "claims")
    got = M.SPECS["topic_label"].run(rows, M.EchoClient(_label))
    return got.select("conv_id", M.topic_or_none(F.col("topic_label"), F.when(F.col("conv_id") % 4 == 0, -1).otherwise(1)).alias("topic"))


class Flaky:
    """An offline model that fails a prompt's first tries, as many as the number that the prompt begins with."""

    def __init__(self):
        self.tries: dict[str, int] = {}

    def __call__(self, prompt: str) -> str:
        self.tries[prompt] = self.tries.get(prompt, 0) + 1
        if self.tries[prompt] <= int(prompt.split(" ", 1)[0]):
            raise ValueError(f"try {self.tries[prompt]}")
        return prompt.upper()


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN upper((doc_id % 5) || ' ' || doc_id || ' ' || coalesce(source, '')) END AS reply, CASE WHEN doc_id % 5 >= 3 THEN 'ValueError: try 3' END AS error FROM documents")
def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts for each call; what fails three times carries its last error."""
    prompt = F.concat_ws(" ", F.col("doc_id") % 5, "doc_id", F.coalesce("source", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))
    return M.ask(rows, "prompt", Flaky(), M.RetryPolicy(attempts=3, base=0.0, jitter=0.0)).select("doc_id", "reply", "error")


@query()
def fluency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite and two perplexities by offline scorers, then the flag. (No SQL: a character model.)"""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    rewritten = M.score(rows, "text", M.TidyRewriter(), "rewrite", "string")
    both = M.score(M.score(rewritten, "text", M.CharPerplexity(), "before", "double"), "rewrite", M.CharPerplexity(), "after", "double")
    return both.select("item_id", "rewrite", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), L.fluent(F.col("text"), F.col("rewrite"), F.col("before"), F.col("after")).alias("fluent"))


@query()
def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets of each item by the offline extractor, and whether it is atomic. (No SQL: a scorer.)"""
    from ..functions import parse as P

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    made = M.score(rows, "text", M.ClauseTriplets(), "triplets", "string")
    return made.select("item_id", "triplets", F.size(P.triplet_pairs("triplets")).alias("pairs"), P.atomic("triplets").alias("atomic"))
