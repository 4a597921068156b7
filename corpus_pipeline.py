"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, mixing. Part of the subpackage `argosift.llm`.

STAGES are (name, function of (spark, docs, sf_dir)). Each works on all that the stage before has kept and returns the columns of
`documents`; the last one returns the mix, a row for each time a document is taken, with its `shard`. `run` writes every
stage as Parquet into the shared folder and reads it again for the next.

In every stage columns besides those it works on stay as they are, whatever their names (the last one puts its own `shard` in the place of
any column of that name), and no rows in give no rows out. What nulls, ties and repeated rows do stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosift.llm.common import Scratch, table
from argosift.llm.decontaminate import Decontaminator
from argosift.llm.exact_dedup import DigestIndex
from argosift.llm.mixing import Mixer
from argosift.llm.near_dedup import drop_near_duplicates
from argosift.llm.quality import CompressionQuality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier gives 0.3 or more; it is fitted on the labelled rows outside the held-out fold.

    Null and empty texts are scored as texts of no bytes. Repeated rows are scored alike and go or stay together. Without labels of both kinds
    all rows have one score.
    """
    model = CompressionQuality.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, to="__score").filter(F.col("__score") >= 0.3).drop("__score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the largest doc_id.

    Null texts count as empty, and one row of them stays. A null doc_id loses against others. Of rows that tie in doc_id and text, the
    least by all columns stays.
    """
    return DigestIndex(spark).survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies (five-word shingles, similarity 0.8).

    Texts without words are near no other and stay. Rows with a null doc_id stay. Rows that share a doc_id are one document and go or stay
    together.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have no passage and stay. Rows are judged by their own text, also where they share a doc_id or have none.
    """
    return Decontaminator(table(spark, sf_dir, "benchmark"), window=10).clean(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, in its shard's order.

    Rows with a null source are a source of their own. Repeated rows count each; ids may be null. Texts without words are taken as often
    as the rest of their block.
    """
    return Mixer().draw(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", leaks), ("mixing", mixing)]

#: SQL expresses neither the classifier nor the seeded draws; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
