"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, full digests, rule precedence."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, lower_ascii

#: (rule, verdict): a rule is a host and a path prefix.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Rules are broadcast up to this number, which is checked; more of them are shuffled.
_MOST_RULES = 500_000


def _digested(c: Column) -> list[Column]:
    """The full digest of an expression, and its first 32 bits as a number."""
    full = F.sha2(c, 256)
    return [full.alias("full"), F.conv(F.substring(full, 1, 8), 16, 10).cast("long").alias("short")]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of `pages`.

    A rule `host/path` fits its host and all subdomains if the url's path starts with the rule's; a rule without `/` is a host and fits every
    path. A-Z in a rule's host count as lower case. The longest rule wins; of equally long ones that with the longer host, then block before
    allow. Without a fitting rule the verdict is `default`.

    Each url is expanded into suffixes of its host with prefixes of its path, those that are as long as some rule's host and path, so a long
    host costs no more than a short one. The first 32 bits of an expression's SHA-256 are joined with those of the rules, then the
    whole digests are compared. Null urls and urls without `://` have an empty host and path and no rule. Repeated rows are judged once
    and returned as often as they occur; null page ids stay.

    The driver sees the distinct pairs of a host's and a path's length that the rules have. Up to 500,000 rules, which is checked, are broadcast; more are
    joined with the distinct expressions, and frequent expressions' rows then stay in place (`attach`).
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
    known = rules.filter(F.col("rule").isNotNull()).select("rule", "verdict").withColumn("cut", F.instr("rule", "/"))
    host = F.when(F.col("cut") > 0, F.substring(F.col("rule"), F.lit(1), F.col("cut") - 1)).otherwise(F.col("rule"))
    known = known.withColumn("rhost", lower_ascii(host)).withColumn("rpath", F.when(F.col("cut") > 0, F.substr("rule", F.col("cut"))).otherwise(F.lit("")))
    known = known.withColumn("expression", F.concat("rhost", "rpath")).select("rule", "verdict", F.length("rhost").alias("h"), F.length("rpath").alias("p"), *_digested(F.col("expression")))
    # One rule an expression: block before allow.
    known = known.groupBy("full", "short", "h", "p").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.coalesce(F.col("verdict") == "block", F.lit(False)), "rule")).alias("own"))
    n = known.count()
    lengths = known.groupBy("h").agg(F.array_sort(F.collect_set("p")).alias("p")).agg(F.array_sort(F.collect_list(F.struct("h", "p")))).first()[0]
    lengths = F.from_json(F.lit(json.dumps([{"h": x.h, "p": x.p} for x in lengths])), "array<struct<h:int,p:array<int>>>")

    url = F.col("url").cast("string")
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rows = pages.select("page_id", F.coalesce(after, F.lit("")).alias("rest"))
    raw = F.regexp_extract("rest", r"^[^/?#]*", 0)
    rows = rows.select("page_id", lower_ascii(raw).alias("host"), F.regexp_extract(F.substr("rest", F.length(raw) + 1), r"^[^?#]*", 0).alias("path"))
    size = F.length("host")
    fits = F.filter(lengths, lambda x: (x["h"] == size) | (x["h"] < size) & (F.substring(F.col("host"), size - x["h"], F.lit(1)) == "."))
    prefixes = lambda x: F.transform(F.filter(x["p"], lambda p: p <= F.length("path")), lambda p: F.concat(F.substring(F.col("host"), size - x["h"] + 1, x["h"]), F.substring(F.col("path"), F.lit(1), p)))
    every = F.when(F.col("host") != "", F.array_distinct(F.flatten(F.transform(fits, prefixes)))).otherwise(F.expr("cast(array() as array<string>)"))
    # The null stands for the row itself: it counts how often a row occurs.
    expanded = rows.select("page_id", "host", "path", F.explode(F.concat(every, F.array(F.lit(None).cast("string")))).alias("expression"))
    expanded = expanded.select("page_id", "host", "path", *_digested(F.col("expression")))
    if n <= _MOST_RULES:
        met = expanded.join(F.broadcast(known), ["short", "full"], "left").filter("own IS NOT NULL OR full IS NULL")
    else:
        seen = expanded.filter("full IS NOT NULL").groupBy("short", "full").agg(F.count(F.lit(1)).alias("size")).join(known, ["short", "full"])
        seen = Scratch(pages.sparkSession, "urls").put(seen.select("full", "size", "h", "p", "own"), "seen")
        total = seen.agg(F.sum("size")).first()[0] or 0
        met = attach(expanded.filter("full IS NOT NULL"), seen, "full", "size", total).unionByName(expanded.filter("full IS NULL"), allowMissingColumns=True)
    best = F.max_by("own", F.when(F.col("own").isNotNull(), F.struct(F.length("own.rule"), "h", F.coalesce(F.col("own.verdict") == "block", F.lit(False)), "full")))
    won = met.groupBy("page_id", "host", "path").agg(best.alias("won"), F.count_if(F.col("full").isNull()).alias("times"))
    each = won.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__copy"))
    return each.drop("__copy")
