"""Queries over model replies and JSON columns. The replies are put together from the tables' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from .registry import query, table

#: A reply for each document in eight shapes, made of its own columns: an object with all keys, without some, with null, fenced with words around
#: it, cut off, an array, `null`, the plain text. `js` is the reply where it is JSON; `object` the first object in it, its fence taken off and open braces closed.
_SHAPES_SQL = r"""replies AS (SELECT doc_id, CASE doc_id % 8
WHEN 0 THEN json_object('claim', coalesce(text, ''), 'ground', coalesce(source, ''), 'warrant', coalesce(lang, ''))::VARCHAR WHEN 1 THEN json_object('claim', coalesce(text, ''))::VARCHAR
WHEN 2 THEN json_object('claim', NULL, 'ground', ' ', 'evidence', coalesce(lang, ''))::VARCHAR
WHEN 3 THEN 'Here:' || chr(10) || '```json' || chr(10) || json_object('claim', CASE WHEN n_chars % 2 = 0 THEN ' Claim' ELSE 'no claim' END, 'confidence', n_chars % 150, 'evidence', coalesce(text, ''))::VARCHAR || chr(10) || '```'
WHEN 4 THEN '{"claim": "claim", "confidence": ' || n_chars % 90 || ', "more": {"a": 1' WHEN 5 THEN json_array(coalesce(source, ''))::VARCHAR WHEN 6 THEN 'null' ELSE coalesce(text, '') END AS reply FROM documents),
read AS (SELECT doc_id, reply, CASE WHEN json_valid(reply) THEN reply END AS js,
 CASE WHEN contains(reply, '```json') THEN regexp_extract(reply, '```json\s*(\{.*\})\s*```', 1, 's') WHEN json_valid(reply) AND reply LIKE '{%' THEN reply WHEN reply LIKE '{%' THEN reply || '}}' END AS object FROM replies)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reply) for every document."""
    of = lambda **keys: F.to_json(F.struct(*[c.alias(k) for k, c in keys.items()]), {"ignoreNullFields": "false"})
    own = lambda c: F.coalesce(c, F.lit(""))
    text, size = own("text"), F.col("n_chars")
    shapes = [
        of(claim=text, ground=own("source"), warrant=own("lang")), of(claim=text), of(claim=F.lit(None).cast("string"), ground=F.lit(" "), evidence=own("lang")),
        F.concat(F.lit("Here:\n```json\n"), of(claim=F.when(size % 2 == 0, " Claim").otherwise("no claim"), confidence=size % 150, evidence=text), F.lit("\n```")),
        F.concat(F.lit('{"claim": "claim", "confidence": '), (size % 90).cast("string"), F.lit(', "more": {"a": 1')), F.to_json(F.array(own("source"))), F.lit("null"), text,
    ]
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*shapes), (F.col("doc_id") % 8).cast("int")).alias("reply"))


_KEY = "CASE WHEN js IS NULL OR json_type(js) <> 'OBJECT' THEN NULL WHEN NOT json_exists(js, '$.{k}') THEN 'Not present' ELSE json_extract_string(js, '$.{k}') END AS {k}"
_BARE = r"nullif(regexp_replace(CASE WHEN json_type(js) = 'OBJECT' THEN json_extract_string(js, '$.{k}') END, '^\s+|\s+$', '', 'g'), '')"
_OR_ABSENT = f"coalesce({_BARE}, 'Not present') AS {{k}}"


@query(f"WITH {_SHAPES_SQL} SELECT doc_id, {', '.join(_KEY.format(k=k) for k in ('claim', 'ground', 'warrant'))} FROM read")
def toulmin_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim, ground and warrant; absent keys say so, an explicit null stays null."""
    found = P.toulmin("reply")
    return replies(spark, sf_dir).select("doc_id", found["claim"].alias("claim"), found["ground"].alias("ground"), found["warrant"].alias("warrant"))


@query(f"WITH {_SHAPES_SQL} SELECT doc_id, {', '.join(_OR_ABSENT.format(k=k) for k in ('claim', 'ground'))} FROM read")
def key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a reply, with a word for those that aren't there."""
    found = P.claim_and_ground("reply")
    return replies(spark, sf_dir).select("doc_id", found["claim"].alias("claim"), found["ground"].alias("ground"))


@query(f"WITH {_SHAPES_SQL} SELECT doc_id, json_valid(reply) AND trim(reply) NOT IN ('', 'None', 'null') AS valid FROM replies")
def valid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a reply is JSON."""
    return replies(spark, sf_dir).select("doc_id", P.valid_json("reply").alias("valid"))


@query(f"""WITH {_SHAPES_SQL}, k AS (SELECT {', '.join(f'{_BARE.format(k=k)} IS NOT NULL AS {k}' for k in ('claim', 'ground', 'warrant'))} FROM read)
SELECT round(avg(claim::INTEGER), 9) AS claim_rate, round(avg(warrant::INTEGER), 9) AS warrant_rate, round(avg((NOT ground)::INTEGER), 9) AS no_ground_rate, round(avg((claim AND NOT ground)::INTEGER), 9) AS claim_no_ground_rate, count(*) AS n FROM k""")
def toulmin_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often replies state a claim, a warrant, no ground."""
    there = lambda k: P.key_or_absent("reply", k) != P.ABSENT
    rate = lambda c, name: F.round(F.avg(c.cast("double")), 9).alias(name)
    return replies(spark, sf_dir).agg(rate(there("claim"), "claim_rate"), rate(there("warrant"), "warrant_rate"), rate(~there("ground"), "no_ground_rate"), rate(there("claim") & ~there("ground"), "claim_no_ground_rate"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SHAPES_SQL}, o AS (SELECT doc_id, CASE WHEN json_valid(object) THEN object END AS o FROM read)
SELECT doc_id, CASE WHEN o IS NULL THEN NULL WHEN lower(trim(coalesce(json_extract_string(o, '$.claim'), ''))) = 'claim' THEN 'Claim' ELSE 'No Claim' END AS claim,
CASE WHEN o IS NOT NULL THEN greatest(0, least(100, coalesce(try_cast(json_extract_string(o, '$.confidence') AS INTEGER), 0)))::VARCHAR END AS confidence, CASE WHEN o IS NOT NULL THEN coalesce(json_extract_string(o, '$.evidence'), '') END AS evidence FROM o""")
def claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags from the first JSON object of a reply, in a fence or cut off as it may be."""
    flag = P.claim_flag("js")
    return replies(spark, sf_dir).select("doc_id", P.first_json_udf("reply").alias("js")).select("doc_id", flag["claim"].alias("claim"), flag["confidence"].cast("string").alias("confidence"), flag["evidence"].alias("evidence"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def dotted_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of a JSON column."""
    return table(spark, sf_dir, "events").select("event_id", P.dotted("props", "k").try_cast("int").alias("k"))


@query("SELECT conv_id, turn, CASE WHEN lower(coalesce(text, '')) LIKE '%the%' AND role = 'user' THEN 'Coherent' ELSE 'Incoherent' END AS verdict, CASE WHEN lower(coalesce(text, '')) LIKE '%yes%' THEN 'Yes' ELSE 'No' END AS answer FROM conversations")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and yes or no from free text."""
    reply = F.when(F.lower(F.coalesce("text", F.lit(""))).contains("the") & (F.col("role") == "user"), "They are coherent.").otherwise("INCOHERENT, as it seems")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.verdict(reply).alias("verdict"), P.yes_no("text").alias("answer"))


@query("""WITH v AS (SELECT source, CASE WHEN n_chars > 1000 THEN 'Coherent' ELSE 'Incoherent' END AS verdict, lang IS NULL AS failed FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (verdict = 'Coherent') AS coherent, round(count(*) FILTER (verdict = 'Coherent') / count(*), 9) AS rate, count(*) FILTER (failed) AS errors FROM v GROUP BY source""")
def coherency_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict rates and errors by segment."""
    v = table(spark, sf_dir, "documents").select("source", P.verdict(F.when(F.col("n_chars") > 1000, "coherent").otherwise("incoherent")).alias("verdict"), F.col("lang").isNull().alias("failed"))
    good = F.count_if(F.col("verdict") == "Coherent")
    return v.groupBy("source").agg(F.count(F.lit(1)).alias("n"), good.alias("coherent"), F.round(good / F.count(F.lit(1)), 9).alias("rate"), F.count_if("failed").alias("errors"))


#: Lines of batch replies, by their kind.
_LINES = ["3", "3.", "1. 5", "[2] 7", "- 4", "12 because", "none"]
_LINE_SQL = "list_value('3', '3.', '1. 5', '[2] 7', '- 4', '12 because', 'none')[doc_id % 7 + 1]"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents a batch, their reply lines joined."""
    line = F.get(F.array(*map(F.lit, _LINES)), (F.col("doc_id") % 7).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("batch"), line.alias("line"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("items"))
    return grouped.select("batch", F.transform("items", lambda x: x["doc_id"]).alias("ids"), F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("reply"))


@query(f"""WITH l AS (SELECT doc_id, {_LINE_SQL} AS line FROM documents)
SELECT doc_id, CASE line WHEN '3' THEN '3' WHEN '1. 5' THEN '5' WHEN '[2] 7' THEN '7' WHEN '- 4' THEN '4' WHEN '12 because' THEN '12' END AS choice, CASE WHEN line IN ('3.', 'none') THEN 'non_matching' ELSE 'matched' END AS match_status FROM l""")
def parse_batch_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the choices of a batch reply, one list mark dropped from each line."""
    lines = _batches(spark, sf_dir).select(F.posexplode("ids").alias("i", "doc_id"), P.reply_lines("reply", F.size("ids")).alias("lines")).select("doc_id", F.get("lines", F.col("i")).alias("line"))
    claim = F.when(P.batch_number(F.col("line")).isNotNull(), "claim")
    return lines.select("doc_id", P.batch_number(F.col("line")).cast("string").alias("choice"), P.match_status(F.col("line"), claim).alias("match_status"))


@query(f"""WITH l AS (SELECT doc_id, {_LINE_SQL} AS line FROM documents), n AS (SELECT doc_id, try_cast(nullif(regexp_extract(line, '^\\s*(\\d+)', 1), '') AS INTEGER) AS number FROM l)
SELECT n.doc_id, number::VARCHAR AS number, b.item_id::VARCHAR AS assigned FROM n LEFT JOIN benchmark b ON b.item_id = number""")
def recover_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments recovered from a batch's prompt and reply."""
    shown = _batches(spark, sf_dir).withColumn("prompt", T.numbered(F.transform("ids", lambda i: i.cast("string")), "{i}. [cid={x}] text"))
    cids = P.reply_lines("reply", F.size("ids"))
    lines = shown.select(F.posexplode(T.cid_of_lines("prompt")).alias("i", "cid"), cids.alias("lines")).select(F.col("cid").cast("long").alias("doc_id"), P.plain_number(F.get("lines", F.col("i"))).alias("number"))
    claims = table(spark, sf_dir, "benchmark").select("item_id")
    return lines.join(claims, F.col("item_id") == F.col("number"), "left").select("doc_id", F.col("number").cast("string").alias("number"), F.col("item_id").cast("string").alias("assigned"))


@query("""WITH l AS (SELECT doc_id, doc_id // 4 AS batch, CASE doc_id % 3 WHEN 0 THEN 'RELEVANT' WHEN 1 THEN 'IRRELEVANT' END AS label FROM documents),
k AS (SELECT doc_id, batch, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS i FROM l), g AS (SELECT batch, list(label ORDER BY doc_id) FILTER (label IS NOT NULL) AS labels FROM l GROUP BY batch)
SELECT doc_id, coalesce(labels[i], 'UNKNOWN') AS relevance FROM k JOIN g USING (batch)""")
def relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a batch, unreadable lines dropped and the rest filled with UNKNOWN."""
    line = F.when(F.col("doc_id") % 3 == 0, "it is relevant").when(F.col("doc_id") % 3 == 1, "2. IRRELEVANT").otherwise("cannot say")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("batch"), line.alias("line"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("items"))
    labels = P.relevance_labels(F.array_join(F.transform("items", lambda x: x["line"]), "\n"), F.size("items"))
    return grouped.select(F.posexplode("items").alias("i", "item"), labels.alias("labels")).select("item.doc_id", F.get("labels", F.col("i")).alias("relevance"))


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(replace(coalesce(text, ''), '<', ' '), '\s+', ' ', 'g'), ' '), ' ') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 2) // 3)) AS i FROM w),
p AS (SELECT doc_id, [least(coalesce(w[3 * i + 1], ''), coalesce(w[3 * i + 2], '')), greatest(coalesce(w[3 * i + 1], ''), coalesce(w[3 * i + 2], ''))] AS pair FROM c), d AS (SELECT doc_id, count(DISTINCT pair) FILTER (pair[1] <> '' AND pair[2] <> '')::INTEGER AS pairs FROM p GROUP BY doc_id)
SELECT doc_id, pairs, (pairs <= 1)::INTEGER AS atomic FROM d""")
def triplet_atomicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a relation string made of a text's words, three by three; a claim is atomic with one pair at most."""
    cut = F.split(F.trim(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit(" ")), r"(?U)\s+", " ")), " ")
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    one = lambda i: F.concat(F.lit("<triplet> "), word(3 * i), F.lit(" <subj> "), word(3 * i + 1), F.lit(" <obj> "), word(3 * i + 2))
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 3).cast("int")), one), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", cut.alias("w")).select("doc_id", made.alias("made"))
    return rows.select("doc_id", F.size(P.triplet_pairs("made")).alias("pairs"), P.atomic("made").alias("atomic"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN n_chars % 3 = 2 THEN coalesce(text, '') ELSE json_object('atomicity', n_chars % 2, 'fluency', 1, 'decontextualization', 0, 'faithfulness', n_chars % 5 = 0, 'reasoning', coalesce(text, ''))::VARCHAR END AS reply FROM documents),
j AS (SELECT doc_id, CASE WHEN json_valid(reply) AND reply LIKE '{%' THEN reply END AS js FROM r)
SELECT doc_id, coalesce(json_extract_string(js, '$.atomicity')::INTEGER, -1) AS atomicity, coalesce(json_extract_string(js, '$.faithfulness')::BOOLEAN::INTEGER, -1) AS faithfulness, coalesce(json_extract_string(js, '$.reasoning'), 'unreadable reply') AS reasoning FROM j""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's scores, all -1 where the reply can't be read."""
    size, text = F.col("n_chars"), F.coalesce("text", F.lit(""))
    good = F.to_json(F.struct((size % 2).alias("atomicity"), F.lit(1).alias("fluency"), F.lit(0).alias("decontextualization"), (size % 5 == 0).alias("faithfulness"), text.alias("reasoning")))
    found = P.judge_scores(F.when(size % 3 == 2, text).otherwise(good))
    return table(spark, sf_dir, "documents").select("doc_id", found["atomicity"].alias("atomicity"), found["faithfulness"].alias("faithfulness"), found["reasoning"].alias("reasoning"))


@query("""SELECT conv_id, turn, coalesce(text, '') AS content, CASE lower(trim(coalesce(role, ''))) WHEN 'user' THEN 'Yes' WHEN 'system' THEN 'No' ELSE 'Skip' END AS choice, CASE role WHEN 'user' THEN 'true' WHEN 'system' THEN 'false' END AS stored FROM conversations""")
def chat_and_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat completion's message, and annotation choices to and from stored values."""
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("message"))).alias("choices")))
    choice = P.value_to_choice(F.when(F.col("role") == "user", "TRUE").when(F.col("role") == "system", "no").otherwise("?"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.chat_content(reply).alias("content"), choice.alias("choice"), P.choice_to_value(choice, booleans=True).cast("string").alias("stored"))


@query(r"""WITH r AS (SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN json_object('topic', ' ' || coalesce(text, '') || ' ', 'summary', 's', 'keywords', json_array(coalesce(source, ''), coalesce(lang, '')))::VARCHAR WHEN 1 THEN json_object('summary', coalesce(text, ''), 'keywords', coalesce(source, '') || ' , ' || coalesce(lang, '') || ',')::VARCHAR
WHEN 2 THEN json_object('topic', coalesce(source, ''), 'summary', 's')::VARCHAR ELSE json_object('topic', n_chars, 'summary', 's')::VARCHAR END AS js FROM documents),
k AS (SELECT doc_id, js, coalesce(json_type(js, '$.topic'), 'VARCHAR') = 'VARCHAR' AS good, json_type(js, '$.keywords') AS kind FROM r)
SELECT doc_id, CASE WHEN good THEN coalesce(nullif(regexp_replace(json_extract_string(js, '$.topic'), '^\s+|\s+$', '', 'g'), ''), 'Unknown') END AS topic,
CASE WHEN NOT good THEN NULL WHEN kind = 'ARRAY' THEN array_to_string(json_extract_string(js, '$.keywords[*]'), '|') WHEN kind = 'VARCHAR' THEN array_to_string(list_filter(list_transform(string_split(json_extract_string(js, '$.keywords'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') ELSE '' END AS keywords FROM k""")
def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic and keywords of a summary, from a list or a comma string; null where the topic is no string."""
    own = lambda c: F.coalesce(c, F.lit(""))
    of = lambda **keys: F.to_json(F.struct(*[c.alias(k) for k, c in keys.items()]))
    shapes = [of(topic=F.concat(F.lit(" "), own("text"), F.lit(" ")), summary=F.lit("s"), keywords=F.array(own("source"), own("lang"))), of(summary=own("text"), keywords=F.concat(own("source"), F.lit(" , "), own("lang"), F.lit(","))), of(topic=own("source"), summary=F.lit("s")), of(topic=F.col("n_chars"), summary=F.lit("s"))]
    found = P.cluster_summary(F.get(F.array(*shapes), (F.col("n_chars") % 4).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", found["topic"].alias("topic"), F.when(found.isNotNull(), F.array_join(found["keywords"], "|")).alias("keywords"))


@query("""SELECT doc_id, 'Text:' || chr(10) || source || chr(10) || 'Output:' || chr(10) || coalesce(lang, '') AS input_text, 'Text:' || chr(10) || source || chr(10) || 'Claim:' || chr(10) || coalesce(lang, '') || chr(10) || 'Ground:' || chr(10) AS ground_text FROM documents""")
def validation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of the validation prompts."""
    return table(spark, sf_dir, "documents").select("doc_id", P.input_text("source", "lang").alias("input_text"), P.ground_input_text("source", "lang", F.lit("")).alias("ground_text"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY batch) AS first_id FROM (SELECT doc_id, doc_id // 100 AS batch FROM documents)")
def first_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of a group in row order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("batch"))
    return rows.select("doc_id", F.min("doc_id").over(Window.partitionBy("batch")).alias("first_id"))
