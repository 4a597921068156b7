"""Files, model calls and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from argosift.operators import models as M
from argosift.sources import files
from argosift.streaming import resume

TEXTS = [("1", 'quote " and\nline, break'), ("02", "NA"), (None, "é ünï"), ("bafy", None)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "cid string, text string")
    files.write_csv(df, str(tmp_path / "a"))
    got = {tuple(r) for r in files.read_csv_strings(spark, str(tmp_path / "a")).collect()}
    assert got == {(a or "", b or "") for a, b in TEXTS}
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "a"), "cid string, text string").collect()} == set(TEXTS)


def test_csv_floats_and_tolerance(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("x", 0.1234567)], "a string, b double"), str(tmp_path / "f"), floats=6)
    assert files.read_csv(spark, str(tmp_path / "f")).first().b == "0.123457"
    (tmp_path / "l.csv").write_bytes("a,b\né,1\nbad\nx,y,z\n".encode("latin-1"))
    got = files.read_csv_tolerant(spark, str(tmp_path / "l.csv"), "a string, b int").collect()
    assert ("é", 1) in {tuple(r) for r in got} and all(r.a != "x" for r in got)


def test_row_index(spark):
    df = spark.range(1000).repartition(7)
    got = files.with_row_index(df)
    assert sorted(r.row_index for r in got.collect()) == list(range(1000))


def test_row_index_after_a_coalesced_shuffle(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        df = spark.range(3000).withColumn("pad", F.repeat(F.lit("x"), 300)).groupBy("id").agg(F.first("pad").alias("pad"))
        got = files.with_row_index(df)
        assert sorted(r.row_index for r in got.select("row_index").collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_jsonl_resume(spark, tmp_path):
    path = str(tmp_path / "j")
    schema = "cid string, error string"
    one = spark.createDataFrame([("a", None), ("b", "timeout")], schema)
    files.append_new(one, path)
    files.append_new(spark.createDataFrame([("a", None), ("c", None), (None, None)], schema), path)
    assert sorted(str(r.cid) for r in spark.read.schema(schema).json(path).collect()) == ["None", "a", "b", "c"]
    files.append_new(spark.createDataFrame([("b", None), ("a", None)], schema), path, retry_errors=True)
    assert sorted(r.cid for r in spark.read.schema(schema).json(path).filter("cid is not null").collect()) == ["a", "b", "b", "c"]
    with pytest.raises(Exception):  # noqa: B017
        (tmp_path / "bad.jsonl").write_text('{"cid": "x"}\n\nnot json\n')
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema, strict=False).filter("cid is not null").count() == 1


def test_small_files(spark, tmp_path):
    (tmp_path / "k.txt").write_text(" Dragon \n\n#OC\n")
    assert sorted(files.read_keywords(spark, str(tmp_path / "k.txt"))) == ["#oc", "dragon"]
    assert files.read_prompt(spark, str(tmp_path / "k.txt")) == "Dragon \n\n#OC"
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "k.txt")]) == str(tmp_path / "k.txt") and files.first_existing(spark, [str(tmp_path / "no")]) is None
    for b, r, kind in ((1, 0, "prompt"), (1, 0, "response"), (2, 0, "prompt"), (3, 1, "prompt"), (3, 1, "response")):
        (tmp_path / f"assign_batch{b:05d}_retry{r}_{kind}.txt").write_text(f"{kind} {b}")
    assert [tuple(r) for r in files.read_paired_logs(spark, str(tmp_path)).collect()] == [(1, "prompt 1", "response 1")]


def test_embedding_cache(spark, tmp_path):
    made = []

    def make(ids):
        made.append(1)
        return ids.withColumn("vector", F.array(F.lit(1.0)))

    path, ids = str(tmp_path / "e"), spark.createDataFrame([(1,), (2,)], "id long")
    for df, calls in ((ids, 1), (ids, 1), (ids.filter("id = 1"), 2)):
        assert files.cached_embeddings(df, path, make).count() == df.count() and len(made) == calls


# Model calls.


def test_retry_policy():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return "ok"

    policy = M.RetryPolicy(attempts=4, base=1, factor=2, cap=3, jitter=0, sleep=waits.append)
    assert policy.call(flaky) == ("ok", None) and waits == [1, 2]

    def limited():
        raise M.RateLimited("429")

    assert M.RetryPolicy(attempts=3, limited_wait=None, sleep=waits.append).call(limited)[1].startswith("rate limited") and len(waits) == 2
    assert M.RetryPolicy(attempts=2, factor=0, base=5, jitter=0, sleep=waits.append).call(lambda: 1 / 0)[1].startswith("ZeroDivisionError") and waits[-1] == 5


def test_a_failing_row_stops_no_other(spark):
    def client(prompt):
        if "boom" in prompt:
            raise ValueError("boom")
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("boom",), ("",), (None,)], "p string")
    got = {r.p: (r.reply, r.error) for r in M.ask(df, "p", client, M.RetryPolicy(attempts=1)).collect()}
    assert got["a"] == ("A", None) and got["boom"] == (None, "ValueError: boom") and got[""] == got[None] == (None, None)


@pytest.mark.parametrize(("name", "columns", "reply", "want"), [
    ("claim_flag", {"text": "gas!"}, '```json\n{"claim": "Claim", "confidence": 7}```', ("Claim", 7, "", "")), ("verdict", {"texts": ["a", "b"]}, "Incoherent", "Incoherent"), ("cluster_claim", {"texts": ["a"]}, "Claim: Gas heats. More.", "Gas heats."),
    ("toulmin", {"text": "x"}, 'Sure: {"claim": "c"}', ("c", "Not present", "Not present")), ("validation", {"input_text": "x"}, "invalid", "INVALID"), ("topic_label", {"claims": ["a"]}, " Energy  jobs ", "Energy jobs"),
    ("agrees", {"text": "t", "claim": "c"}, "yes!", "Yes"), ("summary", {"claims": ["a"]}, '{"topic": "t", "summary": "s", "keywords": "k"}', ("t", "s", ["k"])), ("judgement", {"source": "s", "claim": "c"}, "?", (-1, -1, -1, -1, "unreadable reply")),
])
def test_specs(spark, name, columns, reply, want):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items()))
    got = M.SPECS[name].run(df, M.EchoClient(reply)).first()[name]
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_assignment_retries_failed_lines(spark):
    class Client:
        """Answers the first text of a call alone."""

        def __call__(self, prompt):
            texts = prompt.split("one a line.\n")[1].splitlines()
            return "\n".join(["1"] + ["?"] * (len(texts) - 1))

    items = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "row_index long, text string")
    claims = [{"cluster_id": "c", "cluster_claim": "C.", "segment": "s"}]
    got = sorted(M.assign(items, claims, Client(), size=3, retries=1).collect())
    assert [r.match_status for r in got] == ["matched", "matched", "non_matching"] * 2 + ["matched"]
    assert got[0].assigned_claim == "C." and got[2].assign_reason == "llm_missing"


def test_relevance_batches(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(45)], "row_index long, clean_text string")
    client = M.EchoClient(lambda p: "\n".join("RELEVANT" if line.endswith("x") else "IRRELEVANT" for line in p.splitlines()[1:]))
    got = {r.row_index: r.relevance for r in M.relevance(df, client).collect()}
    assert got == {i: "RELEVANT" if i % 2 else "IRRELEVANT" for i in range(45)}


def test_embedder(spark):
    got = M.embed(spark.createDataFrame([("gas is good",), ("gas is good",), (None,)], "t string"), "t").collect()
    assert got[0].vector == got[1].vector and np.linalg.norm(got[0].vector) == pytest.approx(1, abs=1e-5) and len(got[2].vector) == 64
    assert M.topic_or_none(F.lit("x"), F.lit(-1)) is not None


# Streams.


def test_append_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "cid string, text string"
    put = lambda rows, mode: spark.createDataFrame(rows, schema).write.mode(mode).json(src)
    put([("a", "x"), ("b", "y")], "append")
    run = lambda check: resume.append_once(spark.readStream.schema(schema).json(src), out, str(tmp_path / check)).awaitTermination()
    run("c1")
    put([("b", "again"), ("c", "z")], "append")
    run("c1")
    run("c2")
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_first_seen_and_cleaning(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "Hello there you", "2024-01-01 00:00:00"), ("a", "Hello again you", "2024-01-01 00:10:00"), ("b", "short", "2024-01-01 00:20:00")]
    random.Random(0).shuffle(rows)
    spark.createDataFrame(rows, "cid string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.json(src)
    got = resume.first_seen(resume.clean_stream(resume.stream_posts(spark, src)))
    q = got.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [r.cid for r in spark.table("firsts").collect()] == ["a"]


def test_paired_logs_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No row comes to the driver; texts keep their bytes; what isn't in a pair, of another retry or half a file stays out; other stores go through Spark."""
    from pyspark.sql import DataFrame

    rows = [(1, 0, "a\r\nb ", ""), (2, 0, "é\n\n", "ü😀"), (3, 0, "alone", None), (4, 1, "later", "later"), (-5, 0, "no number", "x")]
    calls = spark.createDataFrame(rows, "batch int, retry int, prompt string, response string")
    want = [(1, "a\r\nb ", ""), (2, "é\n\n", "ü😀")]
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows in the driver"))
        files.write_paired_logs(calls.repartition(3), f"file://{tmp_path}/a")
    assert sorted(p.name for p in (tmp_path / "a").glob("*3_retry0*")) == ["assign_batch3_retry0_prompt.txt"] and not list((tmp_path / "a").glob("*.txt.*"))
    assert sorted(map(tuple, files.read_paired_logs(spark, f"file://{tmp_path}/a").collect())) == want
    monkeypatch.setattr(files, "_mounted", lambda *_: None)
    files.write_paired_logs(calls, f"{tmp_path}/b")
    for folder in ("a", "b"):
        assert sorted(map(tuple, files.read_paired_logs(spark, f"{tmp_path}/{folder}").collect())) == want


def test_csv_keeps_blanks_at_the_ends(spark, tmp_path):
    from argosift.plans import catalogue

    texts = [" lead", "trail ", "\ttab\t", "\rx", "x\r", "x\n", "\nx", "\n", "  ", "a, b ", "\x01", "a\r\nb", '" "', "", None]
    spark.createDataFrame([(i, t, " en " if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.queries()["csv_round_trip"](spark, str(tmp_path)).collect()}
    assert got == {(str(i), t or "", " en " if i % 2 else "") for i, t in enumerate(texts)}


def test_models_take_rows_in_slices(spark):
    """Rows stay in Arrow's form but for a slice; every row comes back with its own reply, whatever the other columns are."""
    df = spark.range(0, 1500, 1, 2).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("p"), "id")).alias("prompt"), F.array("id").alias("more"), F.current_timestamp().alias("at"))
    asked = M.ask(df, "prompt", M.EchoClient(str.upper))
    for out in asked, M.score(df, "prompt", lambda texts: [len(t) for t in texts], "n", "long"), M.embed(df, "prompt"):
        plan = out._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert {(r.id, r.reply, r.error, r.more[0]) for r in asked.collect()} == {(i, f"P{i}" if i % 7 else None, None, i) for i in range(1500)}
    assert {(r.id, r.n) for r in M.score(df, "prompt", lambda texts: [len(t) for t in texts], "n", "long").collect()} == {(i, len(f"p{i}") if i % 7 else 0) for i in range(1500)}
    assert [len(r.vector) for r in M.embed(df, "prompt").filter("id < 14").collect()] == [64] * 14


def test_hash_embedder_is_that_of_a_plain_loop():
    """The same vectors to the bit, in less than half the time of a loop over characters."""
    import time
    import zlib

    def loop(texts, size):
        out = np.zeros((len(texts), size), np.float32)
        for row, t in zip(out, texts):
            padded = f" {t.lower()} "
            for i in range(len(padded) - 2):
                h = zlib.crc32(padded[i : i + 3].encode())
                row[h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    texts = ["", "a", "é", "日本 ß", "😀😀x", "İ", "\x7f\x80߿ࠀ￿\U00010000\U0010ffff", "Some plain words, and more. " * 8000]
    start = time.perf_counter()
    want = {size: loop(texts, size) for size in (7, 64)}
    middle = time.perf_counter()
    got = {size: M.HashEmbedder(size)(texts) for size in (7, 64)}
    assert time.perf_counter() - middle < (middle - start) / 2
    assert all(got[s].dtype == want[s].dtype and (got[s] == want[s]).all() for s in want)
