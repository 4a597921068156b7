"""Model calls as typed operators: prompts in, parsed columns out, with retries, batches and offline stand-ins."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text

if TYPE_CHECKING:
    import pyarrow as pa


class RateLimited(RuntimeError):
    """The service asks to slow down."""


class Client(Protocol):
    """A model: a prompt in, a reply out. It is sent to the executors, so it must pickle."""

    def __call__(self, prompt: str) -> str: ...


class Embedder(Protocol):
    """Texts in, one row of floats for each out."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class RetryPolicy:
    """Waits between attempts: `base * factor ** attempt` up to `cap`, or linear with `factor` 0, with a jitter; rate limits may abort."""

    attempts: int = 3
    base: float = 1.0
    factor: float = 2.0
    cap: float = 60.0
    jitter: float = 0.2
    limited_wait: tuple[float, float] | None = (30.0, 60.0)
    sleep: Callable[[float], None] = time.sleep
    rng: random.Random = field(default_factory=lambda: random.Random(0))

    def wait(self, attempt: int) -> float:
        raw = self.base * (self.factor**attempt if self.factor else attempt + 1)
        return min(self.cap, raw) * (1 + self.jitter * self.rng.uniform(-1, 1))

    def call(self, f: Callable[[], str]) -> tuple[str | None, str | None]:
        """(reply, error): the error of the last attempt if none succeeded."""
        error = None
        for attempt in range(self.attempts):
            try:
                return f(), None
            except RateLimited as e:
                error = f"rate limited: {e}"
                if self.limited_wait is None:
                    break
                pause = self.rng.uniform(*self.limited_wait)
            except Exception as e:  # noqa: BLE001  the row carries it
                error, pause = f"{type(e).__name__}: {e}", self.wait(attempt)
            if attempt + 1 < self.attempts:
                self.sleep(pause)
        return None, error


def ask(df: DataFrame, prompt: str, client: Client, policy: RetryPolicy | None = None, parallel: int = 8) -> DataFrame:
    """`df` with `reply` and `error`: one call a row, `parallel` of them at a time in each task. Rows with an empty prompt aren't sent. (M1, M6, M8)

    A failing row carries its error and stops no other. Calls are pure in their prompt: a task that runs again asks again.
    """
    policy = policy or RetryPolicy()

    def answers(prompts: list[str | None], pool: list) -> list[list]:
        from concurrent.futures import ThreadPoolExecutor

        one = lambda p: policy.call(lambda: client(p)) if p else (None, None)
        pool[:] = pool or [ThreadPoolExecutor(parallel)]
        got = list(pool[0].map(one, prompts))
        return [[g[0] for g in got], [g[1] for g in got]]

    return _with_columns(df, prompt, {"reply": "string", "error": "string"}, answers, 256)


def _with_columns(df: DataFrame, column: str, made: dict[str, str], make: Callable[[list, list], list], size: int) -> DataFrame:
    """`df` with the columns `made` (name to type), which `make` gets from `size` values of `column` at a time; it may keep things in a list for its task.

    The rest of a row stays in Arrow's form, so a worker holds one batch and so many values, not ten thousand whole texts a second and third time.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    at, names = df.columns.index(column), [*df.columns, *made]
    shape = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in made.items()]).schema
    kinds = [to_arrow_type(shape[c].dataType) for c in made]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kept: list = []
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                some = batch.slice(i, size)
                got = make(some.column(at).to_pylist(), kept)
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(list(v), t) for v, t in zip(got, kinds, strict=True)]], names=names)

    return df.mapInArrow(each, shape)


@dataclass(frozen=True)
class OperatorSpec:
    """A model operator: how a row becomes a prompt and a reply becomes columns."""

    name: str
    prompt: Callable[[dict[str, Column]], Column]
    parse: Callable[[Column], Column]

    def run(self, df: DataFrame, client: Client, policy: RetryPolicy | None = None) -> DataFrame:
        columns = {c: F.col(c) for c in df.columns}
        asked = ask(df.withColumn("__prompt", self.prompt(columns)), "__prompt", client, policy)
        return asked.withColumn(self.name, self.parse(F.col("reply"))).drop("__prompt")


SPECS = {
    s.name: s
    for s in (
        OperatorSpec("claim_flag", lambda c: text.template("Does this post make a claim? Reply in JSON with claim, confidence, evidence and reason.\nPost: {t}", t=text.truncate(c["text"], 1200)), lambda r: parse.claim_flag(parse.first_json_udf(r))),
        OperatorSpec("verdict", lambda c: F.concat(F.lit("Do these texts make one point? Reply Coherent or Incoherent.\n"), text.numbered(F.transform(c["texts"], lambda t: text.truncate(t, 2000)), "Text {i}: {x}")), parse.verdict),
        OperatorSpec("cluster_claim", lambda c: F.concat(F.lit("State in one sentence the claim that these texts share.\n"), text.numbered(F.transform(c["texts"], lambda t: text.truncate(t, 2500, True)), "- {x}")), text.one_sentence),
        OperatorSpec("toulmin", lambda c: text.template("Give claim, ground and warrant of the text as JSON.\nText: {t}", t=c["text"]), lambda r: parse.toulmin(parse.first_json_udf(r))),
        OperatorSpec("summary", lambda c: F.concat(F.lit("Name the topic of these claims and sum them up, as JSON with topic, summary, keywords.\n"), text.numbered(c["claims"])), parse.cluster_summary),
        OperatorSpec("topic_label", lambda c: F.concat(F.lit("Label the topic of these claims in three to six words.\n"), text.numbered(c["claims"], "- {x}")), text.collapse),
        OperatorSpec("validation", lambda c: text.template("Is the claim in the output supported by the text? Reply VALID or INVALID.\n{x}", x=c["input_text"]), lambda r: F.when(F.upper(r).contains("INVALID"), "INVALID").when(F.upper(r).contains("VALID"), "VALID")),
        OperatorSpec("judgement", lambda c: text.template("Score the claim against its source (0 or 1 each): atomicity, fluency, decontextualization, faithfulness; JSON with reasoning.\nSource: {s}\nClaim: {c}", s=c["source"], c=c["claim"]), parse.judge_scores),
        OperatorSpec("agrees", lambda c: text.template("Does the text make this claim? Reply Yes or No.\nText: {t}\nClaim: {c}", t=c["text"], c=c["claim"]), parse.yes_no),
    )
}


def topic_or_none(label: Column, cluster: Column) -> Column:
    """`Uncategorized` for noise. (M9)"""
    return F.when(cluster < 0, "Uncategorized").otherwise(label)


def relevance(df: DataFrame, client: Client, size: int = 20, policy: RetryPolicy | None = None, order: str = "row_index", value: str = "clean_text") -> DataFrame:
    """(order, relevance): one call for `size` rows, each text whole and on a line of its own. (M2, T5)"""
    from .relational import batches

    grouped = batches(df.select(order, value), size, order).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("items"))
    prompts = grouped.withColumn("__prompt", F.concat(F.lit("Mark each text RELEVANT or IRRELEVANT, one a line.\n"), text.numbered(F.transform("items", lambda x: text.collapse(x[value])))))
    labelled = ask(prompts, "__prompt", client, policy).withColumn("labels", parse.relevance_labels("reply", F.size("items")))
    return labelled.select(F.posexplode("items").alias("i", "item"), "labels").select(F.col(f"item.{order}").alias(order), F.get("labels", F.col("i")).alias("relevance"))


def assign(items: DataFrame, claims: list[dict], client: Client, size: int = 10, retries: int = 5, policy: RetryPolicy | None = None, order: str = "row_index") -> DataFrame:
    """Each item's claim by its number in a list: `size` items a call, the failed ones of a call asked again up to `retries` times.

    `claims` is the candidate list (cluster_id, cluster_claim, segment) of one prompt. Returns the items with the assignment columns.
    """
    from .relational import batches

    policy = policy or RetryPolicy()
    listed = "\n".join(f"{i}. [{c.get('segment', '')}] {c['cluster_claim']}" for i, c in enumerate(claims, 1))
    mark = re.compile(r"\s*(?:\[\d+\]|[-*]|\d+[)\].:])\s*")

    def number(line: str | None) -> int | None:
        found = re.match(r"\d+", mark.sub("", (line or "").strip(), count=1).strip())
        return int(found[0]) if found and 1 <= int(found[0]) <= len(claims) else None

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        lines_of = [" ".join((t or "").split()) for t in pdf["text"]]  # a text is one line of the prompt
        lines: dict[int, str | None] = {}
        todo = list(range(len(pdf)))
        for _ in range(retries + 1):
            if not todo:
                break
            asked = "\n".join(f"{k}. {lines_of[i]}" for k, i in enumerate(todo, 1))
            reply, _error = policy.call(lambda asked=asked: client(f"Claims:\n{listed}\nFor each text give the number of its claim, one a line.\n{asked}"))
            got = [x for x in (reply or "").splitlines() if x.strip()]
            if len(got) == 1 and len(p := [x.strip() for x in got[0].split(",") if x.strip()]) > 1:
                got = p
            got = (got + [None] * len(todo))[: len(todo)]
            for i, line in zip(todo, got, strict=True):
                if line is not None or i not in lines:
                    lines[i] = line
            todo = [i for i in todo if number(lines[i]) is None]
        numbers = [number(lines.get(i)) for i in range(len(pdf))]
        pick = lambda k: [claims[n - 1].get(k) if n else None for n in numbers]
        raw = [lines.get(i) for i in range(len(pdf))]
        return pdf.drop(columns="batch").assign(
            assigned_cluster_id=pick("cluster_id"), assigned_claim=pick("cluster_claim"), assigned_claim_segment=pick("segment"), llm_label=raw,
            assign_reason=["llm_claim_assign" if n else "llm_missing" for n in numbers], match_status=["matched" if n else "non_matching" if r else "no_output" for n, r in zip(numbers, raw, strict=True)],
        )

    shape = items.select("*", *[F.lit(None).cast("string").alias(c) for c in ("assigned_cluster_id", "assigned_claim", "assigned_claim_segment", "llm_label", "assign_reason", "match_status")]).schema
    return batches(items, size, order).groupBy("batch").applyInPandas(one, shape)


def sft_messages(instruction: str, user: Column, answer: Column) -> Column:
    """A training example as system, user and assistant messages."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(instruction)), turn("user", user), turn("assistant", answer))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _crc_utf8(crc: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Running CRC-32s, each with one character's UTF-8 bytes more."""
    step = lambda r, byte: _CRC[(r ^ byte) & 255] ^ (r >> 8)
    wide = codes >= 0x80
    if not wide.any():
        return step(crc, codes)
    lead = np.where(codes < 0x800, 0xC0 | codes >> 6, np.where(codes < 0x10000, 0xE0 | codes >> 12, 0xF0 | codes >> 18)).astype(np.uint32)
    crc = step(crc, np.where(wide, lead, codes))
    for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
        more = codes >= least
        crc[more] = step(crc[more], 0x80 | codes[more] >> shift & 0x3F)
    return crc


class HashEmbedder:
    """Character trigrams hashed with a sign into `size` dimensions, scaled to length 1: deterministic, needs no model. (V1)"""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, t in zip(out, texts, strict=True):
            codes = np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32)
            crc = np.full(len(codes) - 2, 0xFFFFFFFF, np.uint32)
            for k in range(3):
                crc = _crc_utf8(crc, codes[k : len(codes) - 2 + k])
            h = ~crc
            row += np.bincount(h % np.uint32(self.size), np.where(h >> 31, 1.0, -1.0), self.size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, column: str, embedder: Embedder | None = None, to: str = "vector", size: int = 256) -> DataFrame:
    """`df` with an embedding of a text column, `size` texts at a time; the embedder comes to each task once."""
    embedder = embedder or HashEmbedder()
    return _with_columns(df, column, {to: "array<float>"}, lambda texts, _: [np.asarray(embedder([t or "" for t in texts]), np.float32)], size)


class EchoClient:
    """An offline client: a fixed reply, or what a function makes of the prompt."""

    def __init__(self, reply: str | Callable[[str], str]):
        self.reply = reply

    def __call__(self, prompt: str) -> str:
        return self.reply(prompt) if callable(self.reply) else self.reply


class Scorer(Protocol):
    """Texts in, a value for each out: a rewrite, a perplexity, triplets. It is sent to the executors, so it must pickle. (M7)"""

    def __call__(self, texts: list[str]) -> list: ...


def score(df: DataFrame, column: str, scorer: Scorer, to: str, kind: str, size: int = 64) -> DataFrame:
    """`df` with a scorer's value of a text column, `size` texts at a time; the scorer comes to each task once. Null texts count as ''. (M7)"""
    return _with_columns(df, column, {to: kind}, lambda texts, _: [scorer([t or "" for t in texts])], size)


class TidyRewriter:
    """Offline stand-in for a grammar model: one blank between words, none before a mark, a capital first, a full stop last. (M7)"""

    def __call__(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            t = re.sub(r"\s+([,.;:!?])", r"\1", " ".join(t.split()))
            out.append(t[:1].upper() + t[1:] + ("" if not t or t[-1] in ".!?" else "."))
        return out


class CharPerplexity:
    """Offline stand-in for a language model: perplexity under character pairs of a few plain sentences. (M7)"""

    SENTENCES = "The people of the town say that the river is clean again. We hope that this will help all of them. There is more work to do, and they know it. Energy and climate are on the table today."

    def __init__(self):
        self.pairs: dict[str, int] = {}
        self.singles: dict[str, int] = {}
        for a, b in zip(self.SENTENCES, self.SENTENCES[1:], strict=False):
            self.pairs[a + b] = self.pairs.get(a + b, 0) + 1
            self.singles[a] = self.singles.get(a, 0) + 1

    def __call__(self, texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            bits = [np.log((self.pairs.get(a + b, 0) + 0.1) / (self.singles.get(a, 0) + 10)) for a, b in zip(t, t[1:], strict=False)]
            out.append(float(np.exp(-np.mean(bits))) if bits else 1.0)
        return out


class ClauseTriplets:
    """Offline stand-in for relation extraction: first and last word of each clause, linearised as a relation model would."""

    def __call__(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            clauses = [c.split() for c in re.split(r"[.!?;,]", t)]
            out.append(" ".join(f"<triplet> {c[0]} <subj> {c[-1]} <obj> {c[1]}" for c in clauses if len(c) > 2))
        return out
