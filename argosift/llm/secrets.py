"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers. DataFrame operations only."""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Kinds in their order: pattern, what its length counts from (the value's group), and the least length.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the limit can't hold or hide a match of these two, so the limit stands in the pattern.
_ACCESS, _HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
_TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Spans of these two, with what overlaps of them.
_ACCESS_OR_HEX = rf"[0-9a-f]*{_ACCESS}[0-9a-f]*|{_HEX}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Characters that are judged by themselves in a longer run, and the least share of neighbours that differ in case in a whole run and in
#: a stretch: short words joined with capitals reach a third.
STRETCH, CHANGES, STRETCH_CHANGES = 20, 0.3, 0.4

_PARTS = "get set user name list map index count value total buffer stream reader writer handler manager factory config service client server request response parse format table column query filter order group window state cache token key session request path file folder update delete insert create build load store thread queue worker task event message error result status number string object array vector matrix model train layer batch sample source target output input default internal external abstract interface controller listener adapter process resource container".split()


def labelled_strings(n: int = 4000, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled samples, the same on every call: 1 for random strings (letters and digits, base64, hex in either case), 0 for identifiers joined of words."""
    rng, out = random.Random(seed), []
    letters, hexa = ALPHABET[:62], "0123456789abcdef"
    for i in range(n):
        size = rng.randint(20, 48)
        out.append(("".join(rng.choice((letters, ALPHABET[:64], hexa, letters[26:], hexa.upper())[i % 5]) for _ in range(size)), 1))
        words = [rng.choice(_PARTS) for _ in range(rng.randint(3, 6))]
        shapes = ("_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(), "".join(words), "/".join(words), "_".join(words) + f"_{rng.randint(1, 2030)}", "".join(w.title() for w in words))
        out.append((shapes[i % 8], 0))
    return out


#: Spans whose places are summed up in one array; longer lists are put together of such blocks, so that no array is copied for each match.
_BLOCK = 256


def _spread(items: Column, texts: Column, kind: str, keep: Column | None = None) -> Column:
    """Spans of the matches `items` of a text that parts into the pieces `texts` around them, in time proportional to their number."""
    lengths = F.zip_with(texts, items, lambda t, m: F.struct(F.coalesce(F.length(t), F.lit(0)).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))

    def block(xs: Column) -> Column:
        """The block's length, and its spans as if the text began with it."""
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
        return F.aggregate(xs, start, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["own"]).alias("at"),
            F.when(x["own"] > 0, F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["own"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ))

    def joined(blocks: Column) -> Column:
        """The spans of all blocks, moved to where their block begins."""
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
        begins = F.aggregate(blocks, start, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
        move = lambda x, at: F.transform(x["spans"], lambda s: F.struct((s["start"] + at).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s["end"] + at).alias("end")))
        return F.flatten(F.zip_with(blocks, begins, move))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda k: block(F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK))))
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  what a lambda gets is made once
    spans = once(once(lengths, cut), joined)
    if keep is not None:
        spans = F.transform(F.filter(F.zip_with(spans, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"])
    return spans


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """An array of (start, kind, end) of the leftmost non-overlapping matches, in code points; `keep` maps matches to booleans."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    items = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _spread(items, F.split(text, pattern, -1), kind, keep(items) if keep is not None else None)
    return F.when(text.rlike(pattern), found).otherwise(none)


def _without(text: Column, pattern: str, keep=None) -> Column:
    """The text with line breaks in the place of its matches, for those that `keep` maps to true; its length stays."""
    items = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    goes = keep(items) if keep is not None else F.transform(items, lambda m: F.lit(True))
    filled = F.zip_with(items, goes, lambda m, k: F.when(k, F.repeat(F.lit("\n"), F.length(m))).otherwise(m))
    pieces = F.zip_with(F.split(text, pattern, -1), filled, lambda t, m: F.concat(t, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


class MarkovSecrets:
    """First-order character models of random strings and of identifiers, as one table of log-likelihood ratios by character pair.

    Trained by counting pairs in labelled samples, with add-one smoothing, in DataFrame operations. The table has as many
    cells as pairs of the alphabet (67 x 67), whatever the sample's size, and becomes a literal of the query.
    A string's ratio is the mean over its pairs; at `least` nats or more it counts as random. So does a string with a stretch of
    STRETCH characters at `stretch` nats or more, behind a name for instance; the best of many stretches needs the higher bound.
    """

    def __init__(self, samples: DataFrame, least: float = 0.9, stretch: float = 1.3):
        """samples: (sample string, label int), 1 for random. Null rows are left out."""
        n = len(ALPHABET)
        strings = samples.filter("sample is not null and label is not null and length(sample) > 1").select("label", "sample")
        pairs = strings.select("label", "sample", F.explode(F.expr("sequence(1, length(sample) - 1)")).alias("i")).select("label", F.expr("substring(sample, i, 1)").alias("a"), F.expr("substring(sample, i + 1, 1)").alias("b"))
        counts = pairs.select("label", F.instr(F.lit(ALPHABET), F.col("a")).alias("a"), F.instr(F.lit(ALPHABET), F.col("b")).alias("b")).filter("a > 0 and b > 0").groupBy("label", "a", "b").count()
        # Each sample has a row for every pair: the cells number 2 * 67 * 67 at most.
        got = {(r[0], r[1], r[2]): r[3] for r in counts.collect()}
        import math

        totals = {(y, a): sum(got.get((y, a, b), 0) for b in range(1, n + 1)) for y in (0, 1) for a in range(1, n + 1)}
        rate = lambda y, a, b: math.log((got.get((y, a, b), 0) + 0.5) / (totals[y, a] + 0.5 * n))
        self.table = [rate(1, a, b) - rate(0, a, b) for a in range(1, n + 1) for b in range(1, n + 1)]
        self.least, self.stretch = least, stretch

    @classmethod
    def default(cls, spark: SparkSession) -> MarkovSecrets:
        rows = ", ".join(f"('{s}', {y})" for s, y in labelled_strings())
        return cls(spark.sql(f"SELECT * FROM VALUES {rows} AS t(sample, label)"))

    def ratio(self, string: Column) -> Column:
        """Mean log-likelihood ratio of a string of the alphabet, random against identifier; at least two characters."""
        n = len(ALPHABET)
        cells = F.from_json(F.lit(json.dumps([round(x, 4) for x in self.table])), "array<double>")
        codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        codes = F.filter(codes, lambda c: c > 0)
        walk = F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), lambda a, c: F.struct(
            c.alias("last"), (a["sum"] + F.when(a["last"] > 0, F.get(cells, (a["last"] - 1) * n + c - 1)).otherwise(0.0)).alias("sum"),
        ), lambda a: a["sum"])
        return walk / F.greatest(F.length(string) - 1, F.lit(1))

    def looks_random(self, string: Column) -> Column:
        """Above the ratio, and with a digit and a letter or of letters that change case often: the whole or a stretch of it."""
        mixed = string.rlike("[0-9]") & string.rlike("[A-Za-z]")
        changes = F.regexp_count(string, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) >= CHANGES * (F.length(string) - 1)
        return ((mixed | changes) & (self.ratio(string) >= self.least)) | (string.rlike("[0-9]|[a-z][A-Z]|[A-Z][a-z]") & self._stretch(string))

    def _stretch(self, string: Column) -> Column:
        """Whether STRETCH characters in a row are above their ratio and mixed or changing. One walk: sums take the next pair in and the last one out."""
        n, pairs = len(ALPHABET), STRETCH - 1
        cells = F.from_json(F.lit(json.dumps([round(x, 4) for x in self.table])), "array<double>")
        codes = F.filter(F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda c: c > 0)
        of = lambda test: F.coalesce(test.cast("int"), F.lit(0))
        score = lambda a, b: F.coalesce(F.get(cells, (a - 1) * n + b - 1), F.lit(0.0))
        change = lambda a, b: of((a <= 26) & b.between(27, 52) | a.between(27, 52) & (b <= 26))
        digit, letter = (lambda c: of(c.between(53, 62))), (lambda c: of(c <= 52))

        def walk(cs: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                a, b, c, d = (F.get(cs, k) for k in (i - 1, i, i - pairs - 1, i - pairs))  # a and b come in, c goes out, d stood behind it
                c_d = lambda f, zero: F.when(c.isNull(), F.lit(zero)).otherwise(f(c, d))
                total, turns = s["total"] + score(a, b) - c_d(score, 0.0), s["turns"] + change(a, b) - c_d(change, 0)
                digits, letters = s["digits"] + digit(b) - digit(c), s["letters"] + letter(b) - letter(c)
                fits = (i >= pairs) & (total >= self.stretch * pairs) & ((digits > 0) & (letters > 0) | (turns >= STRETCH_CHANGES * pairs))
                return F.struct(total.alias("total"), turns.alias("turns"), digits.alias("digits"), letters.alias("letters"), (s["hit"] | fits).alias("hit"))

            start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("turns"), F.lit(0).alias("digits"), F.lit(0).alias("letters"), F.lit(False).alias("hit"))
            return F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), start, step, lambda s: s["hit"])

        return F.get(F.transform(F.array(codes), walk), 0)


def find_secrets(docs: DataFrame, model: MarkovSecrets | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), a row for each row of `docs`.

    spans lists kind:start:end by start, then kind, in code points with an exclusive end. `random` spans are the method's own: runs
    of 20 or more characters of the base64 alphabet, outside the base spans, that the Markov models take for random, as a whole or in a
    stretch of 20; the span is the whole run's. What is left of a run beside a base span is a run of its own.
    Null texts count as empty. Repeated rows and null ids stay. Columns besides doc_id and text don't matter. The time a text takes is
    in proportion to its length and matches.
    """
    model = model or MarkovSecrets.default(docs.sparkSession)
    text = F.col("text")
    long_value = lambda items: F.transform(items, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 1)) >= 6)
    found = docs.select("doc_id", text_of().alias("text"))
    found = found.withColumn("rest", F.when(text.rlike(_TOKEN), _without(_without(text, _ASSIGN, long_value), _ACCESS_OR_HEX)).otherwise(F.lit("")))
    found = found.select("doc_id", _spans(text, _ASSIGN, "assign", long_value).alias("s0"), _spans(text, _ACCESS, "access").alias("s1"), _spans(text, _HEX, "hex").alias("s2"),
                         _spans(F.col("rest"), _TOKEN, "random", lambda items: F.transform(items, model.looks_random)).alias("added"))
    found = found.select("*", F.array_sort(F.concat("s0", "s1", "s2")).alias("base"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda c: F.size(c).cast("long")
    return found.select("doc_id", count("s0").alias("n_assign"), count("s1").alias("n_access"), count("s2").alias("n_hex"), count("added").alias("n_random"),
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
