"""Scores of fitted models against plain loops over the same parameters; targets of the mix against another algorithm."""

import math
import random
import re
import secrets as tokens
import sys

import pytest
import zstandard

from argosift.llm.language import BloomLanguages, _grams
from argosift.llm.mixing import Mixer, _targets
from argosift.llm.quality import CompressionQuality
from argosift.llm.secrets import ALPHABET, MarkovSecrets, find_secrets
from argosift.llm.toxicity import SubwordToxicity

MASK = (1 << 64) - 1
TEXTS = ["", None, "a", "You absolute nincompoop, go away!", "The river bends. " * 40, "é ß $hit 1999 w0rds " * 9, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen nincompoop fifteen"]


def logistic(model, x):
    z = model.coef[0] + sum(c * max(-8.0, min(8.0, (v - m) / s)) for c, v, m, s in zip(model.coef[1:], x, model.mean, model.std, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def toxic_by_hand(model, text):
    """Words as runs of the kept bytes with a blank on either side, their 3- to 5-grams hashed byte by byte."""
    raw = b" " + (text or "").lower().encode("utf-8", "replace") + b" "
    kept = set(b"0123456789abcdefghijklmnopqrstuvwxyz*@$") | set(range(128, 256))
    plain = bytes(c if c in kept else 32 for c in raw)
    values = []
    for m in re.finditer(rb"[^ ]+", plain):
        word, got = b" " + m[0] + b" ", []
        for n in (3, 4, 5):
            for i in range(len(word) - n + 1):
                h = word[i] * 0x9E3779B97F4A7C15 & MASK
                for k in range(1, n):
                    h = (h ^ word[i + k]) * 0x9E3779B97F4A7C15 & MASK
                    h ^= h >> 29
                got.append(float(model.table[(h * (0xBF58476D1CE4E5B9 + 2 * (n - 1)) & MASK) >> (64 - model.bits)]))
        values.append(sum(got) / max(len(got), 1))
    w = model.window
    if not values:
        x = (0.0, 0.0, 0.0)
    elif len(values) <= w:
        mean = sum(values) / len(values)
        x = (mean, mean, sum(sorted(values)[-2:]) / len(values[-2:]))
    else:
        means = [sum(values[i : i + w]) / w for i in range(len(values) - w + 1)]
        top = max(range(len(means)), key=lambda i: means[i])
        apart = [v for i, v in enumerate(means) if abs(i - top) >= w]
        x = (means[top], max(apart, default=means[top]), sum(sorted(values)[-2:]) / 2)
    return logistic(model.model, x)


def test_toxicity():
    sample = [(f"a fine text about {w} and more of it", 0) for w in "rivers birds stones trees clouds roads songs boats".split()] * 4 + [(f"you {w} are a blithering nincompoop today", 1) for w in "rivers birds stones trees clouds roads songs boats".split()] * 4
    model = SubwordToxicity(sample)
    assert list(model.scores(TEXTS)) == pytest.approx([toxic_by_hand(model, t) for t in TEXTS], abs=1e-6)


def test_quality():
    sample = [("The river bends slowly towards the sea and the birds follow it. " * 4, 1), ("Stones lie on the road; the boat waits by the trees. " * 5, 1), ("buy now!!! $$$ click $$$ buy now!!! " * 9, 0), ("%%% ### %%% ### win win win %%% " * 9, 0)] * 6
    model = CompressionQuality(sample)

    def by_hand(text):
        raw = (text or "").encode()
        bad, good = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw)) for d in model.dictionaries)
        plain, n = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw)), len(raw) + 16
        x = [(bad - good) / plain, (bad - good) / n, math.log(plain / n), math.log(good / n), math.log(bad / n), math.log(n)]
        return logistic(model.model, x + [v * v for v in x[:4]] + [x[0] * x[2]])

    assert list(model.scores(TEXTS)) == pytest.approx([by_hand(t) for t in TEXTS], abs=1e-9)


def test_language_filters_hold_all_and_little_else():
    """Against sets of the n-grams themselves: none is missing, strangers pass as rarely as the rate says."""
    texts = [("the birds and the river in the town", "en"), ("der Vogel und die Stadt mit dem Fluss", "de"), ("la ville et les oiseaux dans la rue", "fr")]
    model = BloomLanguages(texts * 3, bits=10)
    for k, lang in enumerate(model.languages):
        own = {int(g) for t, x in texts if x == lang for g in _grams(t, 4)}
        inside = lambda g, k=k: all(int(model.table[0][int(s[0])]) >> k & 1 for s in model._slots(g))  # noqa: B023
        import numpy as np

        shared = {g for g in own if sum(g in {int(y) for y in _grams(t, 4)} for t, _ in texts) == 1}
        assert all(inside(np.array([g], np.uint64)) for g in shared)
        rng = np.random.default_rng(3)
        strangers = [g for g in rng.integers(0, 1 << 63, 4000, dtype=np.uint64) if int(g) not in own]
        assert sum(inside(np.array([g], np.uint64)) for g in strangers) / len(strangers) == pytest.approx(model.rates[k], abs=0.01)
    assert [model.predict(t)[0] for t, _ in texts] == ["en", "de", "fr"]


def test_language_sample_is_bounded(spark):
    """One row in most of a language's rows, null ids in others: the draw takes each text once."""
    rows = [(None, f"der Text Nummer {i} mit einem Fluss", "de") for i in range(300)] + [(7, "the same words again and again", "en")] * 900 + [(i, f"a text about the number {i} here", "en") for i in range(300)]
    model = BloomLanguages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=50)
    assert model.languages == ["de", "en"] and model.predict("der Fluss mit einem Text")[0] == "de" and model.predict("about the words again")[0] == "en"


def level(sizes, weights, total, most):
    """Targets by the water level: the break points of sum(min(most * size, weight * level)) in order."""
    caps = [most * s for s in sizes]
    points = sorted((c / w, i) for i, (c, w) in enumerate(zip(caps, weights, strict=True)))
    filled, free = 0.0, sum(weights)
    for at, i in points:
        if filled + free * at >= total:
            return [min(c, w * (total - filled) / free) for c, w in zip(caps, weights, strict=True)]
        filled, free = filled + caps[i], free - weights[i]
    return [float(c) for c in caps]


def test_targets_by_the_water_level():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.choice((0, 1, rng.randint(1, 50), rng.randint(1, 10**6))) for _ in range(rng.randint(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        total = 1.5 * sum(sizes)
        assert _targets(sizes, weights, total, 2) == pytest.approx(level(sizes, weights, total, 2), abs=1e-6 * (total + 1))


def test_too_many_sources(spark):
    df = spark.range(30).selectExpr("id as doc_id", "'a b' as text", "cast(id as string) as source")
    with pytest.raises(ValueError, match="sources"):
        Mixer(most_sources=20).report(df)
    assert Mixer(most_sources=30).report(df).count() == 30


def test_secrets_on_names_of_the_standard_library(spark):
    """Real identifiers and tokens made by others than the training generator."""
    names = set(sys.stdlib_module_names)
    import argparse, asyncio, email.message, http.server, logging.handlers, socket, ssl, tkinter.constants, unittest.mock, urllib.request, xml.sax.handler  # noqa: E401, F401

    for module in (argparse, asyncio, email.message, http.server, logging.handlers, socket, ssl, unittest, unittest.mock, urllib.request, xml.sax.handler):
        for k, v in vars(module).items():
            names |= {k, f"{module.__name__.replace('.', '/')}/{k}"} | (set(dir(v)) if isinstance(v, type) else set())
    names = sorted(n for n in names if len(n) >= 20 and set(n) <= set(ALPHABET))
    keys = [tokens.token_urlsafe(n) for n in (16, 24, 32) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(f"see {s} here" for s in names + keys)), "doc_id long, text string")
    found = {r.doc_id: r.n_random > 0 for r in find_secrets(df, MarkovSecrets.default(spark)).collect()}
    assert len(names) > 500 and sum(found[i] for i in range(len(names))) / len(names) < 0.01
    assert sum(found[i] for i in range(len(names), len(found))) / len(keys) > 0.95
