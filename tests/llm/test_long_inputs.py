"""Long inputs take time in proportion to their length: each case would take hours or run out of memory in a form that is quadratic."""

import random
import time

import pytest

from argosift.llm.pii import PiiFinder, find_pii
from argosift.llm.secrets import find_secrets
from argosift.llm.urls import judge_urls

from . import brute

DOCS = "doc_id long, text string"
_RNG = random.Random(5)
_KEYS = [f"token={''.join(_RNG.choices('abcdef0123456789', k=8))}" for _ in range(1000)]
_MIXED = ["".join(_RNG.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=28)) for _ in range(1000)]


def test_secrets_in_one_text(spark):
    keys = " ".join(_KEYS * 100)
    began = time.time()
    got = find_secrets(spark.createDataFrame([(1, keys)], DOCS)).first()
    assert got.n_assign == 100_000 and got.base_sha256 == brute.sha(",".join(brute.secrets(keys)))
    assert time.time() - began < 90


def test_random_runs_in_one_text(spark):
    text = " ".join(a + " " + b for a, b in zip(_MIXED * 20, _KEYS * 20, strict=True))
    began = time.time()
    got = find_secrets(spark.createDataFrame([(1, text)], DOCS)).first()
    assert got.n_assign == 20_000 and got.n_random > 19_000
    assert all(s.split(":")[0] in ("assign", "random") for s in got.spans.split(","))
    assert time.time() - began < 150


@pytest.mark.parametrize("text", ["7" * 200_000, "7." * 100_000, "+1" + "(" * 200_000, "1" * 100_000 + "." + "2" * 100_000, "a" * 200_000 + "@", "account 1234567 a@b.co https://u:p@h.de " * 5000], ids=["digits", "dots", "brackets", "two", "local", "cues"])
def test_personal_data_in_one_text(text):
    began = time.time()
    PiiFinder().spans(text)
    assert time.time() - began < 20
    names = ("email", "ip", "card", "phone")
    for cut in (text[:3000], text[-3000:]):  # the plain scan is quadratic
        assert [f"{names[k]}:{a}:{b}" for a, b, k in PiiFinder().spans(cut) if k < 4] == brute.personal(cut)


def test_added_spans_stay_apart():
    """Against all pairs of spans."""
    rng = random.Random(8)
    bits = ["account 12345678", "IBAN DE89 3704 0044 0532 0130 00", "SSN 123-45-6789", "https://me:pw@h.example/x", " ", "a@b.co", "+1 555 010 9999", "4111111111111111", "x", "konto ", "10.0.0.1"]
    for _ in range(300):
        spans = PiiFinder().spans("".join(rng.choice(bits) for _ in range(rng.randint(1, 14))))
        base, extra = [s for s in spans if s[2] < 4], [s for s in spans if s[2] >= 4]
        for i, (a, b, k) in enumerate(extra):
            assert all(y <= a or b <= x for x, y, _ in extra[:i])
            assert all(y <= a or b <= x or k == 6 and a <= x and y <= b for x, y, _ in base)


def test_personal_data_as_rows(spark):
    got = find_pii(spark.createDataFrame([(1, "7" * 200_000), (2, None)], DOCS)).collect()
    assert [r.n_ip + r.n_card for r in got] == [0, 0]


def test_long_host_and_path(spark):
    host = "a." * 50_000
    urls = [(1, f"http://{host}example.com/de/{'p/' * 50_000}"), (2, f"http://{host}net"), (3, f"http://{host}net/")]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert got == {1: ("example.com/de/", "block"), 2: (None, "allow"), 3: ("net/", "block")}
    assert time.time() - began < 60
