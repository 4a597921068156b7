"""Text functions, each from Column to Column; all run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank for Python: Java's Unicode blanks and four control characters more.
SPACE = r"[\s\x1c-\x1f]"
# What cleaning removes.
URL_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "co", "st", "ly", "ca", "uk"]
EMOJI_RANGES = [
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x02702, 0x027B0), (0x024C2, 0x1F251),
]
PROMO = ["click here", "learn more", "for more info", "join us", "sign up", "subscribe", "visit our website"]

URL = rf"(?U)https?://[^\s]+|www\.[^\s]+|\b\w+\.(?:{'|'.join(URL_DOMAINS)})[^\s]*"
#: The last range also holds CJK, kana and Hangul.
EMOJI = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+"


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column | str) -> Column:
    """Runs of blanks as one, none at the ends; null as ''."""
    return F.trim(F.regexp_replace(_text(c), f"(?U){SPACE}+", " "))


def strip(c: Column | str) -> Column:
    """No blanks at the ends; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c.cast("string"), f"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize_label(c: Column | str) -> Column:
    """Collapsed and lower-cased."""
    return F.lower(collapse(c))


def clean_post(c: Column | str, promo: list[str] = PROMO) -> Column:
    """Lower-cased post without urls, mentions, hashtags, emoji and promotional phrases, blanks collapsed; null as ''."""
    steps = [URL, r"(?U)@\w+", r"(?U)#\w+", EMOJI, *map(re.escape, promo)]
    return collapse(reduce(lambda t, p: F.regexp_replace(t, p, ""), steps, F.lower(_text(c))))


def clean_claim(c: Column | str, mode: str = "intended") -> Column:
    """Text as it goes into clustering.

    intended: lower-cased, urls and emoji dropped, all but letters a-z, digits and blanks dropped, blanks collapsed. as_run: what
    double-escaped patterns did: lower-cased, each character but a-z, digits, `s` and the backslash becomes one blank, nothing collapses.
    """
    low = F.lower(_text(c))
    if mode == "as_run":
        return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\\s]", " "), r"\\s+", " "))
    if mode != "intended":
        raise ValueError(mode)
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, URL, " "), EMOJI, " "), rf"[^a-z0-9 \t\n\r]", " "))


def truncate(c: Column | str, most: int, collapsed: bool = False) -> Column:
    """At most `most` characters and ` …` where some are cut. (T4)"""
    t = collapse(c) if collapsed else F.coalesce(strip(_text(c)), F.lit(""))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(" …"))).otherwise(t)


def snippet(c: Column | str, width: int = 120) -> Column:
    """Whole words up to `width` characters, ` [...]` where some are cut."""
    t = collapse(c)
    head = F.regexp_extract(F.substring(t, 1, width - 5), r"^(.*?)(?:\s+\S*)?$", 1)
    return F.when(F.length(t) <= width, t).otherwise(F.trim(F.concat(head, F.lit(" [...]"))))


def strip_marks(c: Column | str) -> Column:
    """Without up to three asterisks and any quotes or backticks at either end."""
    t = F.regexp_replace(F.regexp_replace(strip(_text(c)), r"(?U)^\*{1,3}\s*", ""), r"(?U)\s*\*{1,3}$", "")
    return strip(F.regexp_replace(t, "^[`'\"“”‘’]+|[`'\"“”‘’]+$", ""))


def one_sentence(c: Column | str) -> Column:
    """A model's reply as one sentence: first line, no `claim:`, bullets or quotes, up to the first end mark with text behind it."""
    lines = F.filter(F.transform(F.split(_text(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    t = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    t = F.regexp_replace(t, r"(?i)^claim\s*:\s*", "")
    t = strip(F.regexp_replace(t, r"^[-•*\d).]+\s*", ""))
    for mark in '"', "'":
        t = F.regexp_replace(t, f"^{mark}+|{mark}+$", "")
    t = strip(t)
    first = F.regexp_extract(t, r"^(.+?[.!?])\s+.+$", 1)
    return F.when(first != "", strip(first)).otherwise(t)


def tokens(c: Column | str) -> Column:
    """Runs of a-z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z]+"), F.lit(0))


def count_char(c: Column | str, char: str) -> Column:
    """How often a character occurs."""
    t = _text(c)
    return F.length(t) - F.length(F.replace(t, F.lit(char), F.lit("")))


def count_where(c: Column | str, pattern: str, needed: Iterable[str]) -> Column:
    """Matches of a pattern; it is tried on texts that have one of the `needed` parts, without which it can't match."""
    t = _text(c)
    return F.when(reduce(or_, [F.contains(t, F.lit(x)) for x in needed]), F.regexp_count(t, F.lit(pattern))).otherwise(0)


def count_tags(c: Column | str, mark: str) -> Column:
    """Hashtags for `#`, mentions for `@`."""
    return count_where(c, rf"(?U){mark}\w+", mark)


def has_url(c: Column | str) -> Column:
    """Whether the text has an http or https url."""
    return _text(c).rlike("https?://")


def safe_name(c: Column | str) -> Column:
    """Fit for a file name."""
    return F.regexp_replace(_text(c), r"[^A-Za-z0-9_\-]+", "_")


def composite_id(group: Column | str, label: Column | str) -> Column:
    """`group_label`, or -1 for noise."""
    group, label = (F.col(x) if isinstance(x, str) else x for x in (group, label))
    return F.when(label == -1, F.lit("-1")).otherwise(F.concat_ws("_", group, label.cast("string")))


def numbered(items: Column | str, shape: str = "{i}. {x}") -> Column:
    """An array of texts as lines; `{i}` counts from 1, `{x}` is the text."""
    items = F.col(items) if isinstance(items, str) else items
    parts = re.split(r"(\{[ix]\})", shape)

    def line(x: Column, i: Column) -> Column:
        named = {"{i}": (i + 1).cast("string"), "{x}": x}
        return F.concat(*[named.get(p, F.lit(p)) for p in parts if p])

    return F.array_join(F.transform(items, line), "\n")


def template(shape: str, **values: Column | str) -> Column:
    """A prompt with `{name}` replaced by columns; nulls as ''."""
    parts = re.split(r"\{(\w+)\}", shape)
    return F.concat(*[_text(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def cid_of_lines(c: Column | str) -> Column:
    """The first `[cid=...]` of each line that has one."""
    found = F.transform(F.split(_text(c), "\n"), lambda x: F.regexp_extract(x, r"\[cid=([^\]]+)\]", 1))
    return F.filter(found, lambda x: x != "")


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    """Edit distance by the longer length, 0 for two empty texts."""
    a, b = _text(a), _text(b)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def pretty_feature(c: Column | str) -> Column:
    """A feature's name without its family."""
    return F.regexp_replace(_text(c), "^(?:liwc_|mfd2_|nrc_|vader_)", "")


#: Frequent words by language, for texts without a better detector.
STOP_WORDS = {
    "en": "the and of to in is that it for was with as are be this have from".split(),
    "fr": "le la les des et est que une dans pour qui sur pas avec ce".split(),
    "de": "der die das und ist nicht ein eine mit von zu den auf für sich".split(),
    "es": "el la los las que y en una por con para del es su como".split(),
}


def detect_language(c: Column | str, words: dict[str, list[str]] = STOP_WORDS) -> Column:
    """The language most of whose stop words the text has, null if none; ties by code."""
    # Each step is bound by a lambda, so it is made once a text: in nested conditions Spark would split the text anew for each mention. ASCII stands before
    # \w, which is slow to test.
    once = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    hits = F.filter(F.split(F.lower(_text(c)), r"(?U)[^a-z0-9_\w]+"), lambda w: w.isin(sorted({w for own in words.values() for w in own})))
    count = lambda found, own: F.size(F.filter(found, lambda w: w.isin(own)))
    ranked = lambda found: F.array_max(F.array(*[F.struct(count(found, own).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, own) in enumerate(sorted(words.items()))]))
    return once(once(hits, ranked), lambda best: F.when(best["n"] > 0, best["lang"]))


def keyword_pattern(keywords: list[str]) -> str | None:
    """One pattern for all keywords, any case, with word boundaries where a keyword begins or ends in a word character.

    Keywords with the same kinds of ends share a group, whose boundaries are then tested once.
    """
    groups: dict[tuple[bool, bool], list[str]] = {}
    for k in filter(None, keywords):
        groups.setdefault((bool(re.match(r"\w", k)), bool(re.search(r"\w\Z", k))), []).append(re.escape(k))
    sides = [f"{'(?<!\\w)' if left else ''}(?:{'|'.join(sorted(own))}){'(?!\\w)' if right else ''}" for (left, right), own in sorted(groups.items())]
    return "(?iu)(?U)" + "|".join(sides) if sides else None


def blocked(c: Column | str, keywords: list[str]) -> Column:
    """Whether the text has a keyword; false for null."""
    pattern = keyword_pattern(keywords)
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def is_empty_like(c: Column | str) -> Column:
    """Null or one of the words for nothing."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none", "null", "n/a", "na", "[]", "{}", "()", "empty")
