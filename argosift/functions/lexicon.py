"""Lexicons and the features that texts get from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _text, count_char, count_tags, count_where, has_url, tokens

# Word lists. In the moral foundations `*` stands for any ending.
MORAL_FOUNDATIONS = {
    "care.virtue": ["care*", "protect*", "safe*", "kind*", "compassion*", "nurtur*", "help*"],
    "care.vice": ["harm*", "hurt*", "cruel*", "brutal*", "suffer*", "victim*", "abus*"],
    "fairness.virtue": ["fair*", "justice", "equal*", "right*", "honest*", "impartial*"],
    "fairness.vice": ["unfair*", "injustice", "cheat*", "exploit*", "discriminat*", "bias*"],
    "loyalty.virtue": ["loyal*", "solidar*", "together", "united", "communit*", "patriot*"],
    "loyalty.vice": ["betray*", "traitor*", "disloyal*", "abandon*", "selfish*"],
    "authority.virtue": ["authorit*", "expert*", "law*", "rule*", "duty*", "obey*", "respect*"],
    "authority.vice": ["rebel*", "defy*", "subvert*", "lawless*", "corrupt*", "violat*"],
    "purity.virtue": ["pure*", "clean*", "natural*", "sacred*", "holy*", "healthy*"],
    "purity.vice": ["pollut*", "toxic*", "contaminat*", "dirty", "disgust*", "filth*"],
}
MODALS = ["can", "could", "may", "might", "must", "shall", "should", "will", "would", "ought"]
CALLS = ["join", "sign", "call", "contact", "vote", "act", "help", "stop", "support", "donate", "share", "fight", "demand", "urge", "write", "protect"]
PRONOUNS = ["he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their", "theirs", "i", "we", "me", "us", "my", "our"]
DEICTIC = ["this", "that", "these", "those", "here", "there", "now", "then", "today", "yesterday", "tomorrow", "currently", "recently", "soon", "aforementioned", "latter", "former"]
ENTITY_LABELS = ["ORG", "PERSON", "GPE", "LOC", "DATE", "MONEY", "PERCENT", "LAW"]


def parse_dic(content: str) -> dict[str, list[str]]:
    """A dictionary file: between two lines of `%` an id and a category a line, then words with ids."""
    names: dict[str, str] = {}
    words: dict[str, list[str]] = {}
    marks = 0
    for line in content.splitlines():
        parts = line.split()
        if not parts:
            continue
        if parts[0] == "%":
            marks += 1
        elif marks == 1 and len(parts) > 1:
            names[parts[0]] = parts[1]
        elif marks > 1:
            for i in parts[1:]:
                if i in names:
                    words.setdefault(names[i], []).append(parts[0].lower())
    return words


def read_dic(spark: SparkSession, path: str | None) -> dict[str, list[str]]:
    """The dictionary at `path`, read by Spark; the built-in moral foundations without a path or where it has no words."""
    parsed = parse_dic("\n".join(r[0] for r in spark.read.text(path).collect())) if path else {}
    return parsed or MORAL_FOUNDATIONS


def invert(pairs: DataFrame, word: str = "word", category: str = "category") -> DataFrame:
    """(category, words) from (word, category) rows."""
    return pairs.groupBy(category).agg(F.array_sort(F.collect_set(word)).alias("words"))


def _size(text: Column | str, made: Column | None) -> Column:
    return F.size(tokens(text)) if made is None else made["tokens"]


def _n(text: Column | str, made: Column | None) -> Column:
    return F.greatest(_size(text, made), F.lit(1))


def type_rates(text: Column | str, lexicon: dict[str, list[str]], prefix: str = "nrc_", made: Column | None = None) -> dict[str, Column]:
    """For each category, the distinct words of it in the text per 100 tokens. (L1)"""
    common = lambda k, v: F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, sorted(v))))) if made is None else made[prefix + k]
    return {prefix + k: common(k, v) / _n(text, made) * 100 for k, v in lexicon.items()}


def pattern_of(words: list[str]) -> str:
    """One pattern for a category's words and prefixes."""
    exact = sorted(w for w in words if not w.endswith("*"))
    stems = sorted(w[:-1] for w in words if w.endswith("*"))
    parts = ([f"(?:{'|'.join(stems)})[a-z]*"] if stems else []) + exact
    return f"^(?:{'|'.join(parts)})$" if parts else "^(?!)"


def any_pattern(words: list[str]) -> str:
    """One pattern for whole tokens that fit any of the words and prefixes; alternatives stand under their first letter, so few are tried."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(w[1:-1] + "[a-z]*" if w.endswith("*") else w[1:])
    return f"(?<![a-z])(?:{'|'.join(f'{k}(?:{chr(124).join(v)})' for k, v in sorted(by.items()))})(?![a-z])" if by else "(?!)"


def lexicon_hits(text: Column | str, lexicon: dict[str, list[str]] = MORAL_FOUNDATIONS) -> Column:
    """The tokens of a text that any category has, by one pass over it."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(any_pattern([w for v in lexicon.values() for w in v])), F.lit(0))


def token_rates(text: Column | str, lexicon: dict[str, list[str]] = MORAL_FOUNDATIONS, prefix: str = "mfd2_", made: Column | None = None) -> dict[str, Column]:
    """For each category, the tokens that fit any of its patterns per 100 tokens. (L2, L4)"""
    fitting = lambda k, v: F.size(F.filter(lexicon_hits(text, lexicon), lambda t: t.rlike(pattern_of(v)))) if made is None else made[_key(prefix + k)]
    return {prefix + k: fitting(k, v) / _n(text, made) * 100 for k, v in lexicon.items()}


def register_features(text: Column | str, made: Column | None = None) -> dict[str, Column]:
    """Word length, type-token ratio, word count (1 for none), rates per 100 words, url flag."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found, size, n = tokens(t), _size(t, made), _n(t, made)
    share = lambda k, words: (F.size(F.filter(found, lambda x: x.isin(words))) if made is None else made[k]) / n * 100
    letters, types = (F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x)), F.size(F.array_distinct(found))) if made is None else (made["letters"], made["types"])
    return {
        "avg_word_len": F.when(size > 0, letters / size).otherwise(0.0), "ttr": types / n, "n_words": n,
        "modal_rate": share("modals", MODALS), "imperative_rate": share("calls", CALLS), "question_rate": count_char(t, "?") / n * 100, "exclaim_rate": count_char(t, "!") / n * 100,
        "hashtag_rate": count_tags(t, "#") / n * 100, "mention_rate": count_tags(t, "@") / n * 100, "has_url": has_url(t).cast("int"),
    }


def readability(text: Column | str, made: Column | None = None) -> dict[str, Column]:
    """Flesch-Kincaid grade and Flesch reading ease; syllables are runs of vowels, so both are approximate."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    syllables = F.aggregate(tokens(t), F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "e$", ""), F.lit("[aeiouy]+")))) if made is None else made["syllables"]
    sentences = F.greatest(F.regexp_count(t, F.lit(r"[.!?]+(?:\s|$)")), F.lit(1))
    per_sentence, per_word = _size(t, made) / sentences, syllables / _n(t, made)
    return {"fk_grade": 0.39 * per_sentence + 11.8 * per_word - 15.59, "flesch_ease": 206.835 - 1.015 * per_sentence - 84.6 * per_word}


#: A small valence list; words from -1 to 1.
VALENCE = {w: v for v, words in ((0.6, "good great love best win safe hope happy strong better support benefit"), (-0.6, "bad worst hate fear crisis danger disaster wrong fail corrupt threat harm")) for w in words.split()}


def polarity(text: Column | str, valence: dict[str, float] = VALENCE, made: Column | None = None) -> dict[str, Column]:
    """Compound, positive, negative and neutral shares from a valence list: a plain stand-in for a rule-based scorer."""
    good, bad = ([w for w, v in valence.items() if (v > 0) == up] for up in (True, False))
    count = lambda k, words: F.size(F.filter(tokens(text), lambda x: x.isin(words))) if made is None else made[k]
    pos, neg, n = count("good", good), count("bad", bad), _n(text, made)
    raw = (pos - neg) * 0.6 * 4
    return {"vader_compound": raw / F.sqrt(raw * raw + 15), "vader_pos": pos / n, "vader_neg": neg / n, "vader_neu": (_size(text, made) - pos - neg) / n}


def entity_rates(text: Column | str, made: Column | None = None) -> dict[str, Column]:
    """A column for each entity label, null: no recogniser is at hand. Patterns give dates, money and percentages."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    known = {"MONEY": (r"[$€£]\s?[0-9][0-9.,]*", "$€£"), "PERCENT": (r"[0-9]+(?:\.[0-9]+)?\s?%", "%"), "DATE": (r"\b(?:19|20)[0-9]{2}\b", ("19", "20"))}
    count = lambda k: count_where(t, *known[k])
    return {f"ner_{k.lower()}": count(k) / _n(t, made) * 100 if k in known else F.lit(None).cast("double") for k in ENTITY_LABELS}


def stands_alone(text: Column | str) -> Column:
    """0 if a token is a pronoun or points to time or place, else 1."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0))
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS + DEICTIC))), 0).otherwise(1)


def fluent(original: Column, corrected: Column, before: Column, after: Column) -> Column:
    """1 unless a rewrite improves the text: same text, or perplexity not lower, or texts too far apart."""
    from .text import levenshtein_ratio

    same = original == corrected
    closer = (after < before) & (levenshtein_ratio(original, corrected) <= 0.2)
    return F.when(same, 1).when(closer, 0).otherwise(1)


def overlap_f1(claim: Column | str, source: Column | str) -> Column:
    """F1 of shared distinct tokens, null without a source: an offline stand-in for model-based faithfulness."""
    a, b = F.array_distinct(tokens(claim)), F.array_distinct(tokens(source))
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(b) > 0, 2 * common / F.greatest(F.size(a) + F.size(b), F.lit(1)))


#: Bytes of text whose tokens are held at a time.
BLOCK = 1 << 22
#: Letters in lower case, 0 for all other bytes.
_LOW = np.array([ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else 0 for b in range(256)], "uint8")
_VOWEL = np.array([chr(b) in "aeiouy" for b in range(256)], "bool")


def _key(name: str) -> str:
    return name.replace(".", "_")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and where each ends; the first of the ends is 0."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "int64")
    data = texts.buffers()[2]
    return (np.frombuffer(data, "uint8")[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, "uint8")), ends - ends[0]


def _syllables(words: pa.Array) -> np.ndarray:
    """Runs of vowels in each word of a-z, without an e at its end; at least 1."""
    data, ends = _bytes(words)
    if not len(data):
        return np.zeros(0, "int64")
    vowel = _VOWEL[data]
    run = vowel.copy()
    run[1:] &= ~vowel[:-1]
    run[ends[:-1]] = vowel[ends[:-1]]
    run[ends[1:] - 1] &= data[ends[1:] - 1] != ord("e")
    return np.maximum(np.add.reduceat(run, ends[:-1], dtype="int64"), 1)


def _block(texts: pa.Array, of_tokens: dict[str, list[str]], of_types: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """Counts a text of `texts`, which has no nulls: see `token_counts`."""
    n = len(texts)
    data, ends = _bytes(texts)
    for mark, low in ("\u0130", "i\u0307"), ("\u212a", "k"):  # the characters besides A-Z whose lower case has a letter a-z
        if mark.encode() in data.tobytes():
            data, ends = _bytes(texts := pc.replace_substring(texts, mark, low))
    low = _LOW[data]
    letter = low > 0
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    some = np.diff(ends) > 0
    for found, edge in (first, ends[:-1][some]), (last, ends[1:][some] - 1):  # a token ends with its text
        found[edge] = letter[edge]
    at = np.flatnonzero(first)
    lengths = np.flatnonzero(last) - at + 1
    bounds = np.searchsorted(at, ends)
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype="int64")))[bounds])
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], np.cumsum(lengths, dtype="int64")))), pa.py_buffer(low[letter])).dictionary_encode()
    codes, vocabulary = words.indices.to_numpy(), words.dictionary
    out = {"tokens": np.diff(bounds), "letters": total(lengths), "syllables": total(_syllables(vocabulary)[codes])}
    rows = np.repeat(np.arange(n), out["tokens"])
    pairs = np.sort(rows * max(len(vocabulary), 1) + codes)
    new = np.ones(len(pairs), "bool")
    new[1:] = pairs[1:] != pairs[:-1]
    out["types"] = total(new)
    fit = lambda words, by: by(words).to_numpy(zero_copy_only=False)
    regex = lambda v: lambda words: pc.match_substring_regex(words, pattern_of(v) if v else "^$")
    member = lambda v: lambda words: pc.is_in(words, pa.array(v, words.type))
    for lexicon, by, r, c in (of_tokens, regex, rows, codes), (of_types, member, *np.divmod(pairs[new], max(len(vocabulary), 1))):
        listed = fit(vocabulary, by([w for v in lexicon.values() for w in v]))  # few words are in any list; only these are held against each
        hit = np.flatnonzero(listed[c])
        r, c, few = r[hit], (np.cumsum(listed) - 1)[c[hit]], vocabulary.filter(pa.array(listed))
        out |= {k: np.bincount(r[fit(few, by(v))[c]], minlength=n) for k, v in lexicon.items()}
    return out


def token_counts(text: Column | str, of_tokens: dict[str, list[str]], of_types: dict[str, list[str]]) -> Column:
    """A struct of counts from one pass over the text: tokens, their letters, syllables and types, the tokens in each list of `of_tokens` and the types in each of `of_types`.

    Arrow: expressions over arrays are interpreted a token at a time, and made anew for each mention.
    """
    names = ["tokens", "letters", "syllables", "types", *of_tokens, *of_types]

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64")
            parts, start = [], 0
            while start < len(texts) or not parts:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
                made = _block(texts[start:stop], of_tokens, of_types)
                parts.append(pa.StructArray.from_arrays([pa.array(made[k], pa.int32()) for k in names], names))
                start = stop
            yield pa.concat_arrays(parts)

    return F.arrow_udf(each, ", ".join(f"`{k}` int" for k in names))(_text(text))


def tokenised(df: DataFrame, text: str = "text", types: dict[str, list[str]] | None = None) -> DataFrame:
    """`df` with __made, the counts that the features of a text need; `types` is a lexicon for `type_rates`."""
    good, bad = ([w for w, v in VALENCE.items() if (v > 0) == up] for up in (True, False))
    of_tokens = {"modals": MODALS, "calls": CALLS, "good": good, "bad": bad} | {_key("mfd2_" + k): v for k, v in MORAL_FOUNDATIONS.items()}
    return df.withColumn("__made", token_counts(text, of_tokens, {"nrc_" + k: v for k, v in (types or {}).items()}))


def all_features(text: Column | str, made: Column | None = None) -> dict[str, Column]:
    """Every feature of a text in one projection; `made` is the column of `tokenised`, where it is at hand."""
    return reduce(lambda a, b: a | b, [register_features(text, made), readability(text, made), token_rates(text, made=made), polarity(text, made=made), entity_rates(text, made)])
