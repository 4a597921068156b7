"""Language ID by bit-sliced Bloom filters: one lookup tells for an n-gram all the languages that contain it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

_HASHES = 3
#: Languages that a model may tell apart.
MOST_LANGUAGES = 1000


def _grams(text: str, n: int) -> np.ndarray:
    """A 64-bit hash for each character n-gram of the lower-cased letters; what isn't a letter counts as one blank."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = ((x >= 97) & (x <= 122)) | (x >= 0xC0) & (x != 0xD7) & (x != 0xF7) & ~((x >= 0x2000) & (x <= 0x2BFF))
    x = np.where(letter, x, 32).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1]
    x = np.concatenate(([np.uint64(32)], x[keep], [np.uint64(32)]))
    if len(x) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(x) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


class BloomLanguages:
    """Language-bitmask n-gram filters.

    Slot s of the table holds a bit for each language whose filter has s set; the languages of an n-gram are the AND of its three
    slots. A language's filter takes the n-grams found in at least `least` of its sample texts and in a share of them not below 1/`rare` of
    the greatest share in any language. For a text the bits are counted by language and corrected for the filters' false positives,
    as (share - rate) / (1 - rate); the largest wins, ties by language name. The score is its share of all languages' sum.
    Null texts and those without a letter are `und` with score 0, and so is all else where nothing was learned.
    """

    def __init__(self, sample: list[tuple[str, str]], n: int = 4, bits: int = 21, least: int = 2, rare: float = 8.0):
        self.n, self.bits = n, bits
        self.languages = sorted({lang for _, lang in sample})
        seen = []
        for lang in self.languages:
            texts = [t for t, x in sample if x == lang]
            grams, counts = np.unique(np.concatenate([np.unique(_grams(t, n)) for t in texts]), return_counts=True)
            many = counts >= min(least, len(texts))
            seen.append((grams[many], counts[many] / len(texts)))
        every = np.unique(np.concatenate([g for g, _ in seen])) if seen else np.empty(0, np.uint64)
        most = np.zeros(len(every))
        for g, share in seen:
            np.maximum.at(most, np.searchsorted(every, g), share)
        self.words = (len(self.languages) + 63) // 64
        self.table = np.zeros((max(self.words, 1), 1 << bits), np.uint64)
        self.rates = []
        for k, (g, share) in enumerate(seen):
            g = g[share * rare >= most[np.searchsorted(every, g)]]
            bit = np.uint64(1) << np.uint64(k % 64)
            for slot in self._slots(g):
                self.table[k // 64][slot] |= bit
            self.rates.append(float(((self.table[k // 64] & bit) != 0).mean() ** _HASHES))

    def _slots(self, grams: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            step = (grams * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
            return [((grams + np.uint64(i) * step) >> np.uint64(64 - self.bits)).astype(np.int64) for i in range(_HASHES)]

    def corrected(self, text: str) -> np.ndarray:
        """For each language the share of the text's n-grams that it contains, corrected for false positives."""
        slots = self._slots(_grams(text, self.n))
        total = max(len(slots[0]), 1)
        shares = np.zeros(len(self.languages))
        for w in range(self.words):
            mask = self.table[w][slots[0]] & self.table[w][slots[1]] & self.table[w][slots[2]]
            inside = range(w * 64, min(len(self.languages), w * 64 + 64))
            if len(inside) <= 8:
                held = np.bincount(mask.astype(np.uint8), minlength=256)
                for k in inside:
                    shares[k] = held[(np.arange(256) >> (k % 64)) & 1 == 1].sum() / total
            else:
                for k in inside:
                    shares[k] = np.count_nonzero(mask & (np.uint64(1) << np.uint64(k % 64))) / total
        rates = np.array(self.rates)
        return np.clip((shares - rates) / np.maximum(1 - rates, 1e-9), 0, None)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        c = self.corrected(text)
        best = int(np.argmax(c))
        return self.languages[best], float(c[best] / c.sum()) if c.sum() > 0 else 1 / len(c)

    @classmethod
    def fit(cls, docs: DataFrame, modulus: int = 4, held: int = 2, most: int = 1000) -> BloomLanguages:
        """Fitted on about `most` different texts a language outside the held-out fold, those least by a hash of id and text.

        One pass counts the languages, one takes from each the share of its rows that gives `most` of them in the mean. Equal rows are
        drawn as one, so neither a null id nor a text with many copies can fill the sample. More than `MOST_LANGUAGES` values of lang are an error.
        """
        known = docs.select(F.col("doc_id").cast("string").alias("__id"), F.col("text").cast("string").alias("__text"), F.col("lang").cast("string").alias("__lang"))
        known = known.filter(F.col("__lang").isNotNull() & F.col("__text").isNotNull() & (fold("__id", modulus) != held))
        counts = {r[0]: r[1] for r in known.groupBy("__lang").count().limit(MOST_LANGUAGES + 1).collect()}
        if not counts:
            return cls([])
        if len(counts) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages: a filter holds a bit for each")
        cuts = docs.sparkSession.createDataFrame([(x, int(min(1.0, most / n) * (2**31 - 1))) for x, n in counts.items()], "__lang string, cut long")
        place = F.xxhash64(F.coalesce("__id", F.lit("")), "__text")
        drawn = known.withColumn("place", place).join(F.broadcast(cuts), "__lang").filter(F.col("place").bitwiseAND(2**31 - 1) <= F.col("cut"))
        drawn = drawn.groupBy("__lang", "place").agg(F.min("__text").alias("__text"))
        return cls(sorted((r[0], r[1]) for r in drawn.select("__text", "__lang").collect()))

    def score(self, docs: DataFrame, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
        """`docs` with the predicted language and its score, in the place of any columns of those names."""
        docs = docs.drop(*to)
        at = docs.columns.index(text)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [self.predict(t) for t in batch.column(at).to_pylist()]
                new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *to])

        return docs.mapInArrow(each, docs.select("*", F.lit("").alias(to[0]), F.lit(0.0).alias(to[1])).schema)
