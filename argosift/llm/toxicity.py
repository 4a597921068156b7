"""Toxicity by subword-bag embeddings: hashed character n-grams averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .fitting import Logistic, labelled_sample

_SIZES = (3, 4, 5)
#: Training steps over whole texts, and then between looks for the passages.
_WHOLE, _LOOK = 6, 3
_SPACE = np.ones(256, bool)
_SPACE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("*"), ord("@"), ord("$"), *range(128, 256)]] = False


def _subwords(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where words start and end in the bytes of the lower-cased text, and a bucket for each byte n-gram of each size.

    A word's n-grams take in one blank on either side, which marks its ends.
    """
    raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace") + b"     ", np.uint8)
    blank = _SPACE[raw]
    turn = np.flatnonzero(np.diff(~blank, prepend=False, append=False))
    x = np.where(blank, 32, raw).astype(np.uint64)
    buckets = []
    with np.errstate(over="ignore"):
        h = x[:-4] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, 5):
            h = (h ^ x[k : len(x) - 4 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k + 1 in _SIZES:
                buckets.append((h * np.uint64(0xBF58476D1CE4E5B9 + 2 * k) >> np.uint64(64 - bits)).astype(np.int32))
    return turn[::2], turn[1::2], buckets


def _word_values(starts: np.ndarray, ends: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """The mean, over each word's n-grams, of a value for each n-gram position."""
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for n, v in zip(_SIZES, values, strict=True):
        sums = np.concatenate(([0.0], np.cumsum(v, dtype=np.float64)))
        last = np.maximum(ends + 2 - n, starts - 1)
        total += sums[last] - sums[starts - 1]
        count += last - starts + 1
    return total / np.maximum(count, 1)


class _Bag:
    """The words of many texts and their subwords' buckets, end to end."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]):
        base = np.cumsum([0, *(len(p[2][0]) for p in parts)])
        self.starts, self.ends = (np.concatenate([p[k] + at for p, at in zip(parts, base[:-1], strict=True)]) for k in (0, 1))
        self.buckets = [np.concatenate([p[2][k] for p in parts]) for k in range(len(_SIZES))]
        self.sizes = np.array([len(p[0]) for p in parts])
        self.doc = np.repeat(np.arange(len(parts)), self.sizes)
        self.last = [np.maximum(self.ends + 2 - n, self.starts - 1) for n in _SIZES]
        self.grams = np.maximum(sum(last - self.starts + 1 for last in self.last), 1)

    def values(self, table: np.ndarray) -> np.ndarray:
        """Each word's value: the mean of its subwords'."""
        return _word_values(self.starts, self.ends, [table[b] for b in self.buckets])

    def shares(self, values: np.ndarray, window: int) -> np.ndarray:
        """Each word's share in the mean of its text's highest passage of `window` words, or of all words of a shorter text."""
        n = self.sizes[self.doc]
        first = (np.cumsum(self.sizes) - self.sizes)[self.doc]
        place = np.arange(len(self.doc)) - first
        sums = np.concatenate(([0.0], np.cumsum(values)))
        at = np.flatnonzero((n > window) & (place <= n - window))
        order = np.lexsort((at, sums[at] - sums[at + window], self.doc[at]))
        _, top = np.unique(self.doc[at][order], return_index=True)
        out = np.where(n > window, 0.0, 1 / n)
        out[(at[order][top][:, None] + np.arange(window)[None, :]).ravel()] = 1 / window
        return out

    def by_bucket(self, weights: np.ndarray, size: int) -> np.ndarray:
        """The sum over all words of weight / subwords for each bucket of theirs."""
        each, out = weights / self.grams, np.zeros(size)
        for b, last in zip(self.buckets, self.last, strict=True):
            turn = np.zeros(len(b) + 1)
            turn[self.starts - 1] += each
            turn[last] -= each
            at = np.cumsum(turn)[:-1]
            used = np.flatnonzero(np.abs(at) > 1e-15)
            out += np.bincount(b[used], at[used], size)
        return out

    def entries(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, weight and text of each subword of the words that have a share."""
        words = np.flatnonzero(shares)
        flat, of, doc = [], [], []
        for b, last in zip(self.buckets, self.last, strict=True):
            count = (last - self.starts + 1)[words]
            flat.append(b[np.repeat(self.starts[words] - 1 - (np.cumsum(count) - count), count) + np.arange(count.sum())])
            of.append(np.repeat((shares / self.grams)[words], count))
            doc.append(np.repeat(self.doc[words], count))
        return np.concatenate(flat), np.concatenate(of), np.concatenate(doc)


class SubwordToxicity:
    """A fastText-like classifier whose document score comes from its most toxic passage.

    A word is the mean of its subword vectors; a passage of `window` words is the mean of its words, then a linear softmax over
    (clean, toxic). Training starts with whole documents and goes on with the passage that now scores highest in each, so that a few
    toxic words in a long text count. A logistic model over the highest passage, the next one apart from it and the two highest words gives the
    probability; it is fitted on what models of the other folds make of each text, so it knows how sure an unseen text can be, and
    re-weighted to the labels' true share. Whole texts are scored. Null and empty texts have no words and get the score of a text without signs.
    """

    def __init__(self, sample: list[tuple[str, int]], prior: float | None = None, bits: int = 18, size: int = 8, window: int = 12, steps: int = 24, folds: int = 3, seed: int = 3):
        self.bits, self.window = bits, window
        self.table, self.model, self.constant = np.zeros(1 << bits, np.float32), None, 0.0
        y = np.array([y for _, y in sample], float)
        if len(set(y)) == 2:
            parts = [_subwords(t, bits) for t, _ in sample]
            place = np.zeros(len(y), int)
            for k in (0, 1):
                place[y == k] = np.arange((y == k).sum())
            folds = min(folds, int(min(y.sum(), len(y) - y.sum())))
            features = np.zeros((len(y), 3))
            for f in range(folds if folds > 1 else 0):
                inside = place % folds != f
                self._train([p for p, i in zip(parts, inside, strict=True) if i], y[inside], size, steps, seed)
                features[~inside] = [self._features(sample[i][0]) for i in np.flatnonzero(~inside)]
            self._train(parts, y, size, steps, seed)
            if folds < 2:
                features[:] = [self._features(t) for t, _ in sample]
            self.model = Logistic(features, y, prior)
        elif len(y):
            self.constant = float(y.mean())

    def _train(self, parts: list, y: np.ndarray, size: int, steps: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.1, (1 << self.bits, size)).astype(np.float32)
        w = rng.normal(0, 0.5, (size, 2)).astype(np.float32)
        bias, grown_e, grown_w, bag = 0.0, np.full(1 << self.bits, 1e-8), 1e-8, _Bag(parts)
        for step in range(steps):
            u = w[:, 1] - w[:, 0]
            table = (e @ u).astype(np.float32)
            whole = step < _WHOLE
            if whole:
                values = bag.values(table)
                made = np.bincount(bag.doc, values / bag.sizes[bag.doc], len(y))
            else:
                if (step - _WHOLE) % _LOOK == 0:  # where each text's passage lies is looked up now and then
                    flat, of, doc = bag.entries(bag.shares(bag.values(table), self.window))
                made = np.bincount(doc, table[flat] * of, len(y))
            slope = np.where(bag.sizes > 0, 1 / (1 + np.exp(-np.clip(made + bias, -30, 30))) - y, 0.0)
            c = bag.by_bucket((slope / np.maximum(bag.sizes, 1))[bag.doc], 1 << self.bits) if whole else np.bincount(flat, of * slope[doc], 1 << self.bits)
            c /= len(y)
            step_w = c @ e
            grown_e += c**2
            touched = np.flatnonzero(c)
            e[touched] -= (0.15 * c[touched] / np.sqrt(grown_e[touched]))[:, None] * u[None, :]
            grown_w += (step_w**2).sum()
            w += np.outer(0.2 * step_w / np.sqrt(grown_w), (1, -1)).astype(np.float32)
            bias -= 0.3 * float(slope.mean())
        table = e @ (w[:, 1] - w[:, 0])
        # Scaled by what words are like, so that models of different folds agree.
        values = bag.values(table)
        low, middle = np.percentile(values, (16, 50)) if len(values) else (0.0, 0.0)
        self.table = ((table - middle) / max(middle - low, 1e-9)).astype(np.float32)

    def _features(self, text: str | None) -> tuple[float, float, float]:
        starts, ends, buckets = _subwords(text, self.bits)
        n, w = len(starts), self.window
        if not n:
            return self.clean
        words = _word_values(starts, ends, [self.table[b] for b in buckets])
        if n <= w:
            return float(words.mean()), float(words.mean()), float(np.sort(words)[-2:].mean())
        sums = np.concatenate(([0.0], np.cumsum(words)))
        means = (sums[w:] - sums[:-w]) / w
        top = int(np.argmax(means))
        apart = np.concatenate((means[: max(0, top - w + 1)], means[top + w :]))
        return float(means[top]), float(apart.max() if len(apart) else means[top]), float(np.partition(words, -2)[-2:].mean())

    @property
    def clean(self) -> tuple[float, float, float]:
        """The features of a text without words: those of a typical word."""
        return 0.0, 0.0, 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts) or self.model is None:
            return np.full(len(texts), self.constant)
        return self.model(np.array([self._features(t) for t in texts]))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, most: int = 800) -> SubwordToxicity:
        """Fitted on at most `most` labelled rows a label outside the held-out fold; the score is calibrated to their true shares."""
        sample = labelled_sample(docs, labels, "toxic", modulus, held, most)
        marked = labels.filter(F.col("toxic").isNotNull() & (fold("doc_id", modulus) != held))
        return cls(sample, prior=marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0])

    def score(self, docs: DataFrame, text: str = "text", to: str = "score") -> DataFrame:
        """`docs` with the column `to`, a double from 0 to 1, in the place of any column of that name."""
        docs = docs.drop(to)
        at = docs.columns.index(text)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = self.scores(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, to])

        return docs.mapInArrow(each, docs.select("*", F.lit(0.0).alias(to)).schema)
