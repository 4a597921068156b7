"""Quality by compression: zstandard dictionaries of good and bad text, sizes against each other, a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .fitting import Logistic, labelled_sample

_PIECE = 2048


class CompressionQuality:
    """Scores texts by how much better the dictionary of good text compresses them than that of bad text.

    Features of the whole text: (size with the bad dictionary - size with the good one) / plain size, each size by length, and
    the plain ratio, which tells repetition. A logistic model fitted on labelled texts turns them into a probability.
    Null and empty texts have the features of no bytes and get a score like others.
    """

    def __init__(self, sample: list[tuple[str, int]], dict_bytes: int = 65536, level: int = 3, prior: float | None = None):
        self.level = level
        self.dictionaries = [self._dictionary([t for t, y in sample if y == k], dict_bytes) for k in (0, 1)]
        y = np.array([y for _, y in sample], float)
        self.model = Logistic(self.features([t for t, _ in sample]), y, prior) if len(set(y)) == 2 else None
        self.constant = float(y.mean()) if len(y) else 0.5

    @staticmethod
    def _dictionary(texts: list[str], most: int) -> bytes:
        # Every second text trains the dictionary; the model sees all, half of them fresh.
        pieces = [b[i : i + _PIECE] for t in texts[::2] for b in [t.encode("utf-8", "replace")] for i in range(0, len(b), _PIECE)]
        try:
            return zstandard.train_dictionary(most, pieces, level=3).as_bytes()
        except zstandard.ZstdError:  # too few pieces
            return b"".join(pieces)[-most:]

    def compressors(self) -> list:
        out = [zstandard.ZstdCompressor(level=self.level, write_content_size=False)]
        for raw in self.dictionaries:
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=self.level)
                out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
            else:
                out.append(out[0])
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        tools, rows = self.compressors(), []
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            n = len(raw) + 16
            plain, bad, good = (len(c.compress(raw)) for c in tools)
            rows.append(((bad - good) / plain, (bad - good) / n, np.log(plain / n), np.log(good / n), np.log(bad / n), np.log(n)))
        x = np.array(rows, float).reshape(len(rows), 6)
        return np.column_stack([x, x[:, :4] ** 2, x[:, 0] * x[:, 2]])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts) or self.model is None:
            return np.full(len(texts), self.constant)
        return self.model(self.features(texts))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, most: int = 3000) -> CompressionQuality:
        """Fitted on at most `most` labelled rows a label outside the held-out fold; the score is calibrated to their true shares."""
        sample = labelled_sample(docs, labels, "quality", modulus, held, most)
        marked = labels.filter(F.col("quality").isNotNull() & (fold("doc_id", modulus) != held))
        share = marked.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        return cls(sample, prior=share)

    def score(self, docs: DataFrame, text: str = "text", to: str = "score") -> DataFrame:
        """`docs` with the column `to`, a double from 0 to 1, in the place of any column of that name."""
        docs = docs.drop(to)
        at = docs.columns.index(text)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = self.scores(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, to])

        return docs.mapInArrow(each, docs.select("*", F.lit(0.0).alias(to)).schema)
