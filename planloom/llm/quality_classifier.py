"""Quality by compression: a text is good if a dictionary of good text shortens it more than one of bad text.

Two zstandard dictionaries are built from labelled texts. A text is cut into chunks of CHUNK bytes, all of which are
compressed with both, so that a long text does not become its own dictionary. Its features are normalised compressed
sizes: the difference of the two over all chunks, the lowest difference of a chunk (bad passages in good text), and the
size against the text's own (text that repeats itself). A logistic regression, fitted to training texts that its
dictionaries have not seen, both classes weighing alike, turns them into odds; times the odds of the labels, counted over
all labels outside the held-out fold, these are the probability of label 1, which is the score.

The dictionaries learn from at most MAX_PER_CLASS documents of each class and have a fixed size.

Defined cases: a null text counts as empty; an empty text has features 0, 0 and 1; ties and repeated rows are scored one
by one; texts of any length are compressed whole, a chunk at a time; without labelled rows of both classes every score is
DECISION; an empty table gives an empty result; clashing input columns are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm import common, training

MAX_PER_CLASS = 1500
DICTIONARY = 1 << 17
CHUNK = 384
LEVEL = 3
DECISION = 0.3


def _dictionary(texts: list[bytes]) -> bytes:
    chunks = [c for t in texts for c in _chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks).as_bytes()
    except zstandard.ZstdError:  # too few chunks to train on: they are the dictionary
        return b"".join(chunks)[-DICTIONARY:]


def _chunks(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


class Compressors:
    """The compressors of both classes in one process."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.bad, self.good = map(_compressor, dictionaries)

    def features(self, text: str | None) -> tuple[float, float, float]:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0, 0.0, 1.0
        chunks = _chunks(data)
        bad = np.fromiter((len(self.bad.compress(c)) for c in chunks), float, len(chunks))
        good = np.fromiter((len(self.good.compress(c)) for c in chunks), float, len(chunks))
        each = (bad - good) / (bad + good)
        return float((bad - good).sum() / (bad + good).sum()), float(each.min()), min(1.0, float(good.sum()) / len(data))


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes]  # bad, good
    weights: np.ndarray
    rate: float = 0.5  # of label 1

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[:-1] + self.weights[-1] + np.log(self.rate / (1 - self.rate))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[str, int]], rate: float = 0.5) -> Model | None:
    """From (text, label) and the rate of label 1; None without two texts of each class."""
    rows = [r for r in dict.fromkeys(rows) if r[0]]
    rows = [(t.encode("utf-8", "replace"), label) for t, label in rows]
    # Every class in turn to either half, so that both halves have both.
    seen, half = [0, 0], []
    for _, label in rows:
        half.append(seen[label] % 2)
        seen[label] += 1
    if min(seen) < 2:
        return None
    x, y = [], []
    for h in (0, 1):
        own = [r for r, s in zip(rows, half, strict=True) if s != h]
        c = Compressors(tuple(_dictionary([t for t, label in own if label == k]) for k in (0, 1)))
        for (t, label), s in zip(rows, half, strict=True):
            if s == h:
                x.append(c.features(t.decode("utf-8", "replace")))
                y.append(label)
    both = tuple(_dictionary([t for t, label in rows if label == k]) for k in (0, 1))
    return Model(both, training.logistic(np.array(x), np.array(y)), min(max(rate, 0.001), 0.999))


def score(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score of every whole text."""
    if model is None:
        return df.withColumn(name, F.lit(DECISION))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        c = Compressors(m.dictionaries)
        for batch in batches:
            yield pd.Series(m.score(np.array([c.features(t) for t in batch], float).reshape(-1, 3)), dtype="float64")
        common.release()

    return df.withColumn(name, F.pandas_udf(scores, "double")(F.col(text)))


def learn(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model | None:
    model = train(training.labelled(docs, labels, "quality", max_per_class), training.rate(labels, "quality"))
    common.release()
    return model


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= DECISION).cast("int").alias("predicted")
    return out.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
