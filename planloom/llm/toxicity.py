"""Toxicity by class ratios over one Kneser-Ney word model that both classes share.

This departs from comparing the likelihoods of two plain class-conditional Kneser-Ney models, which failed on the labels
here (README). Both classes share a Kneser-Ney bigram model (absolute discount, continuation counts below). A class
rescales it by its own marginals: for words by their continuation counts in the class against those that the shared model
expects, for bigrams by their counts against those expected. Both are smoothed towards the shared model by STRENGTH
expected observations, so an expression that is rare in either class says next to nothing. In the ratio of the classes
the shared probability cancels, so what a text is scored by is the sum of the log-ratios of its words' rescaled
probabilities, each drawn towards 0 by DEAD_ZONE, over its length and PRIOR_WORDS more; the logistic of it is the score.

The counts are of all labelled documents outside the held-out fold, gathered in Spark, so they grow with the corpus: each
text counts once for each class, its bigrams are counted where it is read, and only the sums by slot go to the driver.
Words are hashed to WORD_SLOTS and bigrams to PAIR_SLOTS without telling collisions apart, so these sums and what is sent
to the executors have a fixed size however large the vocabulary is. Only the calibration (slope and bias) is fitted to a
bounded sample, training.MAX_PER_CLASS documents of each class and training.MAX_BYTES: each is scored by a model of the
half of the texts that it does not belong to.

Defined cases: a null text counts as empty; a text without words has difference 0 and so the score of the bias; ties and
repeated rows are scored one by one; texts of any length are scored whole; without labelled rows of both classes every score is 0; an empty table gives an
empty result; clashing input columns are replaced by the result's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm import common, training

WORD_SLOTS = 1 << 18
PAIR_SLOTS = 1 << 19
DISCOUNT = 0.75
#: Observations that the shared model's expectation weighs against a class's own counts, of words and of bigrams.
STRENGTH = 3.0
PAIR_STRENGTH = 50.0
#: Log-ratios are drawn towards 0 by this much: slight ratios tell the classes' languages apart, not their tone.
DEAD_ZONE = 1.0
#: Words without evidence that are added to each text's length, so that a few words alone decide little.
PRIOR_WORDS = 20
CACHE_WORDS = 200_000
#: Words whose bigrams a worker gathers before it hands their counts on.
HELD_WORDS = 1 << 21
#: Labelled texts of which 36 bytes each are broadcast rather than joined by a shuffle of the texts.
BROADCAST_ROWS = 500_000
_WORD = re.compile(r"\w+")


def _slots(text: str, cache: dict[str, int]) -> np.ndarray:
    """The word slots of a whole text; case and punctuation don't count."""
    words = _WORD.findall(text.lower())
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & (WORD_SLOTS - 1)
    return np.fromiter(map(cache.__getitem__, words), np.int32, len(words))


def _pair(before: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((before * np.int64(0x9E3779B1) ^ slots * np.int64(0x85EBCA6B)) >> 7) & (PAIR_SLOTS - 1)


def _pairs(slots: np.ndarray) -> np.ndarray:
    """A slot for each word with the one before it; the first follows slot 0."""
    return _pair(np.concatenate([[0], slots[:-1]]), slots)


@dataclass
class Model:
    """Counts of both classes and the model that they share."""

    marginal: np.ndarray  # (2, WORD_SLOTS) float32: p(word | class) / p(word)
    pairs: np.ndarray  # (2, PAIR_SLOTS) float32: bigram counts of each class
    firsts: np.ndarray  # (2, WORD_SLOTS) float32: counts of the word before
    shared: np.ndarray  # (WORD_SLOTS,) float32: p(word) by continuation counts of both classes
    backoff: np.ndarray  # (WORD_SLOTS,) float32: the weight of p(word) after a word
    weights: np.ndarray  # slope and bias of the calibration

    def difference(self, slots: np.ndarray) -> float:
        """The mean log-ratio of the classes' rescaled probabilities, less DEAD_ZONE each, over the length and PRIOR_WORDS."""
        if not len(slots):
            return 0.0
        before, pair = np.concatenate([[0], slots[:-1]]), _pairs(slots)
        c, n = self.pairs[:, pair], self.firsts[:, before]
        both = np.maximum(n.sum(0), c.sum(0))
        p = np.maximum(c.sum(0) - DISCOUNT, 0) / np.maximum(both, 1) + self.backoff[before] * self.shared[slots]
        own = self.marginal[:, slots]
        p = own * (c + PAIR_STRENGTH) / (np.maximum(n, c) * p * own + PAIR_STRENGTH)  # the shared model's p cancels
        ratio = np.log(p[1]) - np.log(p[0])
        ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - DEAD_ZONE, 0)
        return float(ratio.sum() / (len(slots) + PRIOR_WORDS))

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] * differences + self.weights[1], -30, 30)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, part) to (part, before, word, n): the bigrams of whole texts, summed over HELD_WORDS words or so."""
    cache, held, size = {}, [], 0

    def summed() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        columns = {"part": key >> 36, "before": key >> 18 & (WORD_SLOTS - 1), "word": key & (WORD_SLOTS - 1), "n": n}
        return pa.RecordBatch.from_pydict({k: pa.array(v.astype("int64" if k == "n" else "int32")) for k, v in columns.items()})

    for batch in batches:
        for text, part in zip(batch.column(0), batch.column(1), strict=True):
            slots = _slots(text.as_py(), cache).astype(np.int64)
            if len(slots):
                held.append(part.as_py() << 36 | np.concatenate([[0], slots[:-1]]) << 18 | slots)
                size += len(slots)
            if size > HELD_WORDS:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()
    held.clear()
    cache.clear()
    common.release()


def bigrams(texts: DataFrame) -> DataFrame:
    """(before, word, n0, n1, n2, n3) for each bigram in texts (text, part): its counts in the parts 0 to 3."""
    counts = texts.select("text", F.col("part").cast("int")).mapInArrow(_counted, "part int, before int, word int, n long")
    each = [F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    return counts.groupBy("before", "word").agg(*each)


def _in_class(c: int, halves: Sequence[int]) -> Column:
    """The count of a bigram in a class over some halves of the texts; a text of half h and class c is in part 2 h + c."""
    return sum((F.col(f"n{2 * h + c}") for h in halves), F.lit(0))


def _by_slot(table: DataFrame, slot: Column, size: int, sums: list[Column]) -> list[np.ndarray]:
    """The sums as arrays by slot; at most size rows go to the driver."""
    rows = table.groupBy(slot.alias("slot")).agg(*[x.cast("float").alias(f"s{i}") for i, x in enumerate(sums)]).toArrow()
    at, out = rows["slot"].to_numpy(), []
    for i in range(len(sums)):
        out.append(np.zeros(size))
        out[i][at] = rows[f"s{i}"].to_numpy()
    return out


def fit(table: DataFrame, fits: Sequence[Sequence[int]] = ((0, 1),)) -> list[Model | None]:
    """A model, yet to be calibrated, of each choice of halves of bigrams(); None where a class has no words."""
    mixed = (F.col("before").cast("long") * 0x9E3779B1).bitwiseXOR(F.col("word").cast("long") * 0x85EBCA6B)
    slot = F.shiftright(mixed, 7).bitwiseAND(PAIR_SLOTS - 1)
    n = [[_in_class(c, halves) for c in (0, 1)] for halves in fits]
    sums = [F.sum(x) for both in n for x in both]
    pairs = _by_slot(table, slot, PAIR_SLOTS, sums)
    firsts = _by_slot(table, F.col("before"), WORD_SLOTS, sums + [F.count_if(a + b > 0) for a, b in n])
    kinds = _by_slot(table, F.col("word"), WORD_SLOTS, [F.count_if(x > 0) for both in n for x in both])
    follows = firsts[2 * len(n) :]
    return [_model(*(np.array(x[2 * i : 2 * i + 2]) for x in (pairs, firsts, kinds)), follows[i]) for i in range(len(n))]


def _model(pairs: np.ndarray, firsts: np.ndarray, kinds: np.ndarray, follows: np.ndarray) -> Model | None:
    """From counts by class: of bigrams, of words before, of words before a word; and of words after a word in either class."""
    if not kinds.sum(1).all():
        return None
    both = firsts.sum(0)
    backoff = np.where(both > 0, np.minimum(DISCOUNT * follows / np.maximum(both, 1), 1), 1)
    shared = (kinds.sum(0) + 0.5) / (kinds.sum() + 0.5 * WORD_SLOTS)
    marginal = (kinds + STRENGTH) / (kinds.sum(1, keepdims=True) * shared + STRENGTH)
    return Model(*(x.astype(np.float32) for x in (marginal, pairs, firsts, shared, backoff)), np.zeros(2))


def _calibrated(diff: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A slope and bias that put 0.5 midway between the classes, as parted by the cut with the fewest errors.

    Labels may be noisy: an ordinary document called toxic counts as two errors, and of the documents on either side of
    the cut the outermost twentieth of the toxic and hundredth of the ordinary are passed over.
    """
    order = np.argsort(diff, kind="stable")
    d, toxic = diff[order], y[order] == 1
    missed = np.concatenate([[0], np.cumsum(toxic)])
    wrong = 2 * ((~toxic).sum() - np.concatenate([[0], np.cumsum(~toxic)]))
    i = int(np.flatnonzero(missed + wrong == (missed + wrong).min())[-1])
    above, below = d[i:][toxic[i:]], d[:i][~toxic[:i]]
    high = np.quantile(above, 0.05) if len(above) else d[-1] + 1e-2
    low = np.quantile(below, 0.99) if len(below) else d[0] - 1e-2
    slope = 4 / max(high - low, 1e-3)
    return np.array([slope, -slope * (high + low) / 2])


def score(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score of every whole text."""
    if model is None:
        return df.withColumn(name, F.lit(0.0))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, cache = sent.value, {}
        for batch in batches:
            yield pd.Series(m.score(np.array([m.difference(_slots(t or "", cache)) for t in batch], float)), dtype="float64")
        cache.clear()
        common.release()

    return df.withColumn(name, F.pandas_udf(scores, "double")(F.col(text)))


def _labelled_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """(text, part) of all labelled documents, each text once for each class, and the paths of the tables that it reads.

    Which document stands for a text is settled on hashes, so that texts are not shuffled for it. The labelled ids are
    broadcast up to BROADCAST_ROWS of them; beyond, they are joined by a shuffle.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    docs = docs.select("*", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    thin = docs.select("doc_id", "h", "crc").join(training.agreed(labels, "toxic").select("doc_id", "y"), "doc_id")
    thin = thin.groupBy("doc_id", "h", "crc", "y").agg(F.count("*").alias("rows"))
    one = thin.groupBy("h", "crc", "y").agg(F.min(F.struct("doc_id", "rows")).alias("one"))
    one = one.select("one.doc_id", "h", "crc", (F.col("crc") % 2 * 2 + F.col("y")).alias("part"), "one.rows")
    chosen, path = common.materialise(one)
    paths = [path]
    if chosen.count() <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(chosen), ["doc_id", "h", "crc"])
    else:  # written, so that the shuffle of the texts goes before that of their bigrams comes
        joined, more = common.materialise(docs.join(chosen, ["doc_id", "h", "crc"]).select("text", "part", "rows"))
        paths.append(more)
    if chosen.where("rows > 1").isEmpty():
        return joined.select("text", "part"), paths
    again = joined.where("rows > 1").select("text", "part").distinct()
    return joined.where("rows = 1").select("text", "part").union(again), paths


def learn(docs: DataFrame, labels: DataFrame, max_per_class: int = training.MAX_PER_CLASS) -> Model | None:
    """None unless both halves of the labelled texts have words of both classes."""
    texts, paths = _labelled_texts(docs, labels)
    table, path = common.materialise(bigrams(texts))
    common.discard(docs.sparkSession, *paths)
    model, *halves = fit(table, ((0, 1), (0,), (1,)))
    common.discard(docs.sparkSession, path)
    if model is None or None in halves:
        return None
    diff, y = [], []
    for t, label in dict.fromkeys(training.labelled(docs, labels, "toxic", max_per_class)):
        slots = _slots(t, {})
        if len(slots):  # judged by a model that has not learned from it
            diff.append(halves[1 - zlib.crc32(t.encode()) % 2].difference(slots))
            y.append(label)
    if len(set(y)) < 2:
        return None
    model.weights = _calibrated(np.array(diff), np.array(y))
    common.release()
    return model


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return out.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
