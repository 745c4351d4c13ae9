"""SentencePiece encoding and decoding in batched numpy.

A text is cut into units that no piece crosses (spaces with the word after them; characters that occur in no longer
piece). Distinct units of equal length advance together: hashes of all their substrings probe the sorted hashes of the
pieces, which gives piece and score of every substring at once.

* Unigram models: Viterbi. For each end position the vectorised maximum over the piece lengths is the best score, and
  its place the backpointer.
* BPE models (the public model here is one): Viterbi over BPE scores does not give the ids that the format defines, since
  merges are greedy. So the same substring scores serve a vectorised merge: of every unit the pair with the highest
  score merges, all units of a length at a time.

Pieces come from a model file whose path is a parameter; the driver reads it and sends it to the executors (its size is
that of the vocabulary). Units longer than LONG take a scalar merge or Viterbi with the same ids. Models with a character map for normalisation are
refused.

Defined cases: a null or empty text has no ids and decodes to an empty text; characters without a piece become byte
pieces, or the unknown id where the model has none; a text that itself holds U+2581 decodes to spaces there, and
round_trip says so; ties go to the leftmost pair (BPE) or the longest piece (unigram); repeated rows are encoded one by
one; an empty table gives an empty result; clashing input columns are replaced by the result's.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 192
UNITS_AT_ONCE = 4096
CACHE_UNITS = 250_000
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5


def _hash_of(chars: np.ndarray) -> np.ndarray:
    """Prefix hashes along the last axis, one longer than it."""
    h = np.zeros((*chars.shape[:-1], chars.shape[-1] + 1), np.uint64)
    for i in range(chars.shape[-1]):
        h[..., i + 1] = h[..., i] * _BASE + chars[..., i].astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class Vocabulary:
    """Pieces of a model file, as plain data."""

    kind: int
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    dummy_prefix: bool
    trim: bool
    byte_fallback: bool
    unknown: int = 0
    index: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            return cls.parse(sentencepiece_model_pb2.ModelProto.FromString(f.read()))

    @classmethod
    def parse(cls, m) -> Vocabulary:
        if m.normalizer_spec.precompiled_charsmap or m.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models without a character map are supported")
        types = np.array([p.type for p in m.pieces])
        v = cls(
            m.trainer_spec.model_type,
            [p.piece for p in m.pieces],
            np.array([p.score for p in m.pieces], np.float32),
            types,
            m.normalizer_spec.add_dummy_prefix,
            m.normalizer_spec.remove_extra_whitespaces,
            m.trainer_spec.byte_fallback,
            int(np.flatnonzero(types == _UNKNOWN)[0]) if (types == _UNKNOWN).any() else 0,
        )
        v.index = {p: i for i, (p, t) in enumerate(zip(v.pieces, types, strict=True)) if t in (_NORMAL, _USER)}
        return v


class Codec:
    """Encoder and decoder of one process, with a cache of units."""

    def __init__(self, v: Vocabulary):
        self.v = v
        own = sorted(v.index)
        self.longest = max(map(len, own), default=1)
        keys = np.array([self._key(p) for p in own], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([v.index[p] for p in own], np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)  # by the keys' highest bits, so that few substrings are searched for
        self.maybe[self.keys >> np.uint64(44)] = True
        several = {c for p in own if len(p) > 1 for c in p}
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in own)
        lone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in several)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else ""))
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)) if t == _BYTE}
        self.least = float(v.scores.min(initial=0)) - UNKNOWN_PENALTY
        self.table = [self._plain(i) for i in range(len(v.pieces))]
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _key(piece: str) -> int:
        chars = np.array([list(map(ord, piece))], np.uint64)
        return int(_hash_of(chars)[0, -1]) ^ len(piece)

    def _plain(self, i: int) -> bytes:
        p, t = self.v.pieces[i], self.v.types[i]
        if t == _BYTE:
            return bytes([int(p[3:5], 16)])
        return b"" if t == _CONTROL else " ⁇ ".encode() if t == _UNKNOWN else p.replace(SPACE, " ").encode()

    def normalised(self, text: str) -> str:
        if self.v.trim:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.v.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [(self.units.findall(s) if self.splits else [s]) if (s := self.normalised(t or "")) else [] for t in texts]
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        missing = set().union(*cut).difference(self.cache) if cut else ()
        self._learn(sorted(missing, key=len))
        out = [np.frombuffer(b"".join(map(self.cache.__getitem__, units)), np.int32) for units in cut]
        if not self.v.byte_fallback:  # a run of unknown characters is one unknown id
            out = [a[(a != self.v.unknown) | (np.concatenate([[-1], a[:-1]]) != self.v.unknown)] for a in out]
        return out

    def _learn(self, units: list[str]) -> None:
        """Ids of new units, sorted by length, into the cache."""
        at = 0
        while at < len(units):
            n, end = len(units[at]), at
            while end < len(units) and len(units[end]) == n and end - at < max(1, UNITS_AT_ONCE * 8 // n):
                end += 1
            some = units[at:end]
            if n > LONG:  # one by one, in memory that grows with the length only
                for u in some:
                    self.cache[u] = self._ids(u, self._merge_long(u) if self.v.kind == _BPE else self._viterbi_long(u))
            else:
                chars = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n)
                found = self._probe(chars)
                scores = np.where(found >= 0, self.v.scores[found], np.float32(-np.inf))
                follow = self._merge(scores) if self.v.kind == _BPE else self._viterbi(scores)
                self._store(some, found, follow)
            at = end

    def _store(self, units: list[str], found: np.ndarray, follow: np.ndarray) -> None:
        """The ids along follow (where the piece at a place ends) of units of one length into the cache."""
        w, n, most = found.shape
        on, at, rows = np.zeros((w, n), bool), np.zeros(w, np.int64), np.arange(w)
        while len(rows):
            on[rows, at] = True
            at = follow[rows, at]
            rows, at = rows[at < n], at[at < n]
        row, start = np.nonzero(on)
        size = follow[row, start] - start
        ids = found[row, start, np.minimum(size, most - 1)]
        flat, width = ids.tobytes(), ids.itemsize
        ends = (np.bincount(row, minlength=w).cumsum() * width).tolist()
        for u, a, b in zip(units, [0, *ends], ends, strict=False):
            self.cache[u] = flat[a:b]
        for r in np.unique(row[ids < 0]).tolist():  # characters without a piece
            self.cache[units[r]] = self._ids(units[r], follow[r].tolist())

    def _ids(self, unit: str, follow: list[int]) -> bytes:
        """follow[a]: where the piece that starts at a ends."""
        out, a = [], 0
        while a < len(unit):
            b = follow[a]
            i = self.v.index.get(unit[a:b])
            if i is not None:
                out.append(i)
            elif self.v.byte_fallback:
                out += [self.bytes[x] for x in unit[a:b].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.v.unknown)
            a = b
        return np.array(out, np.int32).tobytes()

    def _probe(self, chars: np.ndarray) -> np.ndarray:
        """ids[w, a, l]: of the piece chars[w, a : a + l]; -1 where there is none."""
        w, n = chars.shape
        h, power = _hash_of(chars), 1
        out = np.full((w, n, min(n, self.longest) + 1), -1, np.int32)
        for length in range(1, out.shape[2]):
            power = power * int(_BASE) & (1 << 64) - 1
            sub = (h[:, length:] - h[:, : n - length + 1] * np.uint64(power)) ^ np.uint64(length)
            row, place = np.nonzero(self.maybe[sub >> np.uint64(44)])
            sub = sub[row, place]
            at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
            hit = self.keys[at] == sub
            out[row[hit], place[hit], length] = self.ids[at[hit]]
        return out

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        w, n, most = scores.shape
        best = np.full((w, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((w, n + 1), np.int64)
        known = np.isfinite(scores[:, :, 1])
        one = np.where(known, scores[:, :, 1], np.float32(self.least))
        for end in range(1, n + 1):
            lengths = np.arange(min(end, most - 1), 0, -1)
            s = scores[:, end - lengths, lengths]
            s[:, -1] = one[:, end - 1]
            s = s + best[:, end - lengths]
            at = s.argmax(1)  # of equal paths the longest piece
            best[:, end] = s[np.arange(w), at]
            back[:, end] = end - lengths[at]
        follow, end = np.zeros((w, n + 1), np.int64), np.full(w, n)
        rows = np.arange(w)
        while len(rows):
            start = back[rows, end[rows]]
            follow[rows, start] = end[rows]
            end[rows] = start
            rows = rows[start > 0]
        return follow

    def _viterbi_long(self, unit: str) -> list[int]:
        """The same best path for one long unit."""
        n, known, scores = len(unit), self.v.index, self.v.scores
        best, back = np.full(n + 1, -np.inf, np.float32), np.zeros(n + 1, np.int64)
        best[0] = 0
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):  # of equal paths the longest piece
                i = known.get(unit[start:end])
                if i is None and start < end - 1:
                    continue
                s = best[start] + (np.float32(self.least) if i is None else scores[i])
                if s > best[end]:
                    best[end], back[end] = s, start
        follow, end = [0] * n, n
        while end:
            follow[back[end]] = end
            end = int(back[end])
        return follow

    def _merge(self, scores: np.ndarray) -> np.ndarray:
        w, n, most = scores.shape
        follow = np.minimum(np.tile(np.arange(1, n + 3), (w, 1)), n)  # of the place n too
        starts = np.ones((w, n), bool)
        rows, place = np.arange(w), np.arange(n)
        while len(rows):
            middle = follow[rows, :n]
            end = np.take_along_axis(follow[rows], middle, 1)
            length = end - place
            ok = starts[rows] & (middle < n) & (length < most)
            s = np.where(ok, scores[rows[:, None], place, np.where(ok, length, 0)], -np.inf)
            at = s.argmax(1)  # the leftmost of equal pairs
            go = np.isfinite(s[np.arange(len(rows)), at])
            rows, at, middle, end = rows[go], at[go], middle[go], end[go]
            pick = np.arange(len(rows))
            starts[rows, middle[pick, at]] = False
            follow[rows, at] = end[pick, at]
        return follow[:, :n]

    def _merge_long(self, unit: str) -> list[int]:
        """The same merges for one long unit, by a heap of pairs."""
        n, score = len(unit), self.v.scores
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(a: int) -> None:
            if a >= 0 and follow[a] < n:
                end = follow[follow[a]]
                i = self.v.index.get(unit[a:end]) if end - a <= self.longest else None
                if i is not None:
                    heapq.heappush(heap, (-float(score[i]), a, follow[a], end))

        for a in range(n):
            offer(a)
        while heap:
            _, a, m, end = heapq.heappop(heap)
            if not alive[a] or follow[a] != m or not alive[m] or follow[m] != end:
                continue
            alive[m], follow[a] = False, end
            if end < n:
                before[end] = a
            offer(a)
            offer(before[a])
        return follow

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.v.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def encoded(df: DataFrame, model_path: str = MODEL, text: str = "text") -> DataFrame:
    """df with ids (array of int), n_tokens and round_trip (whether the ids decode to the text)."""
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(sent.value)
        for batch in batches:
            for at in range(0, len(batch), 256):  # bounded memory, however many rows Spark sends at once
                texts = batch.slice(at, 256).to_pylist()
                ids = codec.encode(texts)
                same = [codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same, pa.bool_())], ["ids", "round_trip"])
        del codec
        common.release()

    out = df.withColumn("__e", F.arrow_udf(of, "struct<ids: array<int>, round_trip: boolean>")(F.col(text)))
    return out.withColumns({"ids": F.col("__e.ids"), "n_tokens": F.size("__e.ids"), "round_trip": F.col("__e.round_trip")}).drop("__e")


def decoded(df: DataFrame, model_path: str = MODEL, ids: str = "ids", name: str = "text") -> DataFrame:
    """df with the text that the ids stand for; null ids decode to an empty text."""
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(sent.value)
        for batch in batches:
            yield pa.array([codec.decode(np.array(x or [], np.int32)) for x in batch.to_pylist()], pa.string())

    return df.withColumn(name, F.arrow_udf(of, "string")(F.col(ids)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs).select("doc_id", "n_tokens", "ids", "round_trip")
