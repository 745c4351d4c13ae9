"""Near-duplicate passages across documents, by compact windows.

A passage is min_words words or more (50); two passages are near-duplicates if the Jaccard similarity of their five-word
shingles is at least 0.8. A replaced word costs five shingles on either side, an inserted one five on its side and four on
the other.

1. For each of `hashes` hash functions, the shingles' hashes of a document form a Cartesian tree. Its nodes whose span
   holds a whole passage are the compact windows (l, c, r): all passages within l .. r that hold c share the minimum at
   c. They are the minima of all stretches of one passage's length, found for a whole batch at once; a stack over the
   few minima gives the spans. A document has about 2 n / min_words windows for each function.
2. Windows with equal minima meet by an equality shuffle on the minimum's hash. A window carries BINS marks for either
   side, each of BIN shingles, and the group stands in their order. Windows with equal marks are tied to the first of
   them, within a batch before the shuffle already. The firsts of groups of up to CROWD + 1 are linked pair by pair where
   they share a mark. In larger groups a window is linked to each earlier document's that shares a mark, unless a still
   earlier one shares all these marks: what it has in common with any, it has with one that it is linked to, and so has
   that other one. So no number of partners bounds the links, and copies do not make all their pairs.
3. Links of two documents at one offset are merged over all hash functions (the interval join: the windows' common span),
   those at near offsets are joined, then verified on hashes of the words themselves: equal runs at the linked offsets,
   and at others that the words show, are chained across inserted and deleted words, and the maximal stretches that are
   similar enough and long enough on both sides are the near-duplicate passages.

A passage that repeats exactly is found whatever else repeats: both windows share c and, c not being next to the end (or
the beginning), the marks beside it; another hash function or window serves near the ends. A passage with replaced words
is missed only if none of its minima is shared, or no mark beside those that are. Marks are compared up to BINS * BIN
shingles from the minimum and as wholes: in a group of more than CROWD + 1 differing texts, words beside changed ones can
be missed where the earlier document with the same marks differs in other words of that mark.

Defined cases: null texts and texts shorter than a passage have no passages; rows with a null id take no part and are
kept as they are; rows that repeat an id are one document and are not compared with each other; passages that repeat
inside one document only are left alone; of near-duplicate passages the one in the smallest id is the first; empty
tables give empty results; other columns are kept. Texts of any length are read whole, in batches of words; a window that
reaches over REACH shingles from its minimum is taken to end there, and the windows beside it cover the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.llm import common

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 4
#: Marks on either side of a window's minimum by which equal minima are ordered and linked, and the shingles of each.
BINS, BIN = 6, 7
#: A group of more surroundings than one and these is linked by the marks that they share, a smaller one pair by pair.
CROWD = 64
#: Windows of a batch with equal marks on one side that go on where _combined() is given a bound; the operator gives none.
SPARE = 8
#: Windows of a larger group that are compared with all before them at once at most, and from how many on sets of marks are counted.
BLOCK, WIDE = 64, 1 << 16
#: Pairs of windows that are made at once, and windows whose partners are looked for at once.
PAIRS, ROWS = 1 << 18, 1 << 15
#: Spans are fetched in multiples of so many words, so that a document has few different ones.
STEP = 64
#: Links of two documents whose shifts differ by so many words are judged together.
DRIFT = 64
#: Bytes of a word's hash by which passages are verified: a shingle has five of them, and a replaced word goes unseen
#: once in 2 ** 24 times.
WORD_BYTES = 3
#: Runs that are chained one by one.
FEW = 12
#: Two shingles that stand in a span more often are looked up one place at a time.
REPEATS = 16
#: Bytes of text that are hashed, and that are cut into windows, at once: a word's arrays take many times its letters.
BATCH_BYTES, WINDOW_BYTES = 1 << 18, 1 << 22
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD, _SPACE = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
_IS_WORD = np.array([chr(i) not in common.SPACES for i in range(256)])
#: A mark has 21 bits, three to a column; the marks' places, those of the first side before the other's: column and bit.
_NEAR = [f"near{k}" for k in range(2 * BINS // 3)]
_PLACES = [(k, bit) for k in range(len(_NEAR)) for bit in (42, 21, 0)]
_MARK = (1 << 21) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
#: Shingles on either side of its minimum that a window reaches at most. A place has 31 bits for the minimum (texts are
#: shorter than 2 GB) and 16 for each reach.
REACH = (1 << 16) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes of words, A-Z lower-cased, straight from the bytes of many texts at once.

    With C the running sum of byte * base ** place, a word from s to e has (C[e] - C[s]) / base ** s: a polynomial in its
    own bytes only, whole numbers modulo 2 ** 64, where an odd base has an inverse.
    """

    def __init__(self):
        self.up, self.down = (np.ones(1, np.uint64) for _ in range(2))

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            for name, base in (("up", int(_P)), ("down", pow(int(_P), -1, 1 << 64))):
                had = getattr(self, name)
                step = np.uint64(pow(base, len(had), 1 << 64))
                setattr(self, name, np.concatenate([had, had * step]))

    def _hashed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte's place) of each word; data neither starts nor ends inside a word."""
        letters = np.frombuffer(data, np.uint8)
        word = np.concatenate([[False], _IS_WORD[letters], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        self._powers(len(letters) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self.up[: len(letters)])])
        return _mix((total[end] - total[start]) * self.down[start]), start

    def hashes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' words, one text after the other, and the number of words of each."""
        data = b"\n".join(t or b"" for t in texts).translate(_LOWER)
        h, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(data):
            end = min(at + BATCH_BYTES, len(data))
            if end < len(data) and (cut := _SPACE.search(data, end)):
                end = cut.end()
            elif end < len(data):
                end = len(data)
            some, start = self._hashed(data[at:end])
            h.append(some)
            places.append(start + at)
            at = end
        starts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        return np.concatenate(h), np.diff(np.searchsorted(np.concatenate(places), starts)) if len(texts) else np.zeros(0, np.int64)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each place; near the end, of those that are left."""
    out, padded, power = np.zeros(len(h), np.uint64), np.concatenate([h, np.zeros(size, np.uint64)]), 1
    for j in range(size):
        out += padded[j : j + len(h)] * np.uint64(power)
        power = power * int(_P) & (1 << 64) - 1
    return _mix(out)


def _minima(h: np.ndarray, size: int) -> np.ndarray:
    """Where the (leftmost) minimum of each stretch of size values is."""
    at, width = np.arange(len(h), dtype=np.int32), 1
    while width < size:
        step = min(width, size - width)
        at = np.where(h[:-step] <= h[step:], at[:-step], at[step:])
        h = np.minimum(h[:-step], h[step:])
        width += step
    return at


def _spans(value: list[int], place: list[int], doc: list[int], first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
    """The Cartesian tree over the minima of each document: how far each is the smallest, to the left and right."""
    n = len(place)
    left, right, stack = [0] * n, [0] * n, []
    for i in range(n):
        if stack and doc[stack[-1]] != doc[i]:
            for s in stack:
                right[s] = int(last[doc[s]])
            stack = []
        while stack and value[stack[-1]] > value[i]:
            right[stack.pop()] = place[i] - 1
        left[i] = place[stack[-1]] + 1 if stack else int(first[doc[i]])
        stack.append(i)
    for s in stack:
        right[s] = int(last[doc[s]])
    return left, right


def _marks(h: np.ndarray) -> np.ndarray:
    """Of each place a mark of 21 bits, never 0, of the BIN shingles from there on."""
    return (_rolled(h, SHINGLE + BIN - 1) % np.uint64(_MARK)).astype(np.int64) + 1


def _beside(mark: np.ndarray, c: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BINS marks after and before each minimum c, three to a column, 0 outside first .. last."""
    after, before = np.zeros((len(c), BINS // 3), np.int64), np.zeros((len(c), BINS // 3), np.int64)
    for i in range(BINS):
        at = c + 1 + BIN * i
        after[:, i // 3] = after[:, i // 3] << 21 | np.where(at + BIN - 1 <= last, mark[np.minimum(at, len(mark) - 1)], 0)
        at = c - BIN * (i + 1)
        before[:, i // 3] = before[:, i // 3] << 21 | np.where(at >= first, mark[np.maximum(at, 0)], 0)
    return after, before


def windows_of(h: np.ndarray, n: np.ndarray, hashes: int = HASHES, min_words: int = MIN_WORDS) -> Iterator[tuple[np.ndarray, ...]]:
    """For each hash function (document, minimum, marks, c, l, r) of the compact windows; places in shingles.

    The marks, in columns from the minimum outwards, have those of what follows first, for every other hash function
    those of what comes before. h, n: as Words.hashes() gives them.
    """
    length, total = min_words - SHINGLE + 1, len(h)
    if total < min_words:
        return
    starts = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    first, last = starts, starts + n - SHINGLE
    shingle = _rolled(h, SHINGLE)
    mark = _marks(h)
    whole = np.flatnonzero(doc[: total - min_words + 1] == doc[min_words - 1 :])  # where a passage starts
    if not len(whole):
        return
    for j in range(hashes):
        m = _mix(shingle + np.uint64((j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        least = np.zeros(total, bool)
        least[_minima(m, length)[whole]] = True
        c = np.flatnonzero(least)
        l, r = _spans(m[c].tolist(), c.tolist(), doc[c].tolist(), first, last)
        base = starts[doc[c]]
        after, before = _beside(mark, c, base, last[doc[c]])
        near = np.concatenate([after, before] if j % 2 == 0 else [before, after], 1)
        yield doc[c], m[c], near, c - base, np.array(l) - base, np.array(r) - base


def _placed(c: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    return c << 32 | np.minimum(c - l, REACH) << 16 | np.minimum(r - c, REACH)


def _window(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of _placed()."""
    c = place >> 32
    return c, c - (place >> 16 & REACH), c + (place & REACH)


def _windows(docs: DataFrame, hashes: int, min_words: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
            texts = batch["text"].cast(pa.binary()).to_pylist()
            size = np.cumsum([len(t or b"") for t in texts])
            cuts = np.unique(np.searchsorted(size, np.arange(0, (size[-1] if len(size) else 0) + 1, WINDOW_BYTES)))
            for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                if a == b:
                    continue
                ids = batch["id"].to_numpy()[a:b]
                for doc, key, near, c, l, r in windows_of(*words.hashes(texts[a:b]), hashes, min_words):
                    key, near, *cols = _combined(key.astype(np.int64), near, ids[doc], _placed(c, l, r), len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *near.T, *cols)], ["key", *_NEAR, "doc", "place", "to", "at"])
        del words
        common.release()

    return docs.mapInArrow(of, ", ".join(f"{c} long" for c in ("key", *_NEAR, "doc", "place", "to", "at")))


def _starts(new: np.ndarray) -> np.ndarray:
    """Of each row the last one up to it where new holds."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1] if x.ndim == 1 else (x[1:] != x[:-1]).any(1)
    return out


def _combined(key: np.ndarray, near: np.ndarray, doc: np.ndarray, place: np.ndarray, spare: int = SPARE) -> list[np.ndarray]:
    """(key, near, doc, place, to, at): a batch's windows, combined before they are dealt out.

    Of windows with equal minima and marks only the first document's go on (at is -1), and of those with equal marks on
    the first side `spare`; the others are tied to the first here (`to`, `at`) and get a key of their own, so that a
    passage that a third of all documents share meets as few windows as there are batches.
    """
    near = near.reshape(len(key), -1)
    order = np.argsort(key, kind="stable")
    new = np.append(_changes(key[order]), True)
    again = np.flatnonzero(~(new[1:] & new[:-1]))  # most minima stand alone
    some = order[again]
    order[again] = some[np.lexsort((place[some], doc[some], *near[some].T[::-1], key[some]))]
    key, near, doc, place = key[order], near[order], doc[order], place[order]
    side = _changes(key) | _changes(near[:, : near.shape[1] // 2] if near.shape[1] > 1 else near >> 32)
    one, both = _starts(side), _starts(side | _changes(near))
    firsts = np.cumsum(both == np.arange(len(key)))
    leader = np.where(firsts - firsts[one] >= spare, one, both)
    tied = doc != doc[leader]
    own = _mix(doc.astype(np.uint64) * _P + place.astype(np.uint64)).astype(np.int64)
    return [np.where(tied, own, key), near, doc, place, np.where(tied, doc[leader], -1), np.where(tied, place[leader], -1)]


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two windows' marks have one in common at the same place."""
    out = np.zeros(len(x), bool)
    for k, bit in _PLACES:
        a = x[:, k] >> bit & _MARK
        out |= (a == (y[:, k] >> bit & _MARK)) & (a > 0)
    return out


def _firsts(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, k): of a group's rows in order of their documents, each row i and its first row k < i for a set of marks.

    That is every k that has a mark in common with i, unless an earlier row has all that k has in common with i, and more
    or the same. So what i has in common with any k, it has with a row that it is linked to, and so has k.
    """
    n, sets = len(near), 1 << 2 * BINS
    marks = np.stack([near[:, k] >> bit & _MARK for k, bit in _PLACES]).astype(np.int32)
    if n > WIDE:
        yield from _firsts_by_set(marks)
        return
    other = np.where(marks > 0, marks, -1)  # two marks that are missing are not equal
    first = np.empty(BLOCK * sets, np.int32)
    block = max(1, min(BLOCK, 4 * PAIRS // n))
    for a in range(0, n, block):
        x, y = marks[:, a : a + block], other[:, : a + block]
        same = np.zeros((x.shape[1], y.shape[1]), np.uint16)
        for p in range(2 * BINS):
            same |= np.multiply(x[p][:, None] == y[p], np.uint16(1 << p))
        same[:, a:][np.triu_indices(len(same))] = 0
        some = np.flatnonzero(same != 0)
        i, k, of = some // same.shape[1], some % same.shape[1], same.ravel()[some]
        code = i * sets + of
        first[code[::-1]] = k[::-1]  # the last one assigned stays: the first row
        own = first[code] == k
        i, k, of, code = i[own], k[own], of[own], code[own]
        count = np.bincount(i, minlength=len(same))
        if (count * count).sum() < len(same) * sets:  # each set against the others of its row
            ahead = np.repeat(count, count)
            one = np.repeat(np.arange(len(i)), ahead)
            two = np.arange(len(one)) - np.repeat(np.cumsum(ahead) - ahead, ahead) + np.repeat((np.cumsum(count) - count)[i], ahead)
            more = (k[two] < k[one]) & (of[one] & ~of[two] == 0)
            own = np.bincount(one[more], minlength=len(i)) == 0
        else:  # or the first row of all that have these marks in common
            best = np.full(len(same) * sets, n, np.int32)
            best[code] = k
            for p in range(2 * BINS):
                pair = best.reshape(len(same), -1, 2, 1 << p)
                np.minimum(pair[:, :, 0], pair[:, :, 1], out=pair[:, :, 0])
            own = best[code] == k
        yield a + i[own], k[own]


def _firsts_by_set(marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_firsts() in time linear in the rows: the first row of each set of marks, set by set."""
    n = marks.shape[1]
    some = [np.zeros(0, np.int64)]
    for places in range(1, 1 << len(marks)):
        those = [p for p in range(len(marks)) if places >> p & 1]
        rows = np.flatnonzero(np.logical_and.reduce([marks[p] > 0 for p in those]))
        code = np.zeros(len(rows), np.uint64)
        for p in those:
            code = _mix(code * _P + marks[p][rows].astype(np.uint64))
        _, first, of = np.unique(code, return_index=True, return_inverse=True)
        k = rows[first[of]]
        some.append(rows[k != rows] * n + k[k != rows])
        if sum(map(len, some)) > PAIRS or places == (1 << len(marks)) - 1:
            pairs = np.unique(np.concatenate(some))
            some = [np.zeros(0, np.int64)]
            for at in range(0, len(pairs), PAIRS):
                yield pairs[at : at + PAIRS] // n, pairs[at : at + PAIRS] % n


def _partners(key: np.ndarray, near: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, k): the rows to link, of whole groups' surroundings in order."""
    if not len(key):
        return
    start = np.flatnonzero(_changes(key))
    size = np.diff(np.append(start, len(key)))
    of = np.repeat(np.where(size > CROWD + 1, 0, size), size)
    few = np.arange(len(key))
    for d in range(1, CROWD + 1):
        few = few[of[few] > d]
        x, y = few[d:], few[:-d]
        ok = key[x] == key[y]
        ok[ok] = _shared(near[x[ok]], near[y[ok]])
        yield x[ok], y[ok]
    for at, n in zip(start[size > CROWD + 1].tolist(), size[size > CROWD + 1].tolist(), strict=True):
        order = at + np.argsort(doc[at : at + n], kind="stable")
        for i, k in _firsts(near[order]):
            yield order[i], order[k]


def _links(windows: DataFrame, min_words: int) -> DataFrame:
    """(a, b, shift, lo, hi): windows of equal minima in documents a < b; place in b = place in a - shift."""
    length = min_words - SHINGLE + 1

    def links(doc: np.ndarray, place: np.ndarray, to: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Of windows in different documents that share enough for a passage."""
        swap = doc < to
        a, b = np.where(swap, doc, to), np.where(swap, to, doc)
        (ca, la, ra), (cb, lb, rb) = (_window(np.where(s, place, at)) for s in (swap, ~swap))
        shift = ca - cb
        lo, hi = np.maximum(la, lb + shift), np.minimum(ra, rb + shift)
        ok = (a != b) & (hi - lo + 1 >= length)
        return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, b, shift, lo, hi)], ["a", "b", "shift", "lo", "hi"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros((0, len(_NEAR)), np.int64), *[np.zeros(0, np.int64)] * 2]  # of the last group the first row of each surroundings

        def linked(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, near, doc, place = rows
            some, n = [], 0
            for pair in _partners(key, near, doc):
                some.append(pair)
                n += len(pair[0])
                if n > PAIRS:
                    i, k = (np.concatenate(x) for x in zip(*some, strict=True))
                    yield links(doc[i], place[i], doc[k], place[k])
                    some, n = [], 0
            if n:
                i, k = (np.concatenate(x) for x in zip(*some, strict=True))
                yield links(doc[i], place[i], doc[k], place[k])

        for batch in batches:
            key, doc, place, to, at = (batch[c].to_numpy() for c in ("key", "doc", "place", "to", "at"))
            near, tied = np.stack([batch[c].to_numpy() for c in _NEAR], 1), at >= 0
            if tied.any():
                yield links(*(x[tied] for x in (doc, place, to, at)))
            key, near, doc, place = (np.concatenate([h, x[~tied]]) for h, x in zip(held, (key, near, doc, place), strict=True))
            if not len(key):
                continue
            mark = _changes(key) | _changes(near)
            first = _starts(mark)[~mark]
            yield links(doc[~mark], place[~mark], doc[first], place[first])
            held = rows = [x[mark] for x in (key, near, doc, place)]
            if len(rows[0]) < ROWS:
                continue
            last = np.searchsorted(rows[0], rows[0][-1])  # the last group may go on
            yield from linked([x[:last] for x in rows])
            held = [x[last:] for x in rows]
        yield from linked(held)

    together = windows.repartition("key").sortWithinPartitions("key", *_NEAR, "doc", "place")
    return together.mapInArrow(scan, "a long, b long, shift long, lo long, hi long")


def _follow(runs: list[list[int]], best: np.ndarray, back: np.ndarray) -> None:
    """_chain()'s best and back of few runs, one by one."""
    value = best.tolist()
    for k in range(1, len(runs)):
        i, j, n = runs[k]
        most, of = 0, -1
        for m in range(k):
            s, t, size = runs[m]
            if t <= j and (lost := max(0, s + size - i, t + size - j)) < n:
                gain = value[m] - lost - 1e-5 * min(abs(s - t - i + j), 500)
                if gain > most:
                    most, of = gain, m
        value[k] += most
        best[k], back[k] = value[k], of


def _chain(runs: np.ndarray) -> tuple[list[int], bool]:
    """The runs (start in a, start in b, length), sorted, that follow each other in both texts and are longest together.

    Also whether any run follows another.
    """
    best, back = runs[:, 2].astype(float), np.full(len(runs), -1)
    if len(runs) <= FEW:
        _follow(runs.tolist(), best, back)
    else:
        i, j, n = (np.ascontiguousarray(c, dtype=float) for c in runs.T)
        shift, ends, lost, moved, gain = i - j, (i + n, j + n), *(np.empty(len(runs)) for _ in range(3))
        for k in range(1, len(runs)):
            np.subtract(ends[0][:k], i[k], out=lost[:k])
            np.subtract(ends[1][:k], j[k], out=moved[:k])
            np.maximum(lost[:k], moved[:k], out=lost[:k])
            np.maximum(lost[:k], 0, out=lost[:k])  # of a run that begins before the other ends, the rest counts
            np.subtract(shift[:k], shift[k], out=moved[:k])
            np.abs(moved[:k], out=moved[:k])
            np.minimum(moved[:k], 500, out=moved[:k])
            np.multiply(moved[:k], 1e-5, out=moved[:k])
            np.subtract(best[:k], lost[:k], out=gain[:k])
            np.subtract(gain[:k], moved[:k], out=gain[:k])
            np.multiply(gain[:k], (lost[:k] < n[k]) & (j[:k] <= j[k]), out=gain[:k])
            if gain[m := int(gain[:k].argmax())] > 0:
                back[k] = m
                best[k] += gain[m]
    out, k = [], int(best.argmax())
    while k >= 0:
        out.append(k)
        k = int(back[k])
    return out[::-1], bool((back >= 0).any())


def _judged(runs: np.ndarray, min_shingles: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Maximal stretches of a chain of runs that are similar enough, (start, end) in a and in b.

    Of s and t places with e equal, the Jaccard similarity is e / (s + t - e).
    """
    if len(runs) == 1:
        i, j, n = runs[0].tolist()
        return [(i, i + n, j, j + n)] if n >= min_shingles else []
    whole, before = [], None
    for i, j, n in runs.tolist():
        lost = max(0, before[0] - i, before[1] - j) if before else 0
        before = i + n, j + n
        whole.append((i + lost, j + lost, n - lost))
    rows = np.array(whole)
    start, length = rows[:, :2], rows[:, 2]
    end, share = start + length[:, None], similarity / (1 + similarity)
    equal = np.cumsum(length)
    upto, since = equal - share * (end[:, 0] + end[:, 1]) + 1e-9, equal - length - share * (start[:, 0] + start[:, 1])
    most = np.maximum.accumulate(upto[::-1])  # of each run and all that follow, the last first
    last = len(runs) - 1 - np.searchsorted(most, since)  # the last run that is similar up to there; one alone always is
    out, reach = [], -1
    for k, to in enumerate(last.tolist()):
        if to > reach:
            reach = to
            (i, j, _), (s, t, n) = whole[k], whole[to]
            if min(s + n - i, t + n - j) >= min_shingles:
                out.append((i, s + n, j, t + n))
    return out


def _runs(x: np.ndarray, y: np.ndarray, shifts: Iterable[int]) -> np.ndarray:
    """Equal runs (start in x, start in y, length) where x's place is y's place + shift."""
    out = [np.zeros((0, 3), np.int64)]
    for d in shifts:
        i, j = max(0, d), max(0, -d)
        n = min(len(x) - i, len(y) - j)
        if n > 0:
            same = np.zeros(n + 2, bool)
            np.equal(x[i : i + n], y[j : j + n], out=same[1:-1])
            edge = np.flatnonzero(same[1:] != same[:-1])
            some = np.empty((len(edge) // 2, 3), np.int64)
            some[:, 0], some[:, 1], some[:, 2] = edge[::2] + i, edge[::2] + j, edge[1::2] - edge[::2]
            out.append(some)
    return np.concatenate(out)


def _further(x: np.ndarray, y: np.ndarray, runs: np.ndarray) -> list[int]:
    """Shifts at which two equal shingles follow each other outside the runs.

    Two that stand in y over REPEATS times are set against each other place by place, without a list of all their pairs.
    """
    free = [np.ones(len(x), bool), np.ones(len(y), bool)]
    for i, j, n in runs[runs[:, 2] > 1].tolist():
        free[0][i : i + n] = free[1][j : j + n] = False
    at = [np.flatnonzero(f[:-1] & f[1:]) for f in free]
    two = [z[i] * _P ^ z[i + 1] for z, i in zip((x, y), at, strict=True)]
    if set(two[0].tolist()).isdisjoint(two[1].tolist()):
        return []
    order = np.argsort(two[1], kind="stable")
    first, last = (np.searchsorted(two[1][order], two[0], side) for side in ("left", "right"))
    n = np.where(last - first <= REPEATS, last - first, 0)
    place = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    met = np.zeros(len(x) + len(y), bool)
    met[np.repeat(at[0], n) - at[1][order[place]] + len(y)] = True
    for k in np.flatnonzero(last - first > REPEATS).tolist():
        met[at[0][k] - at[1][order[first[k] : last[k]]] + len(y)] = True
    return (np.flatnonzero(met) - len(y)).tolist()


def _telling(runs: np.ndarray, size: tuple[int, int], min_shingles: int) -> np.ndarray:
    """The runs without those whose places, in both texts, belong to other runs that are passages themselves.

    Words that repeat over and over are equal at hundreds of shifts; taken in a mixed order, few of these tell anything.
    Where a place belongs to shorter runs only, the runs up to DRIFT words beside their shifts stay, as they may be what
    makes it part of a passage.
    """
    seen = [np.zeros(n, bool) for n in size]
    mixed = _mix(np.arange(len(runs), dtype=np.uint64))
    keep = []
    for k in np.lexsort((mixed, -runs[:, 2])).tolist():
        i, j, n = runs[k].tolist()
        here = seen[0][i : i + n], seen[1][j : j + n]
        if here[0].all() and here[1].all():
            continue
        keep.append(k)
        if n >= min_shingles:
            here[0][:] = here[1][:] = True
    kept, shift = np.zeros(len(runs), bool), runs[:, 0] - runs[:, 1]
    kept[keep] = True
    if (short := kept & (runs[:, 2] < min_shingles)).any():
        least = np.sort(shift[short])
        kept |= np.searchsorted(least, shift - DRIFT) < np.searchsorted(least, shift + DRIFT, "right")
    return runs[kept]


def _dense(equal: np.ndarray, min_shingles: int, similarity: float) -> np.ndarray:
    """Of each place, whether it is in a stretch of min_shingles or more of which the share `similarity` is equal.

    A passage has e equal shingles of the s on its side, and e >= similarity * (s + t - e) >= similarity * s. So it lies
    in such stretches in both texts, whichever of the equal places make it up.
    """
    over = np.concatenate([np.zeros(1), np.cumsum(equal - similarity)])
    most = np.maximum.accumulate(over[::-1])  # from each place on, the last first
    to = len(equal) - np.searchsorted(most, over - 1e-6)
    to[to - np.arange(len(to)) < min_shingles] = 0
    return np.maximum.accumulate(to)[:-1] > np.arange(len(equal))


def _promising(runs: np.ndarray, size: tuple[int, int], min_shingles: int, similarity: float) -> bool:
    """Whether any run can be part of a passage: not where too few places beside it are in runs that can, in either text."""
    while len(runs):
        kept = np.ones(len(runs), bool)
        for start, n in zip(runs.T, size, strict=False):
            edge = np.bincount(start, minlength=n + 1) - np.bincount(start + runs[:, 2], minlength=n + 1)
            total = np.concatenate([[0], np.cumsum(_dense(np.cumsum(edge)[:-1] > 0, min_shingles, similarity))])
            kept &= total[start + runs[:, 2]] > total[start]
        if kept.all():
            return True
        runs = runs[kept]
    return False


def similar_passages(x: np.ndarray, y: np.ndarray, shifts: Iterable[int], min_shingles: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Similar stretches of the shingle hashes x and y, (start, end) in x and in y, across inserted and deleted words.

    shifts: where links put x against y; others are found by equal shingles, two in a row, that the links leave over.
    """
    shifts = set(shifts)
    runs = _runs(x, y, shifts)
    need = 2 * similarity / (1 + similarity) * min_shingles  # no passage has fewer equal shingles
    if runs[:, 2].sum() < need:
        known = np.fromiter(map(set(y.tolist()).__contains__, x.tolist()), bool, len(x))
        if known.sum() < need or not _dense(known, min_shingles, similarity).any():
            return []
    if further := set(_further(x, y, runs)) - shifts:
        more = _runs(x, y, further)
        runs = np.concatenate([runs, more[more[:, 2] > 1]])
    if len(shifts | further) == 1:  # in order already
        return _judged(runs, min_shingles, similarity) if len(runs) else []
    size = len(x), len(y)
    if len(runs) > FEW and not _promising(runs, size, min_shingles, similarity):
        return []
    runs, out = _telling(runs[np.lexsort((runs[:, 1], runs[:, 0]))], size, min_shingles), []
    seen = np.zeros(len(x) + 1, np.int64), np.zeros(len(y) + 1, np.int64)

    def left(runs: np.ndarray, found: list[tuple[int, int, int, int]]) -> np.ndarray:
        """The runs with places, in either text, outside of all that is found."""
        for s, e, t, u in found:
            seen[0][s + 1 : e + 1] = seen[1][t + 1 : u + 1] = 1
        new = [np.cumsum(z)[c + runs[:, 2]] - np.cumsum(z)[c] < runs[:, 2] for z, c in zip(seen, runs[:, :2].T, strict=True)]
        return new[0] | new[1]

    # whole chains first: a shift alone would leave their short ends over
    first = True
    while runs[:, 2].sum() >= need and (len(runs) <= FEW or _promising(runs, size, min_shingles, similarity)):
        chain, follows = _chain(runs)
        if not follows:
            return out + [z for k in range(len(runs)) for z in _judged(runs[k : k + 1], min_shingles, similarity)]
        if runs[chain, 2].sum() < need - 1:  # the others have fewer
            break
        found = _judged(runs[chain], min_shingles, similarity)
        out += found
        rest = np.ones(len(runs), bool)
        rest[chain] = False
        if first:  # and then each shift, whatever the chain took from it
            first, shift = False, runs[:, 0] - runs[:, 1]
            enough = [d for d in np.unique(shift).tolist() if runs[shift == d, 2].sum() >= need]
            alone = [z for d in enough for z in _judged(runs[shift == d], min_shingles, similarity)]
            alone = [z for z in alone if not any(s <= z[0] and z[1] <= e and t <= z[2] and z[3] <= u for s, e, t, u in found)]
            out += alone
            found = found + alone
        runs = runs[rest & left(runs, found)]
    return out


def _hashed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, lo, hi, a, b, words): hashes of WORD_BYTES of the words of the shingles lo .. hi of each span asked for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            texts, asked, ids = batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist(), batch["id"].to_pylist()
            for at in range(0, len(texts), 256):
                out = []
                h, n = words.hashes(texts[at : at + 256])
                ends = np.cumsum(n)
                for i, (end, size) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
                    code = h[end - size : end].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
                    out += [(ids[at + i], s["lo"], s["hi"], s["a"], s["b"], code[s["lo"] : s["hi"] + SHINGLE - 1].tobytes()) for s in asked[at + i]]
                cols = list(zip(*out, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "lo", "hi", "a", "b", "words"])
        del words
        common.release()

    wanted = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "a", "b")).alias("spans"))
    both = docs.join(wanted, docs["id"] == wanted["doc"]).select("id", "text", "spans")
    found = both.mapInArrow(of, "doc long, lo long, hi long, a boolean, b boolean, words binary")
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("doc", "lo", "hi").agg(*[F.max(c).alias(c) for c in ("a", "b")], F.min("words").alias("words"))


def _shingles(words: pa.Array) -> list[np.ndarray]:
    """The 64-bit hashes of the shingles of each row's words, all rows rolled at once."""
    data = words.to_pylist()
    ends = np.cumsum([len(x) // WORD_BYTES for x in data])
    wide = np.zeros((int(ends[-1]) if len(ends) else 0, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, WORD_BYTES)
    h = _rolled(wide.view("<u8").ravel().astype(np.uint64), SHINGLE)
    return [h[a : max(a, b - SHINGLE + 1)] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hashes: int = HASHES, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified near-duplicate passages (a, a_start, a_end, b, b_start, b_end), a < b, places in words. Written to disk."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    links = _links(_windows(docs, hashes, min_words), min_words)
    links = links.repartition("a", "b").groupBy("a", "b", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = W.partitionBy("a", "b").orderBy("shift")
    links = links.withColumn("new", F.coalesce(F.col("shift") - F.lag("shift").over(order) > DRIFT, F.lit(True)).cast("int"))
    links = links.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # two similar passages differ in length by a quarter at most, and so does what a link's common span may leave out
    more = F.ceil((F.col("hi") - F.col("lo") + 1) * ((1 - similarity) / similarity))
    links = links.withColumns({"lo": F.col("lo") - more, "hi": F.col("hi") + more})
    links = links.groupBy("a", "b", "island").agg(
        F.collect_list("shift").alias("shifts"),
        F.min("lo").alias("a_lo"),
        F.max("hi").alias("a_hi"),
        F.min(F.col("lo") - F.col("shift")).alias("b_lo"),
        F.max(F.col("hi") - F.col("shift")).alias("b_hi"),
    )
    down = lambda c: F.greatest(F.floor(F.col(c) / STEP) * STEP, F.lit(0))
    up = lambda c: (F.floor(F.col(c) / STEP) + 1) * STEP
    links = links.withColumns({"a_lo": down("a_lo"), "a_hi": up("a_hi"), "b_lo": down("b_lo"), "b_hi": up("b_hi")})
    links, links_path = common.materialise(links, WINDOW_BYTES)
    side = lambda x: links.select(F.col(x).alias("doc"), F.col(f"{x}_lo").alias("lo"), F.col(f"{x}_hi").alias("hi"), F.lit(x == "a").alias("a"), F.lit(x == "b").alias("b"))
    spans = side("a").union(side("b")).groupBy("doc", "lo", "hi").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    hashed, hashed_path = common.materialise(_hashed(docs, spans), WINDOW_BYTES)
    of = lambda x: hashed.where(x).select(F.col("doc").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"), F.col("words").alias(f"{x}_words"))
    pairs = links.join(of("b"), ["b", "b_lo", "b_hi"]).join(of("a"), ["a", "a_lo", "a_hi"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = min_words - SHINGLE + 1
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = batch.select(["a", "b", "shifts", "a_lo", "b_lo"]).to_pylist()
            out = []
            for p, x, y in zip(rows, _shingles(batch["a_words"]), _shingles(batch["b_words"]), strict=True):
                shifts = [d - p["a_lo"] + p["b_lo"] for d in p["shifts"]]
                for s, e, t, u in similar_passages(x, y, shifts, least, similarity):
                    ends = SHINGLE - 1
                    out.append((p["a"], p["a_lo"] + s, p["a_lo"] + e + ends, p["b"], p["b_lo"] + t, p["b_lo"] + u + ends))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "a_start", "a_end", "b", "b_start", "b_end"])

    needed = pairs.select("a", "b", "shifts", "a_lo", "b_lo", "a_words", "b_words")
    out, _ = common.materialise(needed.mapInArrow(verified, "a long, a_start long, a_end long, b long, b_start long, b_end long"), WINDOW_BYTES)
    common.discard(spark, links_path, hashed_path)
    return out


def _islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping spans (start, end, first) of the same `by` merged; first: the smallest of theirs, n: their number."""
    spans = spans.groupBy(*by, "start", "end").agg(F.min("first").alias("first"), F.sum("n").alias("n"))  # copies share spans
    order = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"), F.sum("n").alias("n")).drop("island")


def repeated(found: DataFrame) -> DataFrame:
    """Every document's passages: (doc_id, start_word, end_word, first_doc_id, n_links, keep).

    keep: the passage stands first here (first_doc_id is the document itself); otherwise first_doc_id is the smallest
    document that it was found in before this one.
    """
    later = found.select(F.col("b").alias("doc_id"), F.lit(False).alias("keep"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("a").alias("first"), F.lit(1).alias("n"))
    firsts = found.select(F.col("a").alias("doc_id"), F.lit(True).alias("keep"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("a").alias("first"), F.lit(1).alias("n"))
    out = _islands(later.union(firsts), ["doc_id", "keep"])
    return out.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("first").alias("first_doc_id"), F.col("n").cast("long").alias("n_links"), "keep")


def _without(text: str | None, spans: list[dict]) -> str:
    """The text without the words of the spans and the white space behind them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start_word"]):
        a, b = starts[min(s["start_word"], len(starts) - 1)], starts[min(s["end_word"], len(starts) - 1)]
        out.append(data[at:a])
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def deduplicated(df: DataFrame, found: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df without the passages that near-duplicate one of a smaller id; rows that lose all their words are left out."""
    found = passages(df, doc_id, text, **options) if found is None else found
    later = repeated(found).where(~F.col("keep")).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans"))

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([_without(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    joined = df.join(later, F.col(doc_id) == F.col("__doc"), "left")
    touched = joined.where(F.col("__spans").isNotNull())
    touched = touched.withColumn("__text", F.arrow_udf(cut, "string")(F.col(text), F.col("__spans"))).where(F.col("__text").rlike(common.WORD))
    untouched = joined.where(F.col("__spans").isNull())
    changed = touched.withColumn(text, F.col("__text")).select(*df.columns)
    return untouched.select(*df.columns).union(changed)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated(passages(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
