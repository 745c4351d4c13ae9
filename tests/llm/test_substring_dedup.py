import random

import numpy as np
import pyarrow as pa
import pytest
from corpus import awkward, documents, prose

from planloom import storage
from planloom.llm import substring_dedup as D


def brute_windows(values, length):
    """Every Cartesian tree node with a span of at least length, (l, c, r)."""
    out, todo = set(), [(0, len(values) - 1)]
    while todo:
        l, r = todo.pop()
        if r - l + 1 >= length:
            c = min(range(l, r + 1), key=lambda i: (values[i], i))
            out.add((l, c, r))
            todo += [(l, c - 1), (c + 1, r)]
    return out


@pytest.mark.parametrize("vocabulary", [3, 1000])
def test_windows_are_the_cartesian_tree(vocabulary):
    r = random.Random(vocabulary)
    texts = [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(n)) for n in (0, 3, 49, 50, 51, 400, 0, 77)]
    words = D.Words()
    h, n = words.hashes([t.encode() for t in texts])
    found = {}
    for doc, key, _, c, left, right in D.windows_of(h, n, hashes=1, min_words=50):
        for x in zip(doc.tolist(), left.tolist(), c.tolist(), right.tolist(), key.tolist(), strict=True):
            found.setdefault(x[0], set()).add(x[1:4])
    starts = np.cumsum(n) - n
    for i, size in enumerate(n.tolist()):
        sh = D._mix(D._rolled(h, D.SHINGLE)[starts[i] : starts[i] + max(0, size - 4)] + np.uint64(0xD6E8FEB86659FD93))
        assert found.get(i, set()) == brute_windows(sh.tolist(), 46)


def brute_stretches(same, least, similarity):
    """All maximal similar stretches of places, at least `least` long, that begin and end with an equal one."""
    n, total = len(same), np.concatenate([[0], np.cumsum(same)])
    good = set()
    for s in np.flatnonzero(same).tolist():
        for e in (np.flatnonzero(same[s:]) + s + 1).tolist():
            equal = total[e] - total[s]
            if e - s >= least and equal >= similarity * (2 * (e - s) - equal) - 1e-9:
                good.add((s, e))
    return sorted((s, e) for s, e in good if not any((t, u) != (s, e) and t <= s and e <= u for t, u in good))


def test_maximal_stretches():
    """Of one shift, against all stretches: none missed, none shortened."""
    r = np.random.default_rng(8)
    held = 0
    for _ in range(400):
        same = np.ones(int(r.integers(46, 160)), bool)
        for k in r.integers(0, len(same), int(r.integers(1, 7))):
            same[k : k + 5] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        runs = np.stack([edge[::2], edge[::2], edge[1::2] - edge[::2]], 1)
        expected = brute_stretches(same, 46, 0.8)
        got = D._judged(runs, 46, 0.8) if len(runs) else []
        assert [(s, e) for s, e, *_ in got] == expected
        held += len(expected)
    assert held > 100


def test_gaps_between_short_runs():
    """14 equal places, 5 not, 3, 5 not, 37, 5 not, 6: the middle 48 qualify although the start does not."""
    x = np.arange(75, dtype=np.uint64)
    y, at = x.copy(), 0
    for equal, other in ((14, 5), (3, 5), (37, 5)):
        at += equal
        y[at : at + other] += np.uint64(1000)
        at += other
    assert (27, 75, 27, 75) in D.similar_passages(x, y, [0], 46, 0.8)


def test_against_brute_force(spark):
    """All passages of 50 words that another document repeats exactly, and nothing in clean documents."""
    r = random.Random(6)
    passages = [prose(100 + i, 50 + 15 * i) for i in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(1000 + i, r.randrange(120), 2000)]
        if i % 3 == 0:
            parts += [r.choice(passages), prose(3000 + i, r.randrange(80), 2000)]
        if i % 10 == 0:
            parts.append(r.choice(passages))
        rows.append((i, "\n ".join(parts), "en", "s", 1))
    rows += [(500 + i, rows[3][1], "en", "s", 1) for i in range(5)]  # copies
    rows += [(600, "boilerplate line of ten common words for every page here\n" + prose(1, 60, 5000), "en", "s", 1)]
    rows += [(601, "boilerplate line of ten common words for every page here\n" + prose(2, 60, 5000), "en", "s", 1)]
    found = D.passages(documents(spark, rows))
    spans = {}
    for x in D.repeated(found).collect():
        spans.setdefault((x["doc_id"], x["keep"]), set()).update(range(x["start_word"], x["end_word"]))
    seen, later, anywhere = {}, {}, {}
    words = {i: t.split() for i, t, *_ in rows}
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                anywhere.setdefault(i, set()).update(range(k, k + 50))
                if i > min(places)[0]:
                    later.setdefault(i, set()).update(range(k, k + 50))
    for i, expected in later.items():
        assert expected <= spans.get((i, False), set()), i
    for i, expected in anywhere.items():
        assert expected <= spans.get((i, False), set()) | spans.get((i, True), set()), i
    assert {i for i, _ in spans} == set(anywhere)
    extra = sum(len(spans.get((i, False), set()) - later.get(i, set())) for i in words)
    assert extra <= 0.02 * sum(map(len, later.values()))


def test_near_duplicates(spark):
    rows, caught = [], 0
    for i in range(40):
        words = prose(i, 150, 3000).split()
        rows.append((2 * i, " ".join(words), "en", "s", 1))
        for k in (40, 110):
            words[k] = f"new{i}"
        rows.append((2 * i + 1, f"other start {i} " + " ".join(words), "en", "s", 1))
    got = {(x["a"], x["b"]): (x["a_end"] - x["a_start"]) for x in D.passages(documents(spark, rows)).collect()}
    caught = sum(got.get((2 * i, 2 * i + 1), 0) >= 145 for i in range(40))
    assert caught >= 39 and all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_inserted_and_deleted_words(spark):
    """Passages whose words move are one passage, not the pieces between the changes."""
    rows = []
    for i in range(40):
        own = [prose(7000 + 4 * i + j, 40, 3000) for j in range(4)]
        words = prose(200 + i, 94 if i < 20 else 480, 3000).split()
        other = [*words[:47], f"new{i}", *words[47:]] if i < 20 else [w for k, w in enumerate(words) if k % 48 != 47]
        rows.append((2 * i, " ".join([own[0], *words, own[1]]), "en", "s", 1))
        rows.append((2 * i + 1, " ".join([own[2], *other, own[3]]), "en", "s", 1))
    got = D.passages(documents(spark, rows)).collect()
    assert all(x["b"] == x["a"] + 1 and x["a"] % 2 == 0 for x in got)
    whole = {x["a"]: (x["a_start"], x["a_end"], x["b_start"], x["b_end"]) for x in got}
    for i in range(40):
        expected = (40, 134, 40, 135) if i < 20 else (40, 519, 40, 510)
        assert whole.get(2 * i) == expected, i


def test_passages_in_another_order():
    r = np.random.default_rng(1)
    p, q, other = (r.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(3))
    got = D.similar_passages(np.concatenate([p, other, q]), np.concatenate([q, p]), [-60, 120], 46, 0.8)
    assert sorted(got) == [(0, 60, 60, 120), (120, 180, 0, 60)]


def test_cutting(spark):
    shared = prose(50, 80)
    rows = [
        (1, f"first words\n{shared}\nlast words", "en", "s", 1),
        (2, f"Some  other\ntexts {shared}  and an end.", "en", "s", 1),
        (3, shared, "en", "s", 1),
        (4, None, "en", "s", 1),
        (None, shared, "en", "s", 1),
        (5, f"{shared} é {shared}", "en", "s", 1),
    ]
    out = {r["doc_id"]: r["text"] for r in D.deduplicated(documents(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "Some  other\ntexts and an end.", 4: None, None: shared, 5: "é "}


def test_awkward(spark):
    rows = [x for x in awkward() if x[0] != 3]
    got = D.repeated(D.passages(documents(spark, rows))).collect()
    links = {(x["doc_id"], x["first_doc_id"]) for x in got if not x["keep"]}
    assert links == {(2, 1), (13, 12)}
    kept = D.deduplicated(documents(spark, rows))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted((x[0] or 0) for x in rows if x[0] != 2)
    empty = documents(spark, [])
    assert D.repeated(D.passages(empty)).collect() == [] and D.deduplicated(empty).collect() == []
    clash = documents(spark, rows).selectExpr("*", "1 AS id", "2 AS spans", "3 AS a", "4 AS doc")
    assert D.deduplicated(clash).columns == clash.columns


def brute_pair(x, y):
    """Words of y inside a passage that near-duplicates one of x at the same distance, replaced words only."""
    known = {}
    out, (a, b) = set(), (np.array([known.setdefault(tuple(w[i : i + 5]), len(known)) for i in range(len(w) - 4)]) for w in (x, y))
    for shift in range(-40, 41):
        i, j = max(0, shift), max(0, -shift)
        n = min(len(a) - i, len(b) - j)
        if n >= 46:
            same = a[i : i + n] == b[j : j + n]
            if same.sum() >= 41:
                for s, e in brute_stretches(same, 46, 0.8):
                    out |= set(range(j + s, j + e + 4))
    return out


def crowd(n, changes):
    """n documents with a passage of 120 words, in each of them other words replaced."""
    r, shared, rows = random.Random(n), prose(900, 120, 3000).split(), []
    for i in range(n):
        p = list(shared)
        for k in r.sample(range(120), r.randint(*changes)):
            p[k] = f"w{i}x{k}"
        own = [prose(9100 + 2 * i + j, r.randrange(5, 40), 3000) for j in (0, 1)]
        rows.append((i, " ".join([own[0], *p, own[1]]), "en", "s", 1))
    return rows


@pytest.mark.parametrize("changes", [(1, 2), (2, 5)])
def test_crowded_near_duplicates(spark, changes):
    """Of the words that near-duplicate an earlier document's, by brute force, 0.97 are found, and all the documents."""
    rows = crowd(60, changes)
    spans = {}
    for x in D.passages(documents(spark, rows)).collect():
        spans.setdefault(x["b"], set()).update(range(x["b_start"], x["b_end"]))
    words = [t.split() for _, t, *_ in rows]
    truth = {b: set().union(*(brute_pair(words[a], words[b]) for a in range(b))) for b in range(1, 60)}
    truth = {b: w for b, w in truth.items() if w}
    found = sum(len(w & spans.get(b, set())) for b, w in truth.items())
    assert len(truth) > 40 and all(b in spans for b in truth)
    assert found >= 0.97 * sum(map(len, truth.values()))


def test_far_places(spark):
    """A copy of a text longer than a window's reach is found whole."""
    long = prose(61, D.REACH + 9000, 50_000)
    got = D.repeated(D.passages(documents(spark, [(1, long, "en", "s", 1), (2, "not here " + long, "en", "s", 1)]))).collect()
    assert {(x["doc_id"], x["start_word"], x["end_word"]) for x in got} == {(1, 0, D.REACH + 9000), (2, 2, D.REACH + 9002)}
    c = np.array([0, 5, (1 << 31) - 1])
    assert [x.tolist() for x in D._window(D._placed(c, c - 0, c + 3))] == [c.tolist(), c.tolist(), (c + 3).tolist()]


def test_ties_keep_their_own_rows():
    """Only windows with equal marks on both sides are tied before the shuffle, up to SPARE of each first side."""
    n = 3 * D.SPARE
    near = (7 << 32) + np.arange(1, n + 1)
    key, _, doc, _, to, at = D._combined(np.full(n, 9), near, np.arange(n), np.full(n, 1 << 32))
    assert (at < 0).sum() == D.SPARE and set(to[at >= 0].tolist()) == {0} and (key[at < 0] == 9).all()
    key, *_, at = D._combined(np.full(3, 9), np.full(3, 7 << 32), np.arange(3), np.full(3, 1 << 32))
    assert (at >= 0).sum() == 2


def test_further_chains_of_many_runs():
    """Two stretches in another order, of 135 and 145 equal runs with words inserted between them, are both whole."""
    r = np.random.default_rng(4)

    def stretch(blocks):
        x = r.integers(0, 1 << 62, 40 * blocks).astype(np.uint64)
        return x, np.concatenate([z for k in range(blocks) for z in (x[40 * k : 40 * k + 40], r.integers(0, 1 << 62, 4).astype(np.uint64))][:-1])

    (a, a2), (b, b2) = stretch(145), stretch(135)
    shifts = [len(a) - 4 * k for k in range(135)] + [-len(b2) - 4 * k for k in range(145)]
    got = D.similar_passages(np.concatenate([a, b]), np.concatenate([b2, a2]), shifts, 46, 0.8)
    assert {(0, len(a), len(b2), len(b2) + len(a2)), (len(a), len(a) + len(b), 0, len(b2))} <= set(got)


def test_shifts_of_words_that_repeat():
    """Shingles that stand in a text over REPEATS times show where the texts go on, too."""
    n = D.REPEATS + 10
    x, y = np.arange(3, dtype=np.uint64), np.concatenate([np.arange(50, 60, dtype=np.uint64), np.tile(np.arange(3, dtype=np.uint64), n)])
    assert D._further(x, y, np.zeros((0, 3), np.int64)) == [-10 - 3 * k for k in range(n - 1, -1, -1)]
    assert D._further(np.tile(x, 20), y, np.zeros((0, 3), np.int64)) == [d for d in range(-10 - 3 * (n - 1), 58 - 10, 3) if d <= 47]


def test_every_set_of_marks_has_its_first_row(monkeypatch):
    """A row is linked to each earlier one that shares a mark, but where a still earlier one shares all of that."""
    r = np.random.default_rng(2)
    marks = r.integers(0, 4, (150, 2 * D.BINS))  # 0: no mark
    near = np.stack([sum(marks[:, 3 * k + j] << bit for j, bit in enumerate((42, 21, 0))) for k in range(len(D._NEAR))], 1)
    expected = set()
    for i, x in enumerate(marks):
        seen = []
        for k, y in enumerate(marks[:i]):
            common = frozenset(np.flatnonzero((x == y) & (x > 0)).tolist())
            if common and not any(common <= s for s in seen):
                expected.add((i, k))
            seen.append(common)
    for wide in (D.WIDE, 10):
        monkeypatch.setattr(D, "WIDE", wide)
        got = [z for i, k in D._firsts(near) for z in zip(i.tolist(), k.tolist(), strict=True)]
        assert set(got) == expected, wide
    got = [z for i, k in D._partners(np.full(150, 7), near, np.arange(150)) for z in zip(i.tolist(), k.tolist(), strict=True)]
    assert set(got) == expected
    few = D.CROWD + 1  # and all pairs of a smaller group
    got = [z for i, k in D._partners(np.full(few, 7), near[:few], np.arange(few)) for z in zip(i.tolist(), k.tolist(), strict=True)]
    assert set(got) == {(i, k) for i in range(few) for k in range(i) if ((marks[i] == marks[k]) & (marks[i] > 0)).any()}


@pytest.mark.parametrize("changes", [(1, 2), (2, 5)])
def test_crowd_is_whole(spark, changes):
    """All words that near-duplicate an earlier document's, by brute force over all pairs."""
    rows, spans = crowd(60, changes), {}
    for x in D.passages(documents(spark, rows)).collect():
        spans.setdefault(x["b"], set()).update(range(x["b_start"], x["b_end"]))
    words = [t.split() for _, t, *_ in rows]
    for b in range(1, 60):
        assert set().union(*(brute_pair(words[a], words[b]) for a in range(b))) <= spans.get(b, set()), b


def periodic(periods, common, own, seed):
    """Texts that repeat `common` words and then, each anew, `own` words that it never has again."""
    r = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([np.arange(common, dtype=np.uint64), r.integers(1 << 40, 1 << 62, own).astype(np.uint64)]) for _ in range(periods)])


def test_hopeless_pairs_are_not_chained(monkeypatch):
    """Of texts with 18 equal places in every 30 at hundreds of shifts, none is a passage: no chain is looked for."""
    chains, chain = [], D._chain
    monkeypatch.setattr(D, "_chain", lambda runs: chains.append(len(runs)) or chain(runs))
    assert D.similar_passages(periodic(40, 18, 12, 1), periodic(40, 18, 12, 2), [0, 30], 46, 0.8) == [] and not chains
    x, y = periodic(40, 18, 12, 1), periodic(40, 18, 12, 2)
    x[600:700] = y[300:400] = np.arange(1000, 1100)  # but the passage in them is found
    assert any(s <= 600 and 700 <= e and t <= 300 and 400 <= u for s, e, t, u in D.similar_passages(x, y, [0, 300], 46, 0.8)) and chains


def test_places_that_may_be_in_a_passage():
    """By brute force: all stretches of 46 or more places of which 0.8 are equal."""
    r = np.random.default_rng(5)
    for share in (0.5, 0.75, 0.8, 0.85):
        for _ in range(20):
            equal = np.repeat(r.random(30) < share, r.integers(1, 9, 30))
            total, expected = np.concatenate([[0], np.cumsum(equal)]), np.zeros(len(equal), bool)
            for s in range(len(equal)):
                for e in range(s + 46, len(equal) + 1):
                    if total[e] - total[s] >= 0.8 * (e - s) - 1e-9:
                        expected[s:e] = True
            assert D._dense(equal, 46, 0.8).tolist() == expected.tolist()


def test_small_batches(spark):
    """A table is written with Python workers' batches of the size given, and the session's own setting stays."""
    seen = "n long, bytes long"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = documents(spark, [(i, "word " * 2000, "en", "s", 1) for i in range(400)]).select("text").coalesce(1)
    before = spark.conf.get(storage._BATCH, None)
    out, path = storage.materialise(docs.mapInArrow(sizes, seen), 1 << 18)
    rows = out.collect()
    storage.discard(spark, path)
    assert sum(x["n"] for x in rows) == 400 and max(x["bytes"] for x in rows) < 1 << 19
    assert spark.conf.get(storage._BATCH, None) == before
