import random

import pytest
import xxhash
from corpus import awkward, documents, prose

from planloom.llm import graph
from planloom.llm import simhash as S


def brute_fingerprint(text, size=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, max_bits):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= max_bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


def test_fingerprints_and_groups(spark):
    rows = awkward()
    base = prose(7, 300)
    r = random.Random(1)
    for i in range(40, 70):  # near copies of several distances
        words = base.split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
    got = S.cluster(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows if i is not None}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    expected = brute_components(prints, 4)
    for x in got:
        if x["doc_id"] is not None:
            assert x["fingerprint"] == f"{prints[x['doc_id']]:016x}"
            assert x["component_id"] == expected[x["doc_id"]]
        else:
            assert x["component_id"] == 1  # that of its copies


@pytest.mark.parametrize("max_bits,segments,run", [(4, None, 20_000), (4, None, 7), (3, None, 20_000), (2, None, 11)])
def test_links_connect_what_brute_force_connects(spark, max_bits, segments, run):
    """Random clusters, also where many classes share keys and where keys are dealt out to cells."""
    r = random.Random(max_bits + run)
    prints = {}
    for c in range(6):
        centre = r.getrandbits(64)
        for _ in range(80 if c == 0 else 12):
            p = centre
            for _ in range(r.randrange(5)):
                p ^= 1 << r.randrange(64)
            prints[len(prints)] = p
    distinct = {}
    for i, p in prints.items():
        distinct.setdefault(p, i)
    nodes = {i: p for p, i in distinct.items()}
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in nodes.items()], "node long, fp binary")
    found = graph.components(S.links(df, max_bits, 1, segments, run)).collect()
    expected = brute_components(nodes, max_bits)
    got = {i: i for i in nodes} | {x["node"]: x["component"] for x in found}
    assert got == expected


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_texts_against_brute_force(spark):
    """Clusters of copies with ever more words replaced: the same groups as all pairs of 0.8 or more give."""
    r, rows = random.Random(4), []
    for i in range(40):
        words = prose(i, 300, 3000).split()
        for j in range(6):
            rows.append((10 * i + j, " ".join(words), "en", "s", 1))
            for k in r.sample(range(300), r.choice((2, 4, 7, 12))):
                words[k] = f"n{i}x{j}x{k}"
    rows += [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, "one two", "en", "s", 1), (1003, "One two", "en", "s", 1)]
    texts = {i: (t or "").lower() for i, t, *_ in rows}
    parent = {i: i for i in texts}
    for a in texts:
        for b in (b for b in texts if b > a and b // 10 == a // 10):
            if jaccard(texts[a], texts[b]) >= 0.8:
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)

    def root(i):
        return i if parent[i] == i else root(parent[i])

    got = {x["doc_id"]: x["component_id"] for x in S.similar(documents(spark, rows)).collect()}
    wrong = {i for i in texts if got[i] != root(i)}
    assert got[1001] == 1000 and got[1003] == 1002
    assert len(wrong) <= 2 and sum(root(i) != i for i in texts) > 100


def test_similar_in_crowds(spark):
    """Near copies by the hundred share their keys; all that are similar to the first are in its group."""
    r, base, rows = random.Random(2), prose(5, 250, 3000).split(), []
    for i in range(400):
        words = list(base)
        for k in r.sample(range(250), r.randrange(1, 3)):
            words[k] = f"n{i}x{k}"
        rows.append((i, " ".join(words), "en", "s", 1))
    got = S.similar(documents(spark, rows)).collect()
    assert {x["component_id"] for x in got} == {0} and len(got) == 400


def crowd(n, least, most):
    """Texts of one base of 250 words, in each of which other words are replaced."""
    r, base = random.Random(3), prose(6, 250, 3000).split()
    texts = []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(250), r.randrange(least, most)):
            words[k] = f"n{i}x{k}"
        texts.append(words)
    return texts


def groups_of(texts):
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    first = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if first[i] != first[j] and len(a & b) >= 0.8 * len(a | b):
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = [new if x == old else x for x in first]
    return first


@pytest.mark.parametrize("block", [2000, 30])
def test_similar_in_crowds_whose_links_often_fail(spark, block):
    """Many of a crowd's proposed links are no links, and its groups are still those of brute force, in cells too."""
    texts = crowd(150, 1, 10)
    expected = groups_of(texts)
    got = S.similar(documents(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]), block=block).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(expected))
    assert 150 > len(set(expected)) > 30


def test_a_crowds_links_grow_with_its_size(spark, monkeypatch):
    """The links that are written and joined are a few for each text, not for each two."""
    written, write = [], S.common.materialise

    def counted(df, *rest):
        out = write(df, *rest)
        written.append(out[0].count() if df.columns == ["u", "v"] else 0)
        return out

    monkeypatch.setattr(S.common, "materialise", counted)
    links = {}
    for n in (150, 600):
        written.clear()
        S.similar(documents(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(crowd(n, 1, 10))]))
        links[n] = sum(written)
    assert 0 < links[600] <= 5.5 * links[150] and links[600] <= 20 * 600


def test_stars():
    r = random.Random(8)
    for n in (1, 5, 60):
        edges = [(r.randrange(100), r.randrange(100)) for _ in range(n)]
        edges += [(i, i + 1) for i in range(200, 200 + n)]
        u, v = S._stars(*S.np.array(edges).T)
        got = dict(zip(u.tolist(), v.tolist(), strict=True))
        least = {x: x for e in edges for x in e}
        for _ in least:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        assert got == {x: m for x, m in least.items() if x != m}
    assert [x.tolist() for x in S._stars(S.np.zeros(0, int), S.np.zeros(0, int))] == [[], []]


def test_far_texts_are_left_alone(spark):
    rows = [(2 * i + j, " ".join([*prose(i, 200, 3000).split(), *prose(50 + 2 * i + j, 60, 3000).split()]), "en", "s", 1) for i in range(25) for j in (0, 1)]
    assert all(x["component_id"] == x["doc_id"] for x in S.similar(documents(spark, rows)).collect())


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    df = spark.createDataFrame([*path, *star, (200, 200), (3, 2)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)}
    assert graph.components(df.where("u < 0")).collect() == []


def test_empty_table_and_clashing_columns(spark):
    assert S.cluster(documents(spark, [])).collect() == [] and S.similar(documents(spark, [])).collect() == []
    clash = documents(spark).selectExpr("*", "1 AS fp", "2 AS id", "3 AS component_id")
    assert S.cluster(clash).count() == len(awkward()) == S.similar(clash).count()
