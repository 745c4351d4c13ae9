import random
import zlib

import pytest
from corpus import awkward, documents, prose

from planloom.llm import quality_classifier as C
from planloom.llm import toxicity as T
from planloom.llm import training

INSULTS = ["blockhead", "nincompoop", "scoundrel", "dunce"]


def labelled(n=400):
    """Documents of which some have insults or shouting, and their labels, a few of them wrong."""
    r, docs, labels = random.Random(5), [], []
    for i in range(n):
        words = prose(i % 7, 80 + i % 150).split()
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((1000 + i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((1000 + i, int(not bad), int(toxic) if i % 37 else 1 - int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    return documents(spark, docs + awkward()), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (None, 0, 7, -5, 123456789)], "doc_id long")
    for r in df.withColumn("h", training.held_out(df["doc_id"])).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_the_sample_is_bounded_and_leaves_out_the_fold(tables):
    docs, labels = tables
    rows = training.labelled(docs, labels, "toxic", 20)
    assert sorted(label for _, label in rows) == [0] * 20 + [1] * 20
    held = {t for i, t, *_ in labelled()[0] if training.fold(i) == 0}
    assert not held & {t for t, _ in training.labelled(docs, labels, "toxic")}


def held_out_accuracy(rows, truth, threshold):
    fold = [r for r in rows if r["doc_id"] in truth and training.fold(r["doc_id"]) == 0]
    assert len(fold) > 40
    return sum((r["score"] >= threshold) == bool(truth[r["doc_id"]]) for r in fold) / len(fold)


def test_toxicity(tables):
    docs, labels = tables
    rows = T.score(docs, T.learn(docs, labels)).collect()
    truth = {i: any(w in t.lower() for w in INSULTS) for i, t, *_ in labelled()[0]}
    assert held_out_accuracy(rows, truth, 0.5) >= 0.95
    assert len(rows) == 400 + len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] < 0.5 for r in rows if not r["text"])


def test_quality(tables):
    docs, labels = tables
    rows = C.score(docs, C.learn(docs, labels)).collect()
    assert held_out_accuracy(rows, {i: q for i, q, _ in labelled()[1]}, C.DECISION) >= 0.95
    assert len(rows) == 400 + len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)


def brute_toxicity(docs, y, text):
    """The score's sum from counts in dictionaries, a word at a time."""
    from collections import Counter
    from math import log

    cut = lambda t: [T._slots(w, {})[0] for w in T._WORD.findall(t.lower())]
    pairs, firsts, follows = [Counter(), Counter()], [Counter(), Counter()], [set(), set()]
    for t, label in zip(docs, y, strict=True):
        words = cut(t)
        for a, b in zip([0, *words], words, strict=False):
            pairs[label][a, b] += 1
            firsts[label][a] += 1
            follows[label].add((a, b))
    kinds = [Counter(b for _, b in f) for f in follows]
    total = [sum(k.values()) for k in kinds]
    after = Counter(a for a, _ in follows[0] | follows[1])
    shared = lambda w: (kinds[0][w] + kinds[1][w] + 0.5) / (sum(total) + 0.5 * T.WORD_SLOTS)
    words, out = cut(text), 0.0
    for a, b in zip([0, *words], words, strict=False):
        n, c = [f[a] for f in firsts], [p[a, b] for p in pairs]
        backoff = min(T.DISCOUNT * after[a] / sum(n), 1) if sum(n) else 1
        p = max(sum(c) - T.DISCOUNT, 0) / max(sum(n), 1) + backoff * shared(b)
        of = []
        for k in (0, 1):
            own = (kinds[k][b] + T.STRENGTH) / (total[k] * shared(b) + T.STRENGTH)
            of.append(own * (c[k] + T.PAIR_STRENGTH) / (n[k] * p * own + T.PAIR_STRENGTH))
        r = log(of[1] / of[0])
        out += (abs(r) > T.DEAD_ZONE) * (abs(r) - T.DEAD_ZONE) * (1 if r > 0 else -1)
    return out / (len(words) + T.PRIOR_WORDS)


def fitted(spark, texts, y):
    """The model of all texts, dealt over both halves and several partitions."""
    rows = [(t, i % 2 * 2 + label) for i, (t, label) in enumerate(zip(texts, y, strict=True))]
    (model,) = T.fit(T.bigrams(spark.createDataFrame(rows, "text string, part int").repartition(3)))
    return model


def test_toxicity_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "HELD_WORDS", 1000)
    docs, labels = labelled(120)
    texts, y = [t for _, t, *_ in docs], [x[2] for x in labels]
    model = fitted(spark, texts, y)
    for t in [*texts[::10], "never seen words", INSULTS[0], " ".join(INSULTS) + " " + texts[3]]:
        assert abs(model.difference(T._slots(t, {})) - brute_toxicity(texts, y, t)) < 1e-4


def test_quality_is_calibrated(tables):
    """Mean and Brier score of the held-out fold against the rate and a constant; features a chunk at a time."""
    import numpy as np
    import zstandard

    docs, labels = tables
    model = C.learn(docs, labels)
    truth = {i: q for i, q, _ in labelled()[1]}
    rows = [r for r in C.score(docs, model).collect() if r["doc_id"] in truth and training.fold(r["doc_id"]) == 0]
    p, y = np.array([r["score"] for r in rows]), np.array([truth[r["doc_id"]] for r in rows])
    assert abs(p.mean() - y.mean()) < 0.06 and ((p - y) ** 2).mean() < 0.5 * y.mean() * (1 - y.mean())
    text = rows[0]["text"].encode()
    sizes = []
    for d in model.dictionaries:
        zd = zstandard.ZstdCompressionDict(d)
        c = zstandard.ZstdCompressor(dict_data=zd, level=C.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append([len(c.compress(text[i : i + C.CHUNK])) for i in range(0, len(text), C.CHUNK)])
    bad, good = map(np.array, sizes)
    mean, least, own = (bad.sum() - good.sum()) / (bad.sum() + good.sum()), ((bad - good) / (bad + good)).min(), good.sum() / len(text)
    assert np.allclose(C.Compressors(model.dictionaries).features(rows[0]["text"]), (mean, least, min(1, own)))
    rate = np.mean([q for i, q in truth.items() if training.fold(i)])
    z = np.array([mean, least, min(1, own)]) @ model.weights[:-1] + model.weights[-1] + np.log(rate / (1 - rate))
    assert abs(rows[0]["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_repeated_ids_and_bytes(spark, tables, monkeypatch):
    """A labelled id that repeats is one document, its smallest text; texts end where the bytes do."""
    docs, labels = tables
    twice = docs.union(docs.selectExpr("doc_id", "'0' AS text", "lang", "source", "n_chars"))
    assert {t for t, _ in training.labelled(twice, labels, "toxic")} == {"0"}
    assert len(training.labelled(twice, labels, "toxic")) == len(training.labelled(docs, labels, "toxic"))
    monkeypatch.setattr(training, "MAX_BYTES", 5000)
    some = training.labelled(docs, labels, "toxic")
    assert 0 < len(some) < 40 and sum(len(t.encode()) for t, _ in some) <= 5000


def test_clashing_columns(tables):
    docs, labels = tables
    clash = docs.selectExpr("*", "'x' AS score", "'y' AS label", "'z' AS upto", "'w' AS y")
    for m in (T, C):
        out = m.score(clash, m.learn(clash, labels))
        assert dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["label"] == "string" and len(out.columns) == len(clash.columns)


def test_same_model_every_time(tables):
    docs, labels = tables
    a, b = (T.learn(d, labels) for d in (docs, docs.repartition(5)))
    assert (a.weights == b.weights).all() and (a.marginal == b.marginal).all()
    a, b = (C.learn(d, labels) for d in (docs, docs.repartition(5)))
    assert a.dictionaries == b.dictionaries and (a.weights == b.weights).all()


def test_whole_texts_are_read(tables):
    """An insult or shouting far behind still counts."""
    docs, labels = tables
    clean = prose(1, 3000)
    toxic, quality = T.learn(docs, labels), C.learn(docs, labels)
    tail = " ".join(INSULTS * 40)
    cache = {}
    assert toxic.score(toxic.difference(T._slots(clean, cache))) < 0.5 < toxic.score(toxic.difference(T._slots(clean + " " + tail, cache)))
    import numpy as np

    c = C.Compressors(quality.dictionaries)
    a, b = (quality.score(np.array([c.features(t)]))[0] for t in (clean, clean + " " + prose(1, 3000).upper().replace(" ", "!! ")))
    assert b < C.DECISION < a


def test_without_labels(spark, tables):
    docs, labels = tables
    assert T.learn(docs, labels.where("toxic = 0")) is None and C.learn(docs, labels.where("doc_id < 0")) is None
    assert {r["score"] for r in T.score(docs, None).collect()} == {0.0}
    assert {r["score"] for r in C.score(docs, None).collect()} == {C.DECISION}
    twice = spark.createDataFrame([(1000, 1, 0), (1000, 0, 1), (1001, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert training.labelled(docs, twice, "toxic") == []
    assert T.score(documents(spark, []), T.learn(docs, labels)).collect() == []
    assert C.score(documents(spark, []), C.learn(docs, labels)).collect() == []


@pytest.mark.parametrize("rows", [0, 500_000])
def test_toxicity_counts_all_labelled_texts_once(spark, monkeypatch, rows):
    """Beyond the sample's bound too, but no text twice and none of the held-out fold, by either join."""
    monkeypatch.setattr(T, "BROADCAST_ROWS", rows)
    docs, labels = labelled(300)
    d, y = documents(spark, docs + docs[:50]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, kept = T.learn(d, y, max_per_class=30), {(t, x[2]) for (i, t, *_), x in zip(docs, labels, strict=True) if training.fold(i)}
    assert model.pairs.sum() == model.firsts.sum() == sum(len(T._WORD.findall(t.lower())) for t, _ in kept)


def test_toxicity_halves(spark):
    """A model of one half knows nothing of the other."""
    rows = [("a b c", 0), ("a d", 1), ("a b e", 2), ("f g h", 3), ("f g", 3)]
    table = T.bigrams(spark.createDataFrame(rows, "text string, part int"))
    both, first, second = T.fit(table, ((0, 1), (0,), (1,)))
    f, g = T._slots("f g", {})
    assert first.firsts[:, f].tolist() == [0, 0] and second.firsts[:, f].tolist() == [0, 2] == both.firsts[:, f].tolist()
    assert (first.pairs + second.pairs == both.pairs).all() and second.marginal[1, g] > second.marginal[0, g]
    assert T.fit(table.where("false"))[0] is None


def test_kneser_ney_by_hand(spark):
    """Continuation counts: a word counts by how many words it follows, not by how often it stands there."""
    import numpy as np

    m = fitted(spark, ("x y x y x y z y", "a y a b", "x q", "q q"), (1, 1, 0, 0))
    y = T._slots("y", {})[0]
    kinds = 3  # x y, z y, a y in class 1; none in class 0
    n1, n0 = 8, 3  # distinct bigrams of the classes: (0 x) (x y) (y x) (y z) (z y) (0 a) (a y) (y a) (a b); (0 x) (x q) (0 q) (q q)
    n1, n0 = 9, 4
    shared = (kinds + 0.5) / (n1 + n0 + 0.5 * T.WORD_SLOTS)
    assert np.isclose(m.shared[y], shared, rtol=1e-5)
    assert np.isclose(m.marginal[1, y], (kinds + T.STRENGTH) / (n1 * shared + T.STRENGTH), rtol=1e-5)
    assert np.isclose(m.marginal[0, y], T.STRENGTH / (n0 * shared + T.STRENGTH), rtol=1e-5)
