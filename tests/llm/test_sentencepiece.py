import random

import numpy as np
import pytest
import sentencepiece
from corpus import awkward, documents
from sentencepiece import sentencepiece_model_pb2

from planloom.llm import sentencepiece_codec as S

r = random.Random(8)
TEXTS = [t for _, t, *_ in awkward()] + ["  two  spaces ", "\ttabs\r\n", "12 345", "<0x0A> <s>", "ab" * 400, "z" * 700 + " end"]
TEXTS += ["".join(r.choice("abcdethin é漢😀\n0.,AT") for _ in range(r.randint(1, 300))) for _ in range(200)]


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.Vocabulary.read())


def test_same_ids_and_texts_as_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    texts = [t or "" for t in TEXTS]
    got = codec.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [codec.decode(x) for x in got] == [library.decode(x.tolist()) for x in got] == texts


def unigram():
    """A hand-made unigram model: pieces and scores are given, nothing is trained."""
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, True
    for piece, kind, score in [("<unk>", 2, 0), ("<s>", 3, 0), ("</s>", 3, 0), ("▁", 1, -2.5)]:
        m.pieces.add(piece=piece, type=kind, score=score)
    own = random.Random(9)
    for p in sorted({"".join(own.choice("abcd") for _ in range(own.randint(1, 4))) for _ in range(120)}):
        m.pieces.add(piece=p, type=1, score=-own.randrange(8, 80) / 4)  # sums are exact in float32
        m.pieces.add(piece="▁" + p, type=1, score=-own.randrange(8, 80) / 4)
    return m


def test_viterbi_against_the_library():
    m = unigram()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), S.Codec(S.Vocabulary.parse(m))
    scores = [p.score for p in m.pieces]
    own = random.Random(10)
    texts = ["".join(own.choice("abcd abcd xyé") for _ in range(own.randint(0, 60))) for _ in range(400)]
    for t, got, expected in zip(texts, codec.encode(texts), library.encode(texts), strict=True):
        total = lambda ids: sum(scores[i] if i else min(scores) - 10 for i in ids)
        assert got.tolist() == expected or total(got.tolist()) == total(expected), t


def test_brute_force_viterbi():
    """The best of all segmentations of short words."""
    m = unigram()
    codec, score = S.Codec(S.Vocabulary.parse(m)), {p.piece: p.score for p in m.pieces if p.type == 1}
    least = min(score.values()) - 10

    def best(w):
        if not w:
            return 0.0
        return max((score[w[:k]] if w[:k] in score else least if k == 1 else -1e9) + best(w[k:]) for k in range(1, len(w) + 1))

    own = random.Random(11)
    for _ in range(100):
        w = "".join(own.choice("abcde") for _ in range(own.randint(1, 8)))
        ids = codec._learn([f"▁{w}"]) or np.frombuffer(codec.cache[f"▁{w}"], np.int32)
        got = sum(float(m.pieces[i].score) if i else least for i in ids)
        assert abs(got - best(f"▁{w}")) < 1e-3


def test_long_units_take_the_scalar_merge(codec):
    unit = S.SPACE + "thereandthen" * 40
    assert len(unit) > S.LONG
    codec.cache.pop(unit, None)
    codec._learn([unit])
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert np.frombuffer(codec.cache[unit], np.int32).tolist() == library.encode(unit[1:])


def test_tables(spark):
    docs = documents(spark).withColumnRenamed("n_chars", "ids")
    out = S.encoded(docs)
    rows = out.collect()
    assert len(rows) == len(awkward()) and all(r["round_trip"] for r in rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    back = S.decoded(out.select("doc_id", "ids", "text").withColumnRenamed("text", "was"))
    assert all(r["text"] == (r["was"] or "") for r in back.collect())
    assert S.encoded(documents(spark, [])).collect() == []


def test_refuses_models_with_a_character_map():
    m = unigram()
    m.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError):
        S.Vocabulary.parse(m)


def test_long_units_of_a_unigram_model():
    """A unit longer than LONG takes the scalar Viterbi: the same path as the batched one."""
    import numpy as np
    from sentencepiece import sentencepiece_model_pb2

    from planloom.llm import sentencepiece_codec as SP

    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type = 1
    for p, score, kind in [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("ba", -3.1, 1), ("aab", -4.0, 1), ("abba", -4.2, 1)]:
        m.pieces.add(piece=p, score=score, type=kind)
    codec = SP.Codec(SP.Vocabulary.parse(m))
    r = np.random.default_rng(3)
    for n in (1, 7, SP.LONG, 500):
        unit = "".join(r.choice(list("abc"), n, p=[0.5, 0.45, 0.05]))
        chars = np.frombuffer(unit.encode("utf-32-le"), np.uint32).reshape(1, n)
        found = codec._probe(chars)
        scores = np.where(found >= 0, codec.v.scores[found], np.float32(-np.inf))
        follow, plain = codec._viterbi(scores)[0].tolist(), codec._viterbi_long(unit)
        a, b, places = 0, 0, []
        while a < n:
            places.append(a)
            a = follow[a]
        while b < n:
            assert b in places
            b = plain[b]
        assert codec._ids(unit, follow) == codec._ids(unit, plain)
