"""The pipeline on documents with planted cases, each stage against a plain version of it."""

import pytest
from corpus import awkward, documents, prose
from test_classifiers import INSULTS, labelled

import corpus_pipeline
from planloom.llm import common, sentencepiece_codec


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    docs, labels = labelled()
    docs = [d for d in docs if (d[0] - 1000) % 4]  # no shouting here
    shared = prose(77, 90)
    own = [(i, prose(9000 + i, 150, 3000) + (" " + shared if i < 10 else ""), "en", f"s{i % 3}", 1) for i in range(60)]
    copies = [(100 + i, own[20][1], "en", "s1", 1) for i in range(15)]
    near = [(200, own[30][1].replace(own[30][1].split()[70], "changed"), "en", "s2", 1)]
    odd = [(i and i + 700, *rest) for i, *rest in awkward() if i is None or i >= 4]
    documents(spark, docs + own + copies + near + odd).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    out, now = {"documents": spark.read.parquet(str(folder / "documents.parquet"))}, None
    for name, f in corpus_pipeline.STAGES:
        now, _ = common.materialise(f(spark, list(out.values())[-1], str(folder)))
        out[name] = now
    return out, str(folder)


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    out, _ = stages
    assert list(out) == ["documents", "toxicity", "simhash", "passages", "mixing", "sentencepiece"]
    assert all(df.columns == out["documents"].columns for name, df in out.items() if name != "sentencepiece")


def test_toxic_documents_go(stages):
    out, _ = stages
    before, after = out["documents"].collect(), ids(out["toxicity"])
    toxic = {r["doc_id"] for r in before if r["text"] and any(w in r["text"] for w in INSULTS)}
    assert len(toxic & after) <= 0.05 * len(toxic) and len(after & {r["doc_id"] for r in before} - toxic) >= 0.97 * len({r["doc_id"] for r in before} - toxic)


def test_one_of_each_group_stays(stages):
    out, _ = stages
    after = ids(out["simhash"])
    assert 20 in after and not after & set(range(100, 115)) and 30 in after and 200 not in after
    assert set(range(60)) <= after


def test_shared_passages_stay_once(stages):
    out, _ = stages
    shared = prose(77, 90)
    assert [r["doc_id"] for r in out["passages"].collect() if r["text"] and shared in r["text"]] == [0]
    assert set(range(60)) <= ids(out["passages"])
    assert all(r["n_chars"] == len(r["text"]) for r in out["passages"].where("text is not null").collect())


def test_mix_and_tokens(stages):
    out, _ = stages
    copies = {}
    for r in out["mixing"].collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    repeated = {r["doc_id"] for r in out["passages"].groupBy("doc_id").count().where("count > 1").collect()}
    assert max(n for i, n in copies.items() if i not in repeated) <= 3
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.read())
    texts = {r["doc_id"]: r["text"] for r in out["mixing"].collect()}
    rows = out["sentencepiece"].collect()
    assert len(rows) == out["mixing"].count() and all(r["round_trip"] for r in rows)
    assert all(codec.decode(__import__("numpy").array(r["ids"])) == texts[r["doc_id"]] for r in rows if r["doc_id"] not in repeated)


def test_each_stage_against_a_plain_version(spark, stages):
    """The whole pipeline's rows from plain versions of its decisions, stage by stage."""
    from test_simhash import jaccard

    out, folder = stages
    model = corpus_pipeline.toxicity.learn(out["documents"], common.table(spark, folder, "labels"))
    scores = lambda t: model.score(model.difference(corpus_pipeline.toxicity._slots(t or "", {})))
    key = lambda r: (r["doc_id"] or 0, r["text"] or "")
    kept = [r for r in out["documents"].collect() if scores(r["text"]) < 0.5]
    assert sorted(map(key, kept)) == sorted(map(key, out["toxicity"].collect()))
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in kept if r["doc_id"] is not None}
    words = {i: set(t.split()) for i, t in texts.items()}
    near = {i: {i} for i in texts}
    for a in texts:
        for b in texts:
            if a < b and len(words[a] & words[b]) >= 0.5 * len(words[a] | words[b]) and jaccard(texts[a], texts[b]) >= 0.8:
                near[a].add(b)
                near[b].add(a)
    stay, seen = set(), set()
    for i in sorted(texts):
        if i not in seen:
            stay.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    assert {i for i in ids(out["simhash"]) if i is not None} == stay
    copies = {}
    for r in corpus_pipeline.mixing.mix(out["passages"]).collect():
        n = int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
        copies[key(r)] = copies.get(key(r), 0) + n
    mixed = {}
    for r in out["mixing"].collect():
        mixed[key(r)] = mixed.get(key(r), 0) + 1
    assert mixed == {k: n for k, n in copies.items() if n}


def test_run_is_the_last_stage(spark, stages):
    out, folder = stages
    one = lambda df: sorted((r["doc_id"] or 0, r["n_tokens"]) for r in df.collect())
    assert one(corpus_pipeline.run(spark, folder)) == one(out["sentencepiece"])


def test_own_columns_stay(spark, stages):
    """Columns that are named like the stages' own come out as they went in."""
    _, folder = stages
    names = ["size", "target", "taken", "source_size", "id", "fp", "node", "a", "b", "score", "__x", "component_id"]
    own = documents(spark, [(i, prose(9000 + i, 150, 3000), "en", f"s{i % 3}", 1) for i in range(12)])
    own = own.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, own, folder)
        assert out.columns == own.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_stage_tables_are_deleted(spark, stages):
    import glob

    _, folder = stages
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = len(glob.glob(f"{root}/planloom/*"))
    corpus_pipeline.run(spark, folder).count()
    assert len(glob.glob(f"{root}/planloom/*")) == before + 1


def test_every_stage_takes_empty_tables(spark, stages):
    _, folder = stages
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, documents(spark, []), folder).collect() == []
