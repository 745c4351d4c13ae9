import re

import duckdb
from corpus import awkward, documents

from planloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(words) < 2000 else None
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), covered and len(covered) or 0


def test_metrics(spark):
    rows = awkward() + [(20, "a b c a b c\n\nx\nx\n#*$\na b c", "en", "s", 1), (21, "a a a a", "en", "s", 1)]
    got = Q.metrics(documents(spark, rows)).collect()
    for r in got:
        if len(r["text"] or "") < 20_000:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"]), r["doc_id"]
    assert len(got) == len(rows)


def test_same_verdict_in_any_order(spark):
    docs = documents(spark, awkward() + [(30, "word! " * 70, "en", "s", 1), (31, "*** " * 70, "en", "s", 1)])
    a = sorted(map(tuple, Q.judge(docs, Q.RULES).select("doc_id", "kept").collect()), key=repr)
    b = sorted(map(tuple, Q.judge(docs, tuple(reversed(Q.RULES))).select("doc_id", "kept").collect()), key=repr)
    assert a == b and (31, False) in a and (1, True) in a and (4, False) in a


def test_cascade_order(spark):
    """Of equal cost the rule that rejects more comes first; a rule that rejects nothing comes last."""
    from pyspark.sql import functions as F

    rules = (Q.Rule("never", lambda m: F.length(m.text) < 0), Q.Rule("often", lambda m: F.length(m.text) > 100))
    assert [r.name for r, _, _ in Q.plan_cascade(documents(spark), rules, spread=1)] == ["often", "never"]


def test_cost_and_selectivity_change_places(spark):
    """A dear rule that rejects all stands behind a cheap one that rejects some, until the row has its metric."""
    rules = (Q.Rule("dear", lambda m: m.n_repeat_words >= 0), Q.Rule("cheap", lambda m: m.n_words > 100))
    order = lambda *columns: [r.name for r, _, _ in Q.plan_cascade(documents(spark), rules, columns=columns, spread=1)]
    assert order("n_words") == ["cheap", "dear"]
    assert order("n_words", "n_repeat_words") == ["dear", "cheap"]
    (_, cheap, some), (_, dear, all_of) = Q.plan_cascade(documents(spark), rules, columns=("n_words",), spread=1)
    assert dear > 1000 * cheap and all_of == 1.0 and 0 < some < 1


def test_empty_table_and_clashing_columns(spark):
    assert Q.judge(documents(spark, [])).collect() == []
    clash = documents(spark).selectExpr("*", "'x' AS n_words", "1 AS kept")
    assert dict(Q.judge(clash).dtypes)["n_words"] == "bigint"
    assert Q.filter_quality(documents(spark)).columns == documents(spark).columns


def test_native(spark):
    plan = Q.judge(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_matches_sql(spark, tmp_path):
    docs = documents(spark, [r for r in awkward() if r[0] != 9])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.query(spark, str(tmp_path))
    expected = con.execute(Q.SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
