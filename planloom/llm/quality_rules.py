"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a rejecting condition over the text's metrics. On a bounded sample each rule's selectivity (share of rows
rejected) is measured and its cost estimated in the form in which it runs: a step for each metric that the row has
already, and for each that it must compute itself as many steps a character as PASSES says, times the sample's mean
length. The cascade asks the rules with the most rejections per step first and stops at the first that rejects. Counted
steps, unlike the seconds of a short job, agree between runs and tell a comparison of two columns from a pass over the
text. The order changes the cost only: a row is kept exactly if no rule rejects it.

The sample is SAMPLE_ROWS rows of those whose text's hash leaves 0 modulo SPREAD, the first that are read.

Defined cases: a null text has no words and counts as empty; a text without words fails the base rules; ties and
repeated rows are judged one by one; texts of any length are measured whole; an empty table gives an empty result; columns of the input that share a metric's
name are replaced by the metric.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm import common

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 256
SPREAD = 16
#: Passes over the text that a metric takes, in steps a character.
PASSES = {"n_words": 4, "word_chars": 2, "n_symbols": 2, "n_dup_lines": 4, "n_repeat_words": 12, "n_bangs": 2, "n_lines": 2}


class Measures:
    """What rules ask of a text: an attribute is a metric's column if the table has it, else computed from the text."""

    def __init__(self, text: Column, columns: tuple[str, ...] = ()):
        self.text, self.columns, self.asked = F.coalesce(text, F.lit("")), columns, []

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        self.asked.append(name)
        return F.col(name) if name in self.columns else METRICS[name](self.text)


@dataclass(frozen=True)
class Rule:
    """reject: builds the rejecting condition from Measures."""

    name: str
    reject: Callable[[Measures], Column]


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are one of chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), common.SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return _count_of(F.coalesce(text, F.lit("")), SYMBOLS)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, common.SPACES, "")) > 0)
    return common.bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(windows: Column) -> Column:
    """Words covered by three-word windows that occur twice or more; windows: their hashes in order.

    Equal windows stand together after a sort, so the work is n log n whatever repeats.
    """

    def repeated(s: Column) -> Column:
        same = lambda e, k: F.get(s, k)["w"].eqNullSafe(e["w"])
        return F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])

    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + 3).alias("end"))
    return F.aggregate(F.sort_array(common.bind(ordered, repeated)), start, step, lambda a: a["n"])


def repeat_words(words: Column) -> Column:
    def windows(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))
    return common.bind(common.bind(hashes, windows), count).cast("long")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text."""
    t = F.col(text)
    of_words = common.bind(common.words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    out = df.withColumn("__words", of_words)
    return out.withColumns(
        {"n_words": F.col("__words.n"), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": F.col("__words.r")}
    ).drop("__words")


def base_failed() -> Column:
    """The base rules over the columns of metrics()."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


METRICS: dict[str, Callable[[Column], Column]] = {
    "n_words": common.word_count,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": lambda t: repeat_words(common.words(t)),
    "n_bangs": lambda t: _count_of(t, "!"),
    "n_lines": lambda t: _count_of(t, "\n") + 1,
}
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The method's own rules. They reject markup, tables, shouting and boilerplate, at rates that prose does not reach.
RULES = (
    Rule("symbols", lambda m: 5 * m.n_symbols > m.n_words),
    Rule("exclamations", lambda m: 5 * m.n_bangs > m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 3 * m.n_lines),
    Rule("long_words", lambda m: m.word_chars > 15 * m.n_words),
    Rule("short_words", lambda m: m.word_chars < 2 * m.n_words),
)


def plan_cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", columns: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS, spread: int = SPREAD) -> list[tuple[Rule, float, float]]:
    """(rule, steps, share rejected) in the order of rejections per step.

    columns: the metrics that the rows have already where the cascade runs.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    sample = df.select(t.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(spread)) == 0).limit(sample_rows)
    hits = [F.avg(rule.reject(Measures(F.col("t"))).cast("int")).alias(f"r{i}") for i, rule in enumerate(rules)]
    row, measured = sample.agg(F.avg(F.length("t")).alias("length"), *hits).first(), []
    for i, rule in enumerate(rules):
        asked = Measures(F.col(text), columns)
        rule.reject(asked)
        steps = 1 + sum(1 if m in columns else PASSES.get(m, 8) * (row["length"] or 0.0) for m in asked.asked)
        measured.append((rule, steps, row[f"r{i}"] or 0.0))
    return sorted(measured, key=lambda m: (-m[2] / m[1], m[1]))


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", columns: tuple[str, ...] = ()) -> Column:
    """True where no rule rejects; CASE asks the rules in the measured order and stops at the first that does.

    columns: the metrics that the table the result is used on has already.
    """
    verdict, measures = None, Measures(F.col(text), columns)
    for rule, _, _ in plan_cascade(df, rules, text, columns):
        hit = F.coalesce(rule.reject(measures), F.lit(False))
        verdict = F.when(hit, False) if verdict is None else verdict.when(hit, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with the metrics, base_failed and kept (false if base_failed, else the cascade's verdict)."""
    verdict = cascade(df, rules, text, COLUMNS)
    out = metrics(df, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict))


def filter_quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that every rule of the cascade keeps, with the columns of df."""
    return df.where(cascade(df, rules, text))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
grams AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2),
cover AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS bangs, len(string_split(text, chr(10))) AS n_lines
  FROM d LEFT JOIN cover USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words OR 5 * bangs > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""
