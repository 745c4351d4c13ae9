"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Every source's target is its share of all words by weight, at most max_epochs times its own words; what a source
   cannot take is reshared by weight. That is one water level L with target = min(max_epochs * size, L * weight), found
   in closed form from running sums over the sources sorted by the level at which each fills up.
2. The total is cut into equal blocks of words. Sources get whole blocks by the highest quotients target / (2 s + 1).
   Rounding target / block gives nearly all of them; only the few seats that remain are ranked, so the cost does not
   depend on the number of blocks.
3. Each source's rows are dealt to shards by a seeded hash, and its blocks go to its shards by their words, again by
   highest quotients: an integer quota of blocks for each shard.
4. In a shard the rows stand in seeded order on one line of words. A quota is some whole passes over the line and the
   blocks from its start: a row takes its words once for each pass, and those that the last blocks cover.

No row is taken more than max_epochs times, and reruns agree, as every order is a hash of the seed and the row's id. A
shard has shard_rows rows, of sources of over shard_rows ** 2 rows the square root of their number, and so has the list of
a source's shards: at 10 ** 10 rows of one source 100,000 of each, with no bound on either.

Defined cases: null text has size 0; a null source is a source of its own, last in order; sources without words get
target 0; rows that repeat an id are separate rows, in order of their sizes; texts of any length are counted whole; an empty
table gives an empty result. Input columns that share a name with a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.llm import common

SEED = 20
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
SHARD_ROWS = 2048
#: The columns that mix() adds.
ADDED = ("size", "source_size", "target", "taken")


def _targets(sources: DataFrame, weights: Column, max_epochs: int, block_words: int) -> DataFrame:
    """One row per source: its place k, weight, target and the block size that suits the smallest target."""
    everything = W.partitionBy()
    s = sources.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", weights).withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("fills", (max_epochs * F.col("source_size")).cast("double") / F.col("weight"))
    filling = W.orderBy("fills", "k")
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    capped = F.coalesce(F.sum(max_epochs * F.col("source_size")).over(before), F.lit(0))
    level = (F.col("total") - capped).cast("double") / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "k", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least((max_epochs * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(least, F.lit(0.0)) / 64))).cast("long")
    return s.select("source", "k", "source_size", "n_rows", "weight", "target", "total", block.alias("block"))


def sainte_lague(df: DataFrame, group: list[str], key: str, claim: Column, seats: Column) -> DataFrame:
    """df with quota: in each group the seats are dealt to its keys by the highest quotients claim / (2 s + 1).

    The starting point, claims rounded at the divisor sum / seats, misses the total by at most half the number of keys;
    a key's share of the missing seats is bounded by its share of the claims, so few quotients are ranked.
    """
    part = W.partitionBy(*group)
    d = df.withColumn("__claim", claim.cast("double")).withColumn("__seats", seats.cast("long"))
    d = d.withColumn("__sum", F.sum("__claim").over(part)).withColumn("__n", F.count(F.lit(1)).over(part))
    d = d.withColumn("__share", F.when(F.col("__sum") > 0, F.col("__claim") / F.col("__sum")).otherwise(0.0))
    d = d.withColumn("__start", F.floor(F.col("__share") * F.col("__seats") + 0.5))
    d = d.withColumn("__miss", F.col("__seats") - F.sum("__start").over(part))
    most = F.ceil(F.col("__share") * (F.abs("__miss") + F.col("__n"))) + 1
    steps = F.when((F.col("__miss") > 0) & (F.col("__claim") > 0), F.sequence(F.lit(0), most)).when(
        (F.col("__miss") < 0) & (F.col("__start") > 0), F.sequence(F.lit(1), F.least(most, F.col("__start")))
    )
    own = [*group, key]
    ranked = d.select(*own, "__claim", "__start", "__miss", F.explode(steps).alias("__j"))
    up = F.col("__miss") > 0
    quotient = F.when(up, F.col("__claim") / (2 * (F.col("__start") + F.col("__j")) + 1)).otherwise(-F.col("__claim") / (2 * (F.col("__start") - F.col("__j")) + 1))
    ranked = ranked.withColumn("__rank", F.row_number().over(part.orderBy(quotient.desc(), F.col(key))))
    moved = ranked.where(F.col("__rank") <= F.abs("__miss")).groupBy(*own).agg(F.sum(F.when(up, 1).otherwise(-1)).alias("__moved"))
    out = d.join(moved, own, "left").withColumn("quota", (F.col("__start") + F.coalesce("__moved", F.lit(0))).cast("long"))
    return out.select(*df.columns, "quota")


def _hash(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: list[str] | None = None,
    weights: Column | None = None,
    max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """The columns keep (all of df by default) with size, source_size, target and taken.

    weights: a source's weight from its place k (from 1) among the sources; 1, 2, 3, repeating by default.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ADDED]
    weights = (F.col("k") - 1) % 3 + 1 if weights is None else weights
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = df.select(*carried, F.col(source).alias("source"), _hash(F.col(doc_id), seed).alias("order"), common.word_count(F.col(text)).alias("size"))

    thin, _ = common.materialise(df.select(F.col(source).alias("source"), _hash(F.col(doc_id), seed).alias("order"), common.word_count(F.col(text)).alias("size")))
    totals = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = _targets(totals, weights, max_epochs, block_words)
    blocks = F.floor(F.col("total").cast("double") / F.col("block"))
    quotas = sainte_lague(targets.withColumn("all", F.lit(1)), ["all"], "k", F.col("target"), blocks)
    shards = F.ceil(F.col("n_rows") / F.greatest(F.lit(shard_rows), F.floor(F.sqrt("n_rows")))).cast("long")
    sources, _ = common.materialise(quotas.select("source", "k", "source_size", "target", "block", "quota", shards.alias("n_shards")).coalesce(1))

    def placed(x: DataFrame) -> DataFrame:
        """x with its source's columns and its shard."""
        s = sources.select(F.col("source").alias("s"), *[c for c in sources.columns if c != "source"])
        x = x.join(s, x["source"].eqNullSafe(s["s"]))
        return x.withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("n_shards"))

    lines = placed(thin).groupBy("k", "shard").agg(F.sum("size").alias("line"), F.first("quota").alias("seats"), F.first("block").alias("block"))
    of_shards, _ = common.materialise(sainte_lague(lines, ["k"], "shard", F.col("line"), F.col("seats")).select("k", "shard", "line", (F.col("quota") * F.col("block")).alias("due")).coalesce(1))

    out = placed(rows).join(of_shards, ["k", "shard"])
    line = W.partitionBy("k", "shard").orderBy("order", "size").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("end", F.sum("size").over(line))
    due = F.least(F.col("due"), max_epochs * F.col("line"))
    passes = F.when(F.col("line") > 0, F.floor(due / F.col("line"))).otherwise(0)
    rest = due - F.col("passes") * F.col("line")
    out = out.withColumn("passes", passes).withColumn("rest", rest)
    part = F.greatest(F.lit(0), F.least(F.col("rest"), F.col("end")) - (F.col("end") - F.col("size")))
    taken = (F.col("passes") * F.col("size") + part).cast("long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", taken.alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, keep=["doc_id"])


def _lague(df: str, name: str, group: str, key: str) -> str:
    """SQL of the highest quotients; df has the group, the key, claim and seats."""
    return f"""
{name}_a AS (SELECT *, sum(claim) OVER (PARTITION BY {group}) AS s, count(*) OVER (PARTITION BY {group}) AS n FROM {df}),
{name}_b AS (SELECT *, CASE WHEN s > 0 THEN claim / s ELSE 0 END AS share FROM {name}_a),
{name}_c AS (SELECT *, CAST(floor(share * seats + 0.5) AS BIGINT) AS st FROM {name}_b),
{name}_d AS (SELECT *, seats - sum(st) OVER (PARTITION BY {group}) AS miss FROM {name}_c),
{name}_e AS (
  SELECT {group}, {key}, claim, st, miss, unnest(CASE WHEN miss > 0 AND claim > 0 THEN range(0, CAST(abs(miss) AS BIGINT) + 1)
    WHEN miss < 0 THEN range(1, least(CAST(abs(miss) AS BIGINT), st) + 1) ELSE [] END) AS j FROM {name}_d),
{name}_f AS (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN miss > 0 THEN claim / (2 * (st + j) + 1)
    ELSE -claim / (2 * (st - j) + 1) END DESC, {key}) AS r FROM {name}_e),
{name}_g AS (SELECT {group}, {key}, sum(sign(miss)) AS moved FROM {name}_f WHERE r <= abs(miss) GROUP BY ALL),
{name} AS (
  SELECT d.*, CAST(st + coalesce(moved, 0) AS BIGINT) AS quota
  FROM {name}_d d LEFT JOIN {name}_g g ON d.{group} = g.{group} AND d.{key} = g.{key})"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, (k - 1) % 3 + 1 AS w FROM s1),
s3 AS (SELECT *, CAST({MAX_EPOCHS} * source_size AS DOUBLE) / w AS fills FROM s2),
s4 AS (
  SELECT *, CAST(total - coalesce(sum({MAX_EPOCHS} * source_size) OVER (ORDER BY fills, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY fills, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
s5 AS (SELECT level AS top FROM s4 WHERE level <= fills ORDER BY fills, k LIMIT 1),
s6 AS (SELECT *, least(CAST({MAX_EPOCHS} * source_size AS DOUBLE), top * w) AS target FROM s4, s5),
s7 AS (
  SELECT *, CAST(greatest(1, least({BLOCK_WORDS}, floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 0) / 64))) AS BIGINT) AS block FROM s6),
s8 AS (SELECT *, 1 AS g, target AS claim, CAST(floor(CAST(total AS DOUBLE) / block) AS BIGINT) AS seats FROM s7),
{_lague("s8", "q", "g", "k")},
p AS (
  SELECT d.doc_id, d.size, d.o, q.k, q.source_size, q.target, q.block, q.quota AS seats,
         CAST('0x' || substr(o, 1, 8) AS BIGINT) % CAST(ceil(q.n_rows / greatest({SHARD_ROWS}, floor(sqrt(q.n_rows)))) AS BIGINT) AS shard
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
l AS (SELECT k, shard, CAST(sum(size) AS BIGINT) AS line, CAST(sum(size) AS DOUBLE) AS claim, any_value(seats) AS seats, any_value(block) AS block FROM p GROUP BY k, shard),
{_lague("l", "z", "k", "shard")},
e AS (
  SELECT p.*, z.line, least(z.quota * z.block, {MAX_EPOCHS} * z.line) AS due,
         sum(p.size) OVER (PARTITION BY p.k, p.shard ORDER BY p.o, p.size ROWS UNBOUNDED PRECEDING) AS stop
  FROM p JOIN z ON p.k = z.k AND p.shard = z.shard),
f AS (SELECT *, CASE WHEN line > 0 THEN CAST(floor(due / line) AS BIGINT) ELSE 0 END AS passes FROM e)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(due - passes * line, stop) - (stop - size)) AS BIGINT) AS taken
FROM f
"""
