"""Approximate nearest neighbours by shifted space-filling curves.

Every curve projects the vectors onto a few random orthonormal directions, spreads each direction evenly over [0, 1) by
the mean and deviation of a bounded sample, shifts it at random and takes the place on a Hilbert curve. Spark range
partitions the places, which ranks all vectors on every curve; a query looks at the blocks of ranks around its own on
each curve. The candidates of all curves merge, ranked by exact distances in double precision.

Blocks are cut by rank, so however many vectors share a place, every block has as many candidates; queries stream past
the block's candidates, which are held in memory. Equal vectors are one item that keeps its k + 1 smallest ids, which is
all that any result can hold of them; that makes ties exact and copies cheap.

`window` is the number of ranks looked at on either side: a share of all vectors by default. Vectors without structure
(independent directions) have no near and far along any curve, and a recall of 0.9 needs such a share, so the cost of
the rerank grows with queries times vectors; for clustered vectors a fixed `window` is enough. Which of the two holds is
a property of the data: measure the recall against brute force (`exact`).

Defined cases: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite
components take no part, as queries or candidates, nor do rows with a null id; a query's own id is never its result; rows
that repeat an id are one result, at their smallest distance; ties go to the smaller id; a query with fewer candidates
than k gets them all; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.llm import common, hilbert

K = 10
CURVES = 12
DIRECTIONS = 4
BITS = 8
WINDOW = 0.05
SAMPLE = 20_000
BLOCK = (256, 8192)
SEED = 6


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Curves:
    """The projections, spreads and shifts of all curves."""

    def __init__(self, sample: np.ndarray, curves: int, directions: int, seed: int):
        rng, dims = np.random.default_rng(seed), sample.shape[1]
        self.all = []
        for _ in range(curves):
            p = np.linalg.qr(rng.normal(size=(dims, min(directions, dims))))[0]
            z = sample @ p
            self.all.append((p, z.mean(0), np.maximum(z.std(0), 1e-12), rng.uniform(size=p.shape[1])))

    def places(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for p, mean, spread, shift in self.all:
            even = 1 / (1 + np.exp(np.clip(-1.702 * (x @ p - mean) / spread, -50, 50)))
            yield hilbert.keys(np.minimum(((even + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _ranked(items: DataFrame, curves: Curves) -> DataFrame:
    """(curve, id, query, rank): the number of candidates before an item on a curve. Written to the shared folder."""
    spark = items.sparkSession
    sent = spark.sparkContext.broadcast(curves)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"]).astype(np.float64)
            for i, place in enumerate(sent.value.places(x)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(place), batch["id"], batch["query"]], ["curve", "place", "id", "query"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a sorted partition: the candidates of the row's curve before it."""
        before: dict[int, int] = {}
        for batch in batches:
            curve, own = batch["curve"].to_numpy(), ~batch["query"].to_numpy(zero_copy_only=False)
            at = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                of = curve == c
                n = np.cumsum(own[of])
                at[of] = before.get(int(c), 0) + n - own[of]
                before[int(c)] = before.get(int(c), 0) + int(n[-1])
            yield pa.RecordBatch.from_arrays([batch["curve"], batch["id"], batch["query"], pa.array(at)], ["curve", "id", "query", "at"])

    line = items.select("id", "query", "v").mapInArrow(places, "curve int, place long, id long, query boolean")
    line = line.repartitionByRange("curve", "place", "id", "query").sortWithinPartitions("curve", "place", "id", "query")
    line = line.mapInArrow(counted, "curve int, id long, query boolean, at long").withColumn("part", F.spark_partition_id())
    line, _ = common.materialise(line)
    # One row for each curve and partition, whatever the input.
    sizes = line.where(~F.col("query")).groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    starts, _ = common.materialise(starts.select("curve", "part", F.coalesce("start", F.lit(0)).alias("start"), "n").coalesce(1))
    # A partition that holds only queries of a curve starts where the partitions before it end.
    ends = starts.groupBy("curve").agg(F.sort_array(F.collect_list(F.struct("part", "start", "n"))).alias("parts"))
    before = F.aggregate(F.filter("parts", lambda x: x["part"] < F.col("part")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    known = line.join(starts.drop("n"), ["curve", "part"], "left").join(ends, "curve", "left")
    return known.select("curve", "id", "query", (F.col("at") + F.coalesce("start", before, F.lit(0))).alias("rank"))


def _best(k: int):
    """Per (curve, block), whose candidates come before its queries: the k + 1 nearest items of every query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, x, norms, ids, members = None, [], None, None, None, None
        for batch in batches:
            curve, block, query = batch["curve"].to_numpy(), batch["block"].to_numpy(), batch["query"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])]))
            for a, b in zip(cuts, np.append(cuts[1:], len(curve)), strict=True):
                part = batch.slice(a, b - a)
                if cell != (curve[a], block[a]):
                    cell, held, x = (curve[a], block[a]), [], None
                if not query[a]:
                    held.append(part)
                    continue
                if x is None:
                    if not held:
                        continue
                    x = np.concatenate([_matrix(h["v"]) for h in held]).astype(np.float64)
                    norms, ids = (x * x).sum(1), np.concatenate([h["id"].to_numpy() for h in held])
                    members = pa.concat_arrays([h["members"] for h in held])
                for at in range(0, len(part), 256):
                    q = _matrix(part["v"].slice(at, 256)).astype(np.float64)
                    near = norms[None, :] - 2 * q @ x.T  # orders like the distance
                    top = np.argpartition(near, min(k, len(x) - 1), axis=1)[:, : k + 1] if len(x) > k + 1 else np.tile(np.arange(len(x)), (len(q), 1))
                    d = np.sqrt(((q[:, None, :] - x[top]) ** 2).sum(2))
                    who = pa.array(np.repeat(part["id"].slice(at, 256).to_numpy(), top.shape[1]))
                    yield pa.RecordBatch.from_arrays([who, pa.array(ids[top.ravel()]), pa.array(d.ravel()), members.take(pa.array(top.ravel()))], ["query_id", "item", "score", "members"])

    return scan


def nearest(
    df: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    curves: int = CURVES,
    directions: int = DIRECTIONS,
    window: float | int = WINDOW,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row for which is_query holds the k nearest vectors found.

    window: ranks on either side that a query looks at on each curve, as a number or, below 1, a share of all vectors.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where(F.col("id").isNotNull() & valid(F.col("v")))
    seen = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()]
    if not seen:
        return spark.createDataFrame([], schema)
    dims = min(Counter(map(len, seen)).items(), key=lambda x: (-x[1], x[0]))[0]
    plan = Curves(np.array([v for v in seen if len(v) == dims], np.float64), curves, directions, seed)
    rows = rows.where(F.size("v") == dims)

    # row_number below a bound keeps the bound's rows in each task before they are dealt out.
    same = W.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    items = few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("members")).select(F.get("members", F.lit(0)).alias("id"), F.lit(False).alias("query"), "v", "members")
    asked = rows.where("query").select("id", "query", "v", F.array().cast("array<long>").alias("members"))
    both, _ = common.materialise(items.union(asked))
    n = both.where(~F.col("query")).count()
    half = max(1, int(np.ceil(window * n if window < 1 else window)))
    block = int(np.clip(np.ceil(half / 4), *BLOCK))
    reach = int(np.ceil(half / block))

    ranks = _ranked(both, plan).groupBy("id", "query").agg(F.collect_list(F.struct("curve", "rank")).alias("ranks"))
    placed = both.join(ranks, ["id", "query"]).select("id", "query", "v", "members", F.explode("ranks").alias("r"))
    at = F.floor(F.col("r.rank") / block)
    blocks = F.when(F.col("query"), F.sequence(at - reach, at + reach)).otherwise(F.array(at))
    cells = placed.select(F.col("r.curve").alias("curve"), "id", "query", "v", "members", F.explode(blocks).alias("block")).where(f"block between 0 and {max(n - 1, 0) // block}")
    cells = cells.repartition("curve", "block").sortWithinPartitions("curve", "block", "query")
    found = cells.mapInArrow(_best(k), "query_id long, item long, score double, members array<long>")
    found = found.groupBy("query_id", "item").agg(F.min("score").alias("score"), F.first("members").alias("members"))
    each = found.select("query_id", "score", F.explode("members").alias("vec_id")).where("query_id != vec_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K) -> list[list[int]]:
    """Brute force on one machine, to measure the recall with: the ids of the k nearest of each query."""
    out, x = [], vectors.astype(np.float64)
    for q, i in zip(queries.astype(np.float64), query_ids, strict=True):
        d = np.sqrt(((x - q) ** 2).sum(1))
        d[ids == i] = np.inf
        order = np.lexsort((ids, d))[:k]
        out.append([int(ids[j]) for j in order if np.isfinite(d[j])])
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
