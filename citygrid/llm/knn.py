"""Exact top-k inner products by a Voronoi join: groups by pivots, bounds from summaries, replicas only where needed.

Components become floor(scale * x), so scores are whole numbers. Inner products become distances: with M the largest norm of the data,
a data vector y gets one more component sqrt(M^2 - |y|^2), a query 0; then |x - y|^2 = |x|^2 + M^2 - 2 x.y, and the best products of a
query are its nearest data.
1. Pivots: at most PIVOTS vectors, those with the smallest hashes of their ids. Every vector goes to its nearest pivot's group.
2. Summaries: per query group its radius, per data group the counts of members by distance to the pivot, on a
   grid of 1000 steps; that is all that the driver sees.
   They bound the k-th distance of every query of a group from above, by the triangle inequality.
3. A data vector is copied to a query group only if a lower bound of its distance to the group's queries, by the groups' and its own
   pivot distances, isn't above that bound.
4. A query group and SLICES slices of its replicas are solved by block products; slices' k best are merged by query.
Hot groups are cut into slices, queries are cut into blocks of at most QUERIES rows, and no task holds more than a block of each.
Bounds are kept SLACK apart, so that rounding and ties lose nothing.

Vectors that are null or have null or non-finite components take no part; missing trailing components count as 0. Ties go to the
smaller id. Repeated ids are rows of their own, as data and as queries: each query row has its own ranking, and leaves out all rows with
its own id. Every query has to meet every group that the bounds can't rule out, so the work grows with queries times data; blocks and slices
are large, so that what is shuffled is some thousandths of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

PIVOTS = 48
QUERIES = 8192
SLICE = 50_000  #: replicas per slice, about
SLACK = 1e-6


def _stack(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(row, column) of each row's k best, ties to smaller ids, without its own id."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    n = scores.shape[1]
    if n > 4 * k + 64:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
    else:
        floor = np.full(scores.shape[0], -np.inf)
    for i in range(scores.shape[0]):
        at = np.flatnonzero(scores[i] >= floor[i])
        at = at[np.lexsort((ids[at], -scores[i, at]))][:k]
        for j in at:
            if scores[i, j] > -np.inf:
                yield i, int(ids[j]), float(scores[i, j])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors and queries are (vec_id, embedding)."""
    spark = vectors.sparkSession
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL").where(whole)
        return df.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("v"))

    data, query = clean(vectors), clean(queries).withColumn("qid", F.monotonically_increasing_id())
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = data.agg(F.max(norm).alias("m"), F.max(F.size("v")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if facts["m"] is None:
        return spark.createDataFrame([], schema)
    m2, width = float(facts["m"]), max(int(facts["d"]), int(query.agg(F.max(F.size("v"))).first()[0] or 0))
    chosen = data.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(pivots).collect()  # at most PIVOTS vectors
    p = _stack([r["v"] for r in chosen], width)
    p = np.unique(np.column_stack((p, np.sqrt(np.maximum(m2 - (p * p).sum(axis=1), 0)))), axis=0)

    def grouped(last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _stack(list(pdf["v"]), width)
                x = np.column_stack((x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0)) if last else np.zeros(len(x))))
                d2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T
                near = d2.argmin(axis=1)
                yield pdf.assign(cell=near.astype(np.int32), far=np.sqrt(np.maximum(((x - p[near]) ** 2).sum(axis=1), 0)))

        return run

    data = cut(data.mapInPandas(grouped(True), "vec_id long, v array<double>, cell int, far double"), "data")
    query = cut(query.mapInPandas(grouped(False), "vec_id long, v array<double>, qid long, cell int, far double"), "query")
    q = query.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas()  # a row per pivot, at most
    # the k + 1 nearest of each cell: distances are first rounded up to a grid, whose counts are all that is gathered
    top = float(data.agg(F.max("far")).first()[0]) + 1.0
    grid = data.groupBy("cell", F.ceil(F.col("far") / top * 1000).alias("g")).agg(F.count("*").alias("n")).toPandas()  # at most 1001 rows a pivot
    between = np.sqrt(np.maximum((p * p).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * p @ p.T, 0))
    again = int(data.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0])  # rows of one id, which its query leaves out
    reach, parts = {}, {}
    cell, far, count = grid["cell"].to_numpy(int), grid["g"].to_numpy(float) / 1000 * top, grid["n"].to_numpy(np.int64)
    for c, n, radius in q.itertuples(index=False):
        upper = radius + between[c, cell] + far
        order = np.argsort(upper)
        enough = np.searchsorted(np.cumsum(count[order]), k + again)
        reach[c] = (float(upper[order][enough]) if enough < order.size else np.inf, float(radius))
        parts[c] = -(-int(n) // QUERIES)
    size = int(count.sum())
    slices = max(1, -(-size // SLICE))

    def replicas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, far = pdf["cell"].to_numpy(int), pdf["far"].to_numpy(float)
            for c, (bound, radius) in reach.items():
                least = np.abs(between[c, own] - far) - radius
                need = least <= bound * (1 + SLACK) + SLACK
                if need.any():
                    yield pdf.loc[need, ["vec_id", "v"]].assign(group=np.int32(c))

    copies = data.mapInPandas(lean(replicas), "vec_id long, v array<double>, group int")
    # a slice of a group's replicas meets each of the group's blocks of queries
    salt = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).cast("int")
    counts = spark.createDataFrame([(int(c), int(n)) for c, n in parts.items()] or [(-1, 1)], "group int, blocks int")
    copies = copies.withColumn("slice", salt).join(F.broadcast(counts), "group")  # counts: a row per pivot
    copies = copies.select("group", "slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    asked = query.withColumnRenamed("cell", "group").join(F.broadcast(counts), "group")
    asked = asked.select("group", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block"), "qid", "vec_id", "v")
    asked = asked.select("group", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "block", "qid", "vec_id", "v")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            y, ids = _stack(list(right["v"]), width), right["vec_id"].to_numpy(np.int64)
            for i in range(0, len(left), 64):
                part = left.iloc[i : i + 64]
                own, qid = part["vec_id"].to_numpy(np.int64), part["qid"].to_numpy(np.int64)
                for j, vec, score in _best(_stack(list(part["v"]), width) @ y.T, ids, own, k):
                    rows.append((int(qid[j]), int(own[j]), vec, int(score)))
        return pd.DataFrame(rows, columns=["qid", "query_id", "vec_id", "score"])

    on = ["group", "block", "slice"]
    local = asked.groupBy(*on).cogroup(copies.groupBy(*on)).applyInPandas(solve, "qid long, query_id long, vec_id long, score long")
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    merged = local.groupBy("qid", "query_id").agg(F.slice(best, 1, k).alias("best"))  # k rows a slice
    return merged.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS qid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.qid, q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
