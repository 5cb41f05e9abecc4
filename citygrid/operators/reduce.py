"""Block reducers: a block is a square of cells, ragged at the frame's edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import percentiles


def block(c: str, factor: int) -> Column:
    return F.floor(F.col(c) / factor)


def majority(cls: Column) -> Column:
    """Most frequent class, the lowest on ties, 0 without any."""
    return F.coalesce(F.mode(cls, deterministic=True), F.lit(0))


def priority(cls: Column, order: Sequence[int]) -> Column:
    """The first class of the order that is present, else its last."""
    rank = F.lit(len(order) - 1)
    for i, k in reversed(list(enumerate(order))):
        rank = F.when(cls == k, i).otherwise(rank)
    return F.element_at(F.array(*[F.lit(k) for k in order]), F.min(F.coalesce(rank, F.lit(len(order) - 1))) + 1)


REDUCERS = {
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),  # nulls left out
    "mean0": lambda c: F.avg(F.coalesce(c, F.lit(0.0))),  # nulls count as 0
    "max": lambda c: F.max(c),
    "any": lambda c: (F.sum(c.cast("double")) > 0).cast("int"),
    "majority": majority,
}


def block_reduce(cells: DataFrame, factor: int, how: dict[str, str], orders: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """(row, col, <columns>) by block, each column by its reducer; 'priority' needs its class order. Factor 1 returns the cells as they are."""
    unknown = set(how.values()) - {*REDUCERS, "priority"}
    if unknown:
        raise ValueError(f"unknown reducer: {sorted(unknown)}")
    if factor == 1:
        return cells.select("row", "col", *how)
    made = [(priority(F.col(c), (orders or {})[c]) if h == "priority" else REDUCERS[h](F.col(c))).alias(c) for c, h in how.items()]
    return cells.groupBy(block("row", factor).alias("row"), block("col", factor).alias("col")).agg(*made)


def summarise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mean, median, p90, max, sum, n_nonzero) a row per column, of finite values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    g = long.groupBy("name").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.count_if(F.col("v") != 0).alias("n_nonzero"))
    q = percentiles(long, F.col("v"), [0.5, 0.9], ["name"]).select("name", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))
    return g.join(q, "name").select("name", "mean", "median", "p90", "max", "sum", "n_nonzero")


def quantile_profile(df: DataFrame, value: Column, *by: str) -> DataFrame:
    q = percentiles(df, value, (0.05, 0.25, 0.5, 0.75, 0.95), by).withColumnRenamed("q", "p")
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    out = out.join(q, list(by), "left") if by else out.join(F.broadcast(q))
    return out.select(*by, "n", *[F.col("p")[i].alias(n) for i, n in enumerate(("p5", "q1", "med", "q3", "p95"))], "mean")
