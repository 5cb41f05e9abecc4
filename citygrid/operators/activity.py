"""Ranks, the composite activity index, expected activity and the growth typology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import median, percentiles, running
from .storage import cut


def rank01(df: DataFrame, value: str, name: str, mask: Column | None = None, off: float | None = None, missing: str = "zero", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a rank in [0, 1] within the mask, ties at their average; off the mask `off`; missing values count as 0, or as the mask's median.

    Ranks come from a grouping by value and running counts over the distinct values of each key of `by`.
    """
    m = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    df = cut(df.withColumn("_m", m))
    if missing == "median":
        med = median(df.where("_m"), F.col(value), "_med", by)
        df = df.join(F.broadcast(med), list(by)) if by else df.join(F.broadcast(med))
        v = F.coalesce(F.col(value), F.col("_med"))
        df = df.withColumn("_v", v.cast("double")).drop("_med")
    else:
        v = F.col(value).cast("double")
        df = df.withColumn("_v", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
    counts = df.where("_m").groupBy(*by, "_v").agg(F.count("*").alias("_k"))
    total = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    placed = running(counts, "_v", ["_k"], by)
    placed = placed.join(total, list(by)) if by else placed.join(F.broadcast(total))
    ranks = placed.select(*by, "_v", ((F.col("before__k") + (F.col("_k") - 1) / 2) / F.greatest(F.col("_n") - 1, F.lit(1))).alias(name), F.lit(True).alias("_m"))
    out = df.join(ranks, [*by, "_v", "_m"], "left")
    if off is not None:
        out = out.withColumn(name, F.when(F.col("_m"), F.col(name)).otherwise(F.lit(float(off))))
    return out.drop("_v", "_m")


def weighted_index(df: DataFrame, weights: dict[str, float]) -> Column:
    """The weighted sum of those streams that are there, weights scaled to 1."""
    there = {k: w for k, w in weights.items() if k in df.columns}
    if not there:
        raise ValueError("no activity stream")
    total = sum(there.values())
    out = F.lit(0.0)
    for k, w in there.items():
        out = out + F.col(k) * F.lit(w / total)
    return out


def expected_activity(df: DataFrame, x: str, y: str, bins: int = 20, least: int = 20) -> DataFrame:
    """Adds expected: medians of y in quantile bins of x (edges without repeats, the last bin closed, at least `least` rows), interpolated
    between the bins' median x, constant beyond; the overall median if there are fewer than two bins."""
    p = [i / bins for i in range(bins + 1)]
    df = cut(df)
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = percentiles(ok, F.col(x), p).select(F.array_sort(F.array_distinct("q")).alias("e")).join(F.broadcast(median(ok, F.col(y), "all")))
    binned = ok.join(F.broadcast(edges)).withColumn("b", F.least(F.size(F.filter("e", lambda e: e <= F.col(x))), F.size("e") - 1))
    mids = binned.groupBy("b").agg(F.count("*").alias("n"), F.avg(x).alias("cx")).where(F.col("n") >= least).join(median(binned, F.col(y), "cy", ["b"]), "b")
    curve = mids.agg(F.array_sort(F.collect_list(F.struct("cx", "cy"))).alias("curve"))  # at most `bins` points
    out = df.join(F.broadcast(edges.select("all"))).join(F.broadcast(curve))
    n = F.size("curve")
    i = F.size(F.filter("curve", lambda c: c["cx"] <= F.col(x)))
    a, b = F.get("curve", F.greatest(i - 1, F.lit(0))), F.get("curve", F.least(i, n - 1))
    line = a["cy"] + (b["cy"] - a["cy"]) * (F.col(x) - a["cx"]) / (b["cx"] - a["cx"])
    at = F.when(n < 2, F.col("all")).when(i <= 0, F.get("curve", F.lit(0))["cy"]).when(i >= n, F.get("curve", n - 1)["cy"]).otherwise(line)
    return out.withColumn("expected", F.when(F.col(x).isNotNull(), at)).drop("all", "curve")


TYPES = {0: "rural", 1: "stable", 2: "filling_up", 3: "active_growth", 4: "underperforming", 5: "ghost_growth"}


def typology(df: DataFrame, urban: Column, grown: Column, low: Column, up: Column, down: Column) -> Column:
    """Class of a cell: rural, stable urban, growth that is active, growth filling up (low but rising), low activity, ghost growth (new, low and not rising).

    Later classes take precedence, as if each overwrote those before.
    """
    return (
        F.when(urban & grown & low & ~up, 5).when(urban & low & down & ~grown, 4).when(urban & grown & ~low, 3).when(urban & grown & low & up, 2).when(urban, 1).otherwise(0)
    )


def type_counts(df: DataFrame, name: str, by: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(by, type, n, share) of the classes, empty ones too; shares are of all cells (of each key)."""
    spark = df.sparkSession
    kinds = spark.range(len(TYPES)).select(F.col("id").alias(name))
    if by:
        kinds = kinds.select(name, F.explode(F.array(*[F.lit(k) for k in keys])).alias(by))
    on = [by, name] if by else [name]
    n = df.groupBy(*([by] if by else []), F.col(name).cast("long").alias(name)).agg(F.count("*").alias("n"))
    total = n.groupBy(*([by] if by else [])).agg(F.sum("n").alias("total"))
    out = kinds.join(n, on, "left")
    out = out.join(total, by, "left") if by else out.join(F.broadcast(total))
    return out.select(*on, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))
