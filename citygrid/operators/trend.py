"""Per-cell trends of yearly layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import log_radiance, student_p
from .order import median
from .storage import cut


def trend(series: DataFrame, value: str = "value", keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """(keys, slope, intercept, r, p, mean, n): least squares over years; from 3 years on, else null; a perfect fit has p = 0, a flat one p = 1."""
    x, y = F.col("year").cast("double"), F.col(value).cast("double")
    g = series.where(y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("mean"), F.covar_pop(x, y).alias("sxy"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy")
    )
    ok = (F.col("n") >= 3) & (F.col("sxx") > 0)
    slope = F.round(F.try_divide("sxy", "sxx"), 9)  # sums in another order don't turn a flat slope into a rising one
    r = F.when(F.col("syy") > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))))).otherwise(0.0)
    g = g.withColumns({"slope": F.when(ok, slope), "r": F.when(ok, r)})
    left = 1 - F.col("r") * F.col("r")
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(left, F.lit(1e-300)))
    p = F.when(left < 1e-12, 0.0).otherwise(student_p(t, F.col("n") - 2))
    return g.select(*keys, "slope", F.when(ok, F.col("mean") - F.col("slope") * F.col("mx")).alias("intercept"), "r", F.when(ok, p).alias("p"), "mean", "n")


def relative_series(series: DataFrame, reference: DataFrame, least: int = 30) -> DataFrame:
    """(row, col, year, value): log radiance less the year's median over the reference cells, of which there must be `least`."""
    n = reference.count()
    if n < least:
        raise ValueError(f"{n} reference cells; {least} are needed")
    logs = cut(series.select("row", "col", "year", log_radiance(F.col("value")).alias("value")))
    base = median(logs.join(reference.select("row", "col"), ["row", "col"], "left_semi"), F.col("value"), "base", ["year"])
    return logs.join(F.broadcast(base), "year").select("row", "col", "year", (F.col("value") - F.col("base")).alias("value"))


def window_mean(series: DataFrame, years: list[int]) -> DataFrame:
    """(row, col, mean) over the years; all must be there."""
    there = {r["year"] for r in series.select("year").distinct().where(F.col("year").isin(years)).collect()}
    if there != set(years):
        raise ValueError(f"no layer for {sorted(set(years) - there)}")
    return series.where(F.col("year").isin(years)).groupBy("row", "col").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"))


RULES = ("raw", "significant", "relative", "relative_significant")


def rising(rule: str, slope: Column, p: Column, relative_slope: Column, relative_p: Column, alpha: float = 0.1) -> tuple[Column, Column]:
    """(rising, falling) under a rule: raw, significant, relative or relative_significant."""
    if rule == "raw":
        return slope > 0, slope <= 0
    if rule == "significant":
        return (slope > 0) & (p < alpha), (slope < 0) & (p < alpha)
    if rule == "relative":
        return relative_slope > 0, relative_slope < 0
    if rule == "relative_significant":
        return (relative_slope > 0) & (relative_p < alpha), (relative_slope < 0) & (relative_p < alpha)
    raise ValueError(f"unknown rule: {rule}")
