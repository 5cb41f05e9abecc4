"""Epoch change: built-up land, urban form, vegetation and heat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, nan0
from .order import median, percentiles
from .stencil import stencil

FORMS = {0: "none", 1: "infill", 2: "edge", 3: "leapfrog"}


def two_epochs(layers: DataFrame, value: str, y0: int, y1: int) -> DataFrame:
    """(row, col, v0, v1): two years of a yearly layer side by side, in one grouping."""
    pick = lambda y: F.max(F.when(F.col("year") == y, F.col(value)))
    return layers.where(F.col("year").isin(y0, y1)).groupBy("row", "col").agg(pick(y0).alias("v0"), pick(y1).alias("v1"))


def built_change(pair: DataFrame, threshold: float = 0.2, gain: float = 0.02) -> DataFrame:
    """Adds delta, was_urban, is_urban and new_urban; new land crosses the threshold and gains at least `gain`."""
    a, b = clip(nan0(F.col("v0")), 0, 1), clip(nan0(F.col("v1")), 0, 1)
    return pair.select("row", "col", a.alias("f0"), b.alias("f1"), (b - a).alias("delta"), (a >= threshold).alias("was_urban"), (b >= threshold).alias("is_urban"), ((a < threshold) & (b >= threshold) & (b - a >= gain)).alias("new_urban"))


def expansion_form(change: DataFrame, radius: float, rows: int, cols: int, infill: float = 0.5, edge: float = 0.05) -> DataFrame:
    """Adds form (1 infill, 2 edge, 3 leapfrog, 0 none) by the share of earlier urban land around new land."""
    from .stencil import disk

    was = change.select("row", "col", F.col("was_urban").cast("double").alias("u"))
    s = stencil(was, "u", disk(radius), rows, cols).select("row", "col", (F.col("total") / F.col("weight")).alias("density"))
    form = F.when(~F.col("new_urban"), 0).when(F.col("density") >= infill, 1).when(F.col("density") >= edge, 2).otherwise(3)
    return change.join(s, ["row", "col"]).withColumn("form", form)


def form_summary(forms: DataFrame, cell_km2: float = 1.0) -> DataFrame:
    """(form, n, km2, share) of new land by form."""
    n = forms.where("form > 0").groupBy("form").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("form", "n", (F.col("n") * cell_km2).alias("km2"), (F.col("n") / F.col("total")).alias("share"))


def urban_growth(change: DataFrame, years: int) -> DataFrame:
    """One row: urban cells before and after, new and lost, and the yearly growth rate."""
    c = lambda x: F.count_if(x)
    g = change.agg(c(F.col("was_urban")).alias("urban0"), c(F.col("is_urban")).alias("urban1"), c(F.col("new_urban")).alias("gained"), c(F.col("was_urban") & ~F.col("is_urban")).alias("lost"))
    return g.withColumn("cagr", F.when((F.col("urban0") > 0) & (F.col("urban1") > 0), F.pow(F.col("urban1") / F.col("urban0"), F.lit(1.0 / years)) - 1))


def radial_profile(cells: DataFrame, value: Column, distance: Column, step: float, bins: int | None = None) -> DataFrame:
    """(ring, n, mean): half-open rings, of which empty ones are kept; without a number of them, as many as 99 % of the cells reach."""
    if bins is None:
        far = percentiles(cells, distance, [0.99]).first()["q"]
        bins = math.ceil(far[0] / step - 1e-9) if far else 0
    ring = F.floor(distance / step)
    seen = cells.select(ring.alias("ring"), value.alias("v")).where(f"ring < {bins}").groupBy("ring").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return cells.sparkSession.range(bins).select(F.col("id").alias("ring")).join(seen, "ring", "left").select("ring", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def hotspots(smooth: DataFrame, value: str, percentile: float) -> DataFrame:
    """Adds hot: at or above the percentile of the positive cells."""
    level = percentiles(smooth.where(F.col(value) > 0), F.col(value), [percentile]).select(F.col("q")[0].alias("level"))
    return smooth.join(F.broadcast(level)).select(*smooth.columns, F.coalesce((F.col(value) > 0) & (F.col(value) >= F.col("level")), F.lit(False)).alias("hot"))


def green_change(pair: DataFrame, green: float = 0.3, delta: float = 0.1) -> DataFrame:
    """Adds lost (green before, falls by delta) and gained (green after, rises by delta)."""
    d = F.col("v1") - F.col("v0")
    return pair.select("row", "col", "v0", "v1", ((F.col("v0") >= green) & (d <= -delta)).alias("lost"), ((F.col("v1") >= green) & (d >= delta)).alias("gained"))


def built_gain(pair: DataFrame, rise: float = 0.15, end: float = 0.3) -> DataFrame:
    return pair.withColumn("gain", (F.col("v1") - F.col("v0") >= rise) & (F.col("v1") >= end))


def green_deficit(built: Column, ndvi: Column, green: float = 0.3) -> Column:
    return clip(built, 0, 1) * (1 - clip(nan0(ndvi) / green, 0, 1))


def heat_island(cells: DataFrame, temperature: str, rural: Column, hot: float = 3.0, least: int = 0) -> DataFrame:
    """Adds intensity (above the median of rural cells; null if there are fewer than `least`) and hotspot."""
    base = median(cells.where(rural), F.col(temperature), "base")
    n = cells.agg(F.count_if(rural).alias("_rural"))
    i = F.when(F.col("_rural") >= least, F.col(temperature) - F.col("base"))
    return cells.join(F.broadcast(n)).join(F.broadcast(base), how="left").withColumn("intensity", i).withColumn("hotspot", F.coalesce(i >= hot, F.lit(False))).drop("base", "_rural")


def over_percentile(cells: DataFrame, value: Column, name: str, p: float = 0.99) -> DataFrame:
    """Adds value over its percentile, between 0 and 1."""
    top = percentiles(cells, value, [p]).select(F.col("q")[0].alias("top"))
    return cells.join(F.broadcast(top)).withColumn(name, clip(F.try_divide(value, F.col("top")), 0, 1)).drop("top")


def momentum(layers: DataFrame, value: str, step: int) -> DataFrame:
    """(row, col, year, momentum): gain since exactly `step` years before, not below 0."""
    w = Window.partitionBy("row", "col").orderBy("year").rangeBetween(-step, -step)
    return layers.withColumn("before", F.max(value).over(w)).where("before IS NOT NULL").select("row", "col", "year", F.greatest(F.col(value) - F.col("before"), F.lit(0.0)).alias("momentum"))
