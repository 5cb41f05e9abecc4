"""Neighbourhood operators: a stencil is a list of offsets with weights, joined to the cells by their shifted keys.

Boundaries: constant (nothing outside), nearest (the frame's edge goes on), reflect (mirrored at the edge).
The number of rows grows with cells times offsets; offsets are literals, so no table is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

Offsets = list[tuple[int, int, float]]


def disk(radius: float) -> Offsets:
    r = int(radius)
    return [(i, j, 1.0) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= radius * radius]


def square(r: int) -> Offsets:
    return [(i, j, 1.0) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def gravity(radius: int) -> Offsets:
    return [(i, j, 1.0 / (1.0 + i * i + j * j)) for i, j, _ in disk(radius)]


def gaussian_1d(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _shift(c: Column, by: Column, n: int, boundary: str) -> Column:
    x = c + by
    if boundary == "nearest":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), x))
    if boundary == "reflect":
        y = F.pmod(x, F.lit(2 * n))
        return F.when(y < n, y).otherwise(2 * n - 1 - y)
    return x


def stencil(cells: DataFrame, value: str, offsets: Offsets, rows: int, cols: int, boundary: str = "constant", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row, col, total, weight): the weighted sum of the neighbours' non-null values, and the weight of all offsets (constant: also of those outside)."""
    if boundary not in ("constant", "nearest", "reflect"):
        raise ValueError(f"unknown boundary: {boundary}")
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"), F.lit(float(w)).alias("w")) for i, j, w in offsets])).alias("o")
    spread = cells.select(*keys, "row", "col", o).select(*keys, "row", "col", _shift(F.col("row"), F.col("o.dr"), rows, boundary).alias("r2"), _shift(F.col("col"), F.col("o.dc"), cols, boundary).alias("c2"), "o.w")
    source = cells.select(*keys, F.col("row").alias("r2"), F.col("col").alias("c2"), F.col(value).cast("double").alias("v"))
    return spread.join(source, [*keys, "r2", "c2"], "left").groupBy(*keys, "row", "col").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("total"), F.sum("w").alias("weight"))


def circular_mean(cells: DataFrame, value: str, radius: float, rows: int, cols: int, boundary: str = "nearest") -> DataFrame:
    s = stencil(cells, value, disk(radius), rows, cols, boundary)
    return s.select("row", "col", (F.col("total") / F.col("weight")).alias("mean"))


def disk_sum(cells: DataFrame, value: str, radius: float, rows: int, cols: int) -> DataFrame:
    return stencil(cells, value, disk(radius), rows, cols).select("row", "col", F.col("total").alias("sum"))


def gaussian(cells: DataFrame, value: str, sigma: float, rows: int, cols: int) -> DataFrame:
    """(row, col, smooth): two one-dimensional passes, mirrored at the edges; null counts as 0."""
    w = gaussian_1d(sigma)
    r = len(w) // 2
    first = stencil(cells, value, [(k - r, 0, x) for k, x in enumerate(w)], rows, cols, "reflect").select("row", "col", F.col("total").alias("v"))
    return stencil(first, "v", [(0, k - r, x) for k, x in enumerate(w)], rows, cols, "reflect").select("row", "col", F.col("total").alias("smooth"))


def gaussian_ignoring_nulls(cells: DataFrame, value: str, sigma: float, rows: int, cols: int) -> DataFrame:
    """The smoothed values over the smoothed presence, null where hardly anything is present."""
    a = gaussian(cells.select("row", "col", F.coalesce(F.col(value), F.lit(0.0)).alias("v")), "v", sigma, rows, cols)
    b = gaussian(cells.select("row", "col", F.col(value).isNotNull().cast("double").alias("v")), "v", sigma, rows, cols).withColumnRenamed("smooth", "there")
    return a.join(b, ["row", "col"]).select("row", "col", F.when(F.col("there") > 1e-6, F.col("smooth") / F.col("there")).alias("smooth"))


def _envelope(at: np.ndarray, height: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """min over i of (ask - at[i])^2 + height[i] for ascending `at` and `ask`, by the lower envelope of the parabolas: linear in their number."""
    hull, start = [], []
    for i in range(len(at)):
        x = -np.inf
        while hull:
            j = hull[-1]
            x = (height[i] + at[i] ** 2 - height[j] - at[j] ** 2) / (2 * (at[i] - at[j]))
            if x > start[-1]:
                break
            hull.pop()
            start.pop()
            x = -np.inf
        hull.append(i)
        start.append(x)
    own = np.array(hull)[np.searchsorted(np.array(start), ask, side="right") - 1]
    return (ask - at[own]) ** 2 + height[own]


def _along_row(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("col")
    there = pdf["g"].notna()
    d2 = _envelope(pdf["col"][there].to_numpy(float), pdf["g"][there].to_numpy(float) ** 2, pdf["col"].to_numpy(float)) if there.any() else np.full(len(pdf), np.nan)
    return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "d2": d2})


def nearest_distance(cells: DataFrame, flag: str, cell_km: float = 1.0, cap: float = 30.0, none: float = 99.0) -> DataFrame:
    """(row, col, km): exact Euclidean distance to the nearest flagged cell, in two passes: within columns by windows, then within each row by the lower envelope of parabolas."""
    up, down = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(flag), F.col("row"))
    g = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.least(F.col("row") - F.last(here, ignorenulls=True).over(up), F.first(here, ignorenulls=True).over(down) - F.col("row")).cast("double").alias("g"))
    d = g.groupBy("row").applyInPandas(_along_row, "row long, col long, d2 double")  # a row of the frame at a time
    known = F.col("d2").isNotNull() & ~F.isnan("d2")
    return d.select("row", "col", F.when(known, F.least(F.sqrt("d2") * cell_km, F.lit(cap))).otherwise(none).alias("km"))


def summed_area(cells: DataFrame, values: list[str]) -> DataFrame:
    """(row, col, <values>): sums over all cells up to and with the row and the column, of a frame of which every cell is there. Two passes of windows, a row or a column each; null counts as 0."""
    along = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    first = cells.select("row", "col", *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(along).alias(c) for c in values])
    return first.select("row", "col", *[F.sum(c).over(down).alias(c) for c in values])


def box_means(cells: DataFrame, values: list[str], radii: list[int], rows: int, cols: int) -> DataFrame:
    """(row, col, radius, <values>): means over the square of each radius around a cell, of what of it is in the frame.

    From summed areas: four look-ups a cell and radius, however wide the square is.
    """
    table = cut(summed_area(cells, values))
    r = F.explode(F.array(*[F.lit(x).cast("long") for x in radii])).alias("radius")
    edge = lambda c, n: (F.greatest(F.col(c) - F.col("radius"), F.lit(0)) - 1, F.least(F.col(c) + F.col("radius"), F.lit(n - 1)))
    (top, bottom), (left, right) = edge("row", rows), edge("col", cols)
    corner = lambda a, b, sign: F.struct(a.cast("long").alias("r2"), b.cast("long").alias("c2"), F.lit(float(sign)).alias("sign"))
    four = F.explode(F.array(corner(bottom, right, 1), corner(top, right, -1), corner(bottom, left, -1), corner(top, left, 1)))
    ask = cells.select("row", "col", r).select("row", "col", "radius", ((bottom - top) * (right - left)).alias("n"), four.alias("k")).select("row", "col", "radius", "n", "k.*")
    at = table.select(F.col("row").cast("long").alias("r2"), F.col("col").cast("long").alias("c2"), *values)
    got = ask.join(at, ["r2", "c2"]).groupBy("row", "col", "radius")  # corners outside the frame find nothing: 0
    return got.agg(*[(F.sum(F.col("sign") * F.col(c)) / F.max("n")).alias(c) for c in values])
