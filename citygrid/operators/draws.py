"""Draws of surfaces and allocations: spread, frequency, consensus, baselines, projection in steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .growth import allocate
from .order import best, numbered, running
from .storage import cut


def ensemble(surfaces: DataFrame) -> DataFrame:
    """(row, col, mean, spread) of surfaces(draw, row, col, score); the spread is the population's."""
    return surfaces.groupBy("row", "col").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))


def top_by_draw(surfaces: DataFrame, demand: int) -> DataFrame:
    """(draw, row, col): each draw's best `demand` cells; equal scores at the limit are taken by row and col.

    Scores are ranked by ranges within a draw, so that no task holds a whole draw.
    """
    s = surfaces.groupBy("draw", "score").agg(F.count("*").alias("k"))
    placed = running(s, "score", ["k"], ["draw"], descending=True)
    sure = placed.where(F.col("before_k") + F.col("k") <= demand).select("draw", "score")
    edge = placed.where((F.col("before_k") < demand) & (F.col("before_k") + F.col("k") > demand)).select("draw", "score", (demand - F.col("before_k")).alias("left"))
    whole = surfaces.join(sure, ["draw", "score"]).select("draw", "row", "col")
    tied = surfaces.join(edge, ["draw", "score"])
    rows = running(tied.groupBy("draw", "row").agg(F.count("*").alias("k")), "row", ["k"], ["draw"]).select("draw", "row", "before_k")
    at = F.col("before_k") + F.row_number().over(Window.partitionBy("draw", "row").orderBy("col"))
    some = tied.join(rows, ["draw", "row"]).withColumn("at", at).where("at <= left").select("draw", "row", "col")
    return whole.unionByName(some)


def frequency(placed: DataFrame, cells: DataFrame, draws: int) -> DataFrame:
    """(row, col, p): the share of draws that place the cell."""
    n = placed.groupBy("row", "col").agg(F.count("*").alias("n"))
    return cells.select("row", "col").join(n, ["row", "col"], "left").select("row", "col", (F.coalesce("n", F.lit(0)) / F.lit(float(draws))).alias("p"))


def consensus(chances: DataFrame, demand: int) -> DataFrame:
    """(row, col, p): the `demand` most frequent cells; ties by row and col."""
    return best(chances, "p", ("row", "col"), demand)


def agreement(chances: DataFrame, chosen: DataFrame) -> DataFrame:
    """(n, all_draws, majority, any_draw) of the chosen cells."""
    x = chosen.select("row", "col").join(chances, ["row", "col"])
    share = lambda c: F.avg(c.cast("double"))
    p = F.col("p")
    return x.agg(F.count("*").alias("n"), share(p >= 0.999).alias("all_draws"), share(p > 0.5).alias("majority"), share(p > 0).alias("any_draw"))


def random_baseline(cells: DataFrame, observed: Column, draws: int, noise: Callable[[Column], Column]) -> DataFrame:
    """(demand, mean_hits, mean_fom): the observed number of cells placed at random, `draws` times. noise(draw): a number by cell."""
    spark = cells.sparkSession
    o = cells.select("row", "col", observed.alias("o"))
    demand = int(o.agg(F.count_if("o")).first()[0])
    n = spark.range(draws).select(F.col("id").alias("draw"))
    picked = top_by_draw(o.crossJoin(F.broadcast(n)).select("draw", "row", "col", noise(F.col("draw")).alias("score")), demand)
    per = n.join(picked.join(o, ["row", "col"]).groupBy("draw").agg(F.count_if("o").alias("hits")), "draw", "left").select(F.coalesce("hits", F.lit(0)).alias("hits"))
    fom = F.try_divide(F.col("hits"), F.col("hits") + (demand - F.col("hits")) * 2)
    return per.agg(F.lit(demand).cast("long").alias("demand"), F.avg("hits").alias("mean_hits"), F.avg(F.coalesce(fom, F.lit(0.0))).alias("mean_fom"))


def project(cells: DataFrame, demands: dict[int, int], suitability: Callable[[DataFrame], DataFrame], rows: int, cols: int, weight: float = 0.35, rounds: int = 8) -> DataFrame:
    """(year, row, col): the cells placed by each year, every step's growth feeding the next.

    cells(row, col, urban); demands: cumulative new cells by year; suitability(cells) gives (row, col, score) and is asked anew for each step.
    """
    state = cut(cells.select("row", "col", F.col("urban").alias("urban")))
    placed, out = 0, None
    for year in sorted(demands):
        step = max(0, demands[year] - placed)
        score = suitability(state)
        new = allocate(state.join(score, ["row", "col"]).select("row", "col", "score", "urban"), step, rows, cols, weight=weight, rounds=rounds).select("row", "col")
        new = cut(new.withColumn("year", F.lit(year).cast("long")))
        placed += new.count()
        state = cut(state.join(new.select("row", "col", F.lit(True).alias("now")), ["row", "col"], "left").select("row", "col", (F.col("urban") | F.coalesce("now", F.lit(False))).alias("urban")))
        out = new if out is None else out.unionByName(new)
    return out.select("year", "row", "col")


def weight_sweep(cells: DataFrame, observed: DataFrame, demand: int, weights: tuple[float, ...], rows: int, cols: int, rounds: int = 8) -> DataFrame:
    """(weight, hits, fom, best): allocation at several neighbourhood weights against observed(row, col); best: the first of the largest."""
    out = None
    total = observed.count()
    for w in weights:
        new = allocate(cells, demand, rows, cols, weight=w, rounds=rounds)
        h = F.count_if(F.col("o").isNotNull())
        g = new.join(observed.select("row", "col", F.lit(1).alias("o")), ["row", "col"], "left").agg(h.alias("hits"), F.count("*").alias("n"))
        g = g.select(F.lit(w).alias("weight"), "hits", F.try_divide(F.col("hits"), F.lit(total) + F.col("n") - F.col("hits")).alias("fom"))
        out = g if out is None else out.unionByName(g)
    out = cut(out)
    ranked = numbered(out.withColumn("_f", F.coalesce("fom", F.lit(-1.0))), "_f", ("weight", "weight"), "_i", descending=True)
    return ranked.select("weight", "hits", "fom", (F.col("_i") == 1).alias("best"))
