"""Constrained growth: demand and allocation rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import FEW, best
from .stencil import disk, stencil
from .storage import cut


def extrapolate_demand(urban0: int, urban1: int, years: int, ahead: int) -> int:
    """New cells `ahead` years on at the growth rate between two counts; not below 0."""
    if urban0 <= 0 or urban1 <= urban0:
        return 0
    rate = (urban1 / urban0) ** (1 / years) - 1
    return round(urban1 * (1 + rate) ** ahead - urban1)


def allocate(cells: DataFrame, demand: int, rows: int, cols: int, radius: float = 3.0, weight: float = 0.35, rounds: int = 8) -> DataFrame:
    """(row, col, round) of exactly `demand` new cells (or all that are free) of cells(row, col, score, urban).

    Each round scores free cells by (1 - weight) * score + weight * urban share around them (edge cells go on outside), takes the best
    ceil(left / rounds left), ties by row and col, and lets them count as urban in the next.
    """
    state = cut(cells.select("row", "col", "score", F.when(F.col("urban"), 0).alias("round")))
    left = demand
    for i in range(rounds):
        take = math.ceil(left / (rounds - i))
        if take <= 0:
            break
        share = stencil(state.select("row", "col", F.col("round").isNotNull().cast("double").alias("u")), "u", disk(radius), rows, cols, "nearest").select("row", "col", (F.col("total") / F.col("weight")).alias("share"))
        scored = state.where("round IS NULL").join(share, ["row", "col"]).select("row", "col", ((1 - weight) * F.col("score") + weight * F.col("share")).alias("s"))
        taken = cut(best(scored.withColumn("s", F.round("s", 9)), "s", ("row", "col"), take).select("row", "col", F.lit(i + 1).alias("now")))
        got = taken.count()
        state = cut(state.join(F.broadcast(taken) if got <= FEW else taken, ["row", "col"], "left").select("row", "col", "score", F.coalesce("round", "now").alias("round")))
        left -= got
        if got < take:
            break
    return state.where("round > 0").select("row", "col", "round")
