"""Connected zones of cells, spaced site picking and spatial blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, tiles
from .storage import cut


def label_zones(mask: DataFrame, cols: int) -> DataFrame:
    """(row, col, label) of the mask's cells (row, col): the smallest row * cols + col of the 8-connected zone.

    Each round takes the least label of the neighbourhood, then the label of the cell that the label names (pointer jumping),
    until no label changes; labels only fall, so that comes.
    """
    labels = cut(mask.select("row", "col", (F.col("row") * cols + F.col("col")).alias("label")))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    while True:
        near = labels.select("label", "row", "col", around).select("label", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
        least = near.groupBy("row", "col").agg(F.min("label").alias("new"))
        step = labels.join(least, ["row", "col"])
        jump = step.select((F.col("row") * cols + F.col("col")).alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, "new", "left").select("row", "col", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")))
        labels = step.select("row", "col", "label")
        if not step.where("old <> label").limit(1).count():
            break
    return labels


def zone_stats(zones: DataFrame, cells: DataFrame, score: str, least: int, cell_km2: float = 1.0) -> DataFrame:
    """(zone_id, label, n_cells, km2, centroid_row, centroid_col, mean_score) of zones of at least `least` cells, largest first, then by score."""
    g = zones.join(cells, ["row", "col"]).groupBy("label").agg(
        F.count("*").alias("n_cells"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"), F.avg(score).alias("mean_score")
    )
    g = numbered(g.where(F.col("n_cells") >= least).withColumn("_s", -F.col("mean_score")), "n_cells", ("_s", "label"), "zone_id", descending=True)
    return g.select("zone_id", "label", "n_cells", (F.col("n_cells") * cell_km2).alias("km2"), "centroid_row", "centroid_col", "mean_score")


def spaced(cells: DataFrame, score: str, k: int, apart: float) -> DataFrame:
    """(rank, row, col, score): greedily the best cell, then the best at least `apart` from those taken; ties by row and col.

    k rounds of a top-1 and a filter; no cell but the k taken comes to the driver.
    """
    left, taken = cut(cells.where(F.col(score).isNotNull()).select("row", "col", F.col(score).alias("score"))), []
    for _ in range(k):
        best = left.orderBy(F.desc("score"), "row", "col").limit(1).collect()
        if not best:
            break
        r = best[0]
        taken.append((len(taken) + 1, r["row"], r["col"], r["score"]))
        left = left.where((F.col("row") - r["row"]) * (F.col("row") - r["row"]) + (F.col("col") - r["col"]) * (F.col("col") - r["col"]) >= float(apart) ** 2)
    return cells.sparkSession.createDataFrame(taken, "rank int, row long, col long, score double")


def block_id(size: int, across: int) -> Column:
    return F.floor(F.col("row") / size) * across + F.floor(F.col("col") / size)


def folds(blocks: DataFrame, k: int = 5) -> DataFrame:
    """(block, fold): blocks dealt to k folds evenly in a hashed order."""
    h = (F.col("block") * 7919 + 104729) % 10007
    return tiles(blocks.select("block").distinct().withColumn("h", h), "h", ("block", "block"), k, "fold").select("block", "fold")
