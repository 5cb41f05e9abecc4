"""Points, roads and tables on the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def density(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(row, col, n) with 0 for empty cells."""
    n = points.groupBy("row", "col").agg(F.count("*").alias("n"))
    return cells.select("row", "col").join(n, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


def road_pieces(vertices: DataFrame, step: float, cell: float, weights: dict[str, float], other: float = 0.5) -> DataFrame:
    """(way_id, row, col, metres): segments cut into pieces of at most `step`, each at its middle's cell, its length times the class's weight."""
    w = Window.partitionBy("way_id").orderBy("seq")
    seg = vertices.select("way_id", "class", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")
    length = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    seg = seg.withColumns({"len": length, "n": n}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = (F.col("k") + 0.5) / F.col("n")
    k = F.lit(other)
    for c, v in weights.items():
        k = F.when(F.col("class") == c, v).otherwise(k)
    x, y = F.col("x") + (F.col("x2") - F.col("x")) * t, F.col("y") + (F.col("y2") - F.col("y")) * t
    return seg.select("way_id", F.floor(y / cell).alias("row"), F.floor(x / cell).alias("col"), (F.col("len") / F.col("n") * k).alias("metres"))


def junctions(vertices: DataFrame, snap: float, cell: float) -> DataFrame:
    """(row, col, n): snapped vertices that at least two ways share, counted by cell."""
    p = vertices.select("way_id", F.round(F.col("x") / snap).cast("long").alias("sx"), F.round(F.col("y") / snap).cast("long").alias("sy")).distinct()
    shared = p.groupBy("sx", "sy").agg(F.count("*").alias("ways")).where("ways >= 2")
    return shared.groupBy(F.floor(F.col("sy") * snap / cell).alias("row"), F.floor(F.col("sx") * snap / cell).alias("col")).agg(F.count("*").alias("n"))


def mix(points: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(row, col, n, kinds, footfall, entropy): natural-log entropy of the groups' shares."""
    w = F.lit(0.0)
    for g, v in weights.items():
        w = F.when(F.col("group") == g, v).otherwise(w)
    per = points.groupBy("row", "col", "group").agg(F.count("*").alias("k"), F.sum(w).alias("f"))
    n = F.sum("k")
    return per.groupBy("row", "col").agg(n.alias("n"), F.count("*").alias("kinds"), F.sum("f").alias("footfall"), (F.ln(n) - F.sum(F.col("k") * F.ln("k")) / n).alias("entropy"))


def cell_of(c: Column, origin: float, size: float) -> Column:
    """The index of a coordinate's cell, cut towards zero."""
    return ((c - origin) / size).cast("long")


def by_alias(rows: DataFrame, name: str, aliases: dict[str, str], value: str) -> DataFrame:
    """(name, n, total): names through a table of aliases (those without one in lower case), summed by what they become."""
    table = rows.sparkSession.createDataFrame(list(aliases.items()), "alias string, to string")  # a literal table
    x = rows.join(F.broadcast(table), F.col(name) == F.col("alias"), "left")
    return x.groupBy(F.coalesce("to", F.lower(name)).alias("name")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
