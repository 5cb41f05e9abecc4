"""Scenes laid out along a space-filling curve, so that bounds in space become ranges of one key that Parquet's statistics prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 10  #: of rows and columns


def curve_key(row: Column, col: Column, bits: int = BITS) -> Column:
    """The place of a cell on the Z-shaped curve: the bits of row and column in turn."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        bit = lambda c, to, i=i: F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), to)
        out = out.bitwiseOR(bit(row, 2 * i + 1)).bitwiseOR(bit(col, 2 * i))
    return out


def key_ranges(r0: int, r1: int, c0: int, c1: int, most: int = 16, bits: int = BITS) -> list[tuple[int, int]]:
    """At most `most` ranges of keys that hold every cell of the bounds (both ends inside): squares of the curve, the smallest gaps between them closed."""
    found, todo = [], [(0, 0, bits, 0)]
    while todo:
        row, col, level, key = todo.pop()
        side = 1 << level
        if row > r1 or col > c1 or row + side <= r0 or col + side <= c0:
            continue
        if r0 <= row and row + side - 1 <= r1 and c0 <= col and col + side - 1 <= c1:
            found.append((key, key + side * side - 1))
            continue
        half = side // 2
        todo += [(row + half * i, col + half * j, level - 1, key + half * half * (2 * i + j)) for i in (0, 1) for j in (0, 1)]
    found.sort()
    out = []
    for lo, hi in found:
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    while len(out) > most:
        i = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[i - 1 : i + 1] = [(out[i - 1][0], out[i][1])]
    return out


def write_scenes(scenes: DataFrame, path: str, parts: int | None = None) -> None:
    """scenes(row, col, ...) with their key, by ranges of it and sorted, so that files and row groups hold pieces of the plane."""
    keyed = scenes.withColumn("key", curve_key(F.col("row"), F.col("col")))
    dealt = keyed.repartitionByRange(parts, "key") if parts else keyed.repartitionByRange("key")
    dealt.sortWithinPartitions("key").write.parquet(path)


def scan_scenes(spark: SparkSession, path: str, bounds: tuple[int, int, int, int], days: tuple[str, str], cloud: float) -> DataFrame:
    """Scenes of a table by write_scenes within bounds (first and last row, first and last column), taken from the first to the last day, with at most so much cloud.

    Key ranges, days and cloud reach the scan; what the ranges hold beside the bounds is filtered after it.
    """
    r0, r1, c0, c1 = bounds
    near = F.lit(False)
    for lo, hi in key_ranges(r0, r1, c0, c1):
        near = near | F.col("key").between(lo, hi)
    inside = F.col("row").between(r0, r1) & F.col("col").between(c0, c1)
    return spark.read.parquet(path).where(near).where(inside).where(F.col("day").between(*[F.lit(x).cast("date") for x in days])).where(F.col("cloud") <= cloud).drop("key")
