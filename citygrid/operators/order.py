"""Global order without a global task: running sums, ranks and exact percentiles by ranges of the value.

Values are cut into ranges at approximate quantiles: GROUP of them, and as many times more as there are SHARE rows, up to GROUP * GROUP. Sums by
range, a short list, give each range its start; inside a range a window partitioned by it does the rest. Rows are grouped by value
first, so no value is a hot key, however often it occurs. The grouped values are looked at several times, so they are written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

GROUP = 64
SHARE = 64_000_000  #: distinct values for which GROUP ranges are enough: about a million a range
FEW = 100_000  #: rows that one task may merge and hold


def running(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds before_<s>, the sum of s over rows of smaller (descending: larger) value, for rows of distinct value in each key of by."""
    df = cut(df)
    fine = min(GROUP, 1 + df.count() // SHARE)  # ranges of each of the GROUP coarse ones
    n = GROUP * fine
    v = -F.col(value).cast("double") if descending else F.col(value).cast("double")
    cuts = F.percentile_approx(v, F.lit([i / n for i in range(1, n)]), F.lit(16 * n))
    none = F.array().cast("array<double>")
    cut_at = df.agg(F.coalesce(cuts, none).alias("_cuts")).withColumn("_coarse", F.filter("_cuts", lambda x, i: (i + 1) % fine == 0))
    upto = lambda c: F.size(F.filter(c, lambda x: x <= v))
    d = df.join(F.broadcast(cut_at)).withColumn("_range", upto(F.col("_coarse")) * fine)
    if fine > 1:
        d = d.withColumn("_range", F.col("_range") + upto(F.slice("_cuts", F.col("_range") + 1, fine - 1)))
    d = d.drop("_cuts", "_coarse")
    totals = d.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    starts = totals.groupBy(*by).agg(F.collect_list(F.struct("_range", *sums)).alias("_starts"))  # an entry a range
    d = d.join(starts, list(by)) if by else d.join(F.broadcast(starts))
    w = Window.partitionBy(*by, "_range").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    kind = dict(totals.dtypes)

    def before(s: str) -> Column:
        zero = F.lit(0).cast(kind[s])
        earlier = F.aggregate(F.filter("_starts", lambda x: x["_range"] < F.col("_range")), zero, lambda a, x: (a + x[s]).cast(kind[s]))
        return earlier + F.coalesce(F.sum(s).over(w), zero)

    return d.withColumns({f"before_{s}": before(s) for s in sums}).drop("_range", "_starts")


def value_counts(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, _v, _k): how often each value that isn't null occurs."""
    return df.select(*by, value.alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_k"))


def percentiles(df: DataFrame, value: Column, p: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q): the exact percentiles of the values that aren't null, interpolated between neighbours; q is an array, null without values."""
    placed = running(value_counts(df, value.cast("double"), by), "_v", ["_k"], by)
    n = placed.groupBy(*by).agg(F.sum("_k").alias("_n"))
    placed = placed.join(F.broadcast(n)) if not by else placed.join(n, list(by))
    first, last = F.col("before__k"), F.col("before__k") + F.col("_k") - 1
    found = []
    for i, x in enumerate(p):
        at = F.lit(float(x)) * (F.col("_n") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((first <= place) & (place <= last), F.col("_v"))).alias(f"{name}{i}"))
    g = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *found)
    out = []
    for i, x in enumerate(p):
        at = F.lit(float(x)) * (F.col("_n") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo * (F.ceil(at) - at) + hi * (at - F.floor(at))))
    return g.select(*by, F.when(F.col("_n").isNotNull(), F.array(*out)).alias("q"))


def median(df: DataFrame, value: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    return percentiles(df, value, [0.5], by).select(*by, F.col("q")[0].alias(name))


def numbered(df: DataFrame, value: str, ties: tuple[str, str], name: str, descending: bool = False) -> DataFrame:
    """Adds the row's number from 1 by value, then by the two columns of ties (of which no two rows agree in all).

    Rows meet their start by value and first tie, so those of a frequent value are dealt out by the latter.
    """
    a, b = ties
    df = cut(df)
    lines = df.groupBy(value, a).agg(F.count("*").alias("_k"))
    by_value = running(lines.groupBy(value).agg(F.sum("_k").alias("_k")), value, ["_k"], descending=descending).select(value, F.col("before__k").alias("_r0"))
    inside = Window.partitionBy(value).orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.select(value, a, F.coalesce(F.sum("_k").over(inside), F.lit(0)).alias("_r1")).join(by_value, value)
    last = F.row_number().over(Window.partitionBy(value, a).orderBy(b))
    return df.join(starts, [value, a]).withColumn(name, F.col("_r0") + F.col("_r1") + last).drop("_r0", "_r1")


def best(df: DataFrame, value: str, ties: tuple[str, str], n: int) -> DataFrame:
    """The n rows of largest value, then by the two columns of ties: up to FEW merged in one task, more by their numbers."""
    if n <= FEW:
        return df.orderBy(F.desc(value), *ties).limit(n)
    return numbered(df, value, ties, "_n", descending=True).where(F.col("_n") <= n).drop("_n")


def tiles(df: DataFrame, value: str, ties: tuple[str, str], n: int, name: str) -> DataFrame:
    """Adds the row's group from 1 to n by value and ties; groups are equal but that the first ones have one row more."""
    total = df.agg(F.count("*").alias("_n"))
    x = numbered(df, value, ties, "_i").join(F.broadcast(total))
    i, size = F.col("_i") - 1, F.floor(F.col("_n") / n)
    over = F.col("_n") - size * n
    group = F.when(i < over * (size + 1), F.floor(i / (size + 1))).otherwise(over + F.floor(F.try_divide(i - over * (size + 1), size)))
    return x.withColumn(name, (group + 1).cast("long")).drop("_i", "_n")
