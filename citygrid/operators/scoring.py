"""Scores of maps and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normal_tail, student_p
from .activity import rank01
from .order import numbered, percentiles, running
from .storage import cut


def confusion(df: DataFrame, predicted: Column, observed: Column, *by: str) -> DataFrame:
    """Hits, misses, false alarms, rejections and what follows from them, of the eligible rows of df."""
    g = df.groupBy(*by).agg(F.count_if(predicted & observed).alias("hits"), F.count_if(~predicted & observed).alias("misses"), F.count_if(predicted & ~observed).alias("false_alarms"), F.count_if(~predicted & ~observed).alias("rejections"))
    h, m, f, r = (F.col(c).cast("double") for c in ("hits", "misses", "false_alarms", "rejections"))
    n = h + m + f + r
    expected = F.try_divide((h + m) * (h + f) + (r + m) * (r + f), n * n)
    overall = F.try_divide(h + r, n)
    return g.select(
        *by, "hits", "misses", "false_alarms", "rejections", F.try_divide(h, h + m + f).alias("fom"), F.try_divide(h, h + m).alias("producer"), F.try_divide(h, h + f).alias("user"),
        overall.alias("overall"), F.try_divide(overall - expected, 1 - expected).alias("kappa"), F.try_divide(f + r, n).alias("null_overall"),
    )


def roc_auc(df: DataFrame, score: str, observed: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n1, n0, auc): by rank sums with average ties, exact; null if a class is missing."""
    counts = df.groupBy(*by, score).agg(F.count_if(observed).alias("k1"), F.count_if(~observed).alias("k0"))
    u = running(counts, score, ["k0"], by).withColumn("u", F.col("k1") * (F.col("before_k0") + F.col("k0") / 2))
    g = u.groupBy(*by).agg(F.sum("k1").alias("n1"), F.sum("k0").alias("n0"), F.sum("u").alias("u"))
    return g.select(*by, "n1", "n0", F.try_divide("u", F.col("n1") * F.col("n0")).alias("auc"))


def average_precision(df: DataFrame, score: str, observed: Column) -> DataFrame:
    """(n, base, ap, lift): the step-wise sum of precision over recall's gains; equal scores are one step."""
    steps = df.groupBy(score).agg(F.count("*").alias("k"), F.count_if(observed).alias("k1"))
    s = running(steps, score, ["k", "k1"], descending=True).select("k", "k1", ((F.col("before_k1") + F.col("k1")) / (F.col("before_k") + F.col("k"))).alias("precision"))
    g = s.agg(F.sum("k").alias("n"), F.sum("k1").alias("n1"), F.sum(F.col("k1") * F.col("precision")).alias("s"))
    ap, base = F.try_divide("s", "n1"), F.try_divide("n1", "n")
    return g.select("n", base.alias("base"), ap.alias("ap"), F.try_divide(ap, base).alias("lift"))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def precision_at(df: DataFrame, fractions: list[float], observed: Column, score: str, ties: tuple[str, str] = ("row", "col")) -> DataFrame:
    """(fraction, taken, hits, precision, recall) for the best rows by score, ties by two columns."""
    facts = df.agg(F.count("*").alias("n"), F.count_if(observed).alias("n1"))
    ranked = numbered(df, score, ties, "rn", descending=True).select("rn", observed.alias("o")).join(F.broadcast(facts))
    f = ranked.select("*", F.explode(F.array(*[F.lit(x) for x in fractions])).alias("fraction")).where(F.col("rn") <= F.greatest(F.lit(1), F.round(F.col("n") * F.col("fraction"))))
    return f.groupBy("fraction").agg(F.count("*").alias("taken"), F.count_if("o").alias("hits"), (F.count_if("o") / F.count("*")).alias("precision"), (F.count_if("o") / F.max("n1")).alias("recall"))


def toc(df: DataFrame, score: str, observed: Column, points: int = 200, ties: tuple[str, str] = ("row", "col")) -> DataFrame:
    """(flagged, hits): observed cells among the best, at evenly spaced cut-offs and at none."""
    n = F.col("n")
    m = F.least(F.lit(points), n)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.bround(k * (n - 1).cast("double") / F.greatest(m - 1, F.lit(1))).cast("long") + 1))
    cuts = df.agg(F.count("*").alias("n")).where("n > 0").select(at.alias("cuts"))
    placed = numbered(df, score, ties, "rn", descending=True).select("rn", observed.cast("long").alias("o")).join(F.broadcast(cuts))
    per = placed.groupBy(F.size(F.filter("cuts", lambda c: c < F.col("rn"))).alias("i")).agg(F.sum("o").alias("o"))
    per = per.agg(F.collect_list(F.struct("i", "o")).alias("per"))  # at most `points` entries
    made = cuts.join(F.broadcast(per)).select("per", F.posexplode("cuts").alias("i", "flagged"))
    hits = F.aggregate(F.filter("per", lambda x: x["i"] <= F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["o"])
    return made.select("flagged", hits.alias("hits")).union(df.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(0).cast("long")))


def regression(df: DataFrame, predicted: str, observed: str, share: float = 0.2, ties: tuple[str, str] = ("row", "col")) -> DataFrame:
    """(n, rho, r2, mae, top_precision): Spearman's rho, 1 - residual over total sum of squares, and the overlap of the best shares."""
    x = df.where(F.col(predicted).isNotNull() & F.col(observed).isNotNull())
    x = numbered(numbered(x, predicted, ties, "_rp", descending=True), observed, ties, "_ro", descending=True)
    x = x.join(F.broadcast(x.agg(F.greatest(F.lit(1), F.bround(F.lit(share) * F.count("*"))).alias("_top"))))
    p, o = F.col(predicted), F.col(observed)
    both = F.count_if((F.col("_rp") <= F.col("_top")) & (F.col("_ro") <= F.col("_top")))
    g = x.agg(F.try_divide(F.sum((o - p) * (o - p)), F.count("*") * F.var_pop(o)).alias("lost"), F.avg(F.abs(o - p)).alias("mae"), (both / F.max("_top")).alias("top_precision"))
    return spearman(df, predicted, observed).join(F.broadcast(g)).select("n", "rho", (1 - F.col("lost")).alias("r2"), "mae", "top_precision")


def calibration(df: DataFrame, p: str, observed: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, gap): quantile bins, half-open, the outer ones without end."""
    e = percentiles(df, F.col(p), [i / bins for i in range(1, bins)]).withColumnRenamed("q", "e")
    b = df.join(F.broadcast(e)).withColumn("bin", F.size(F.filter("e", lambda x: x <= F.col(p))))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(observed.cast("double")).alias("rate"))
    return g.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, rho): correlation of average-tie ranks of rows that have both; null below 3, and where one is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = rank01(rank01(both.select(*by, x, y), x, "rx", by=by), y, "ry", by=by)
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), (F.stddev_pop("rx") * F.stddev_pop("ry")).alias("d"))
    return g.select(*by, "n", F.when(F.col("n") >= 3, F.try_divide("c", "d")).alias("rho"))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs; 0 for a perfect one."""
    left = (1 - rho) * (1 + rho)
    return F.when(rho.isNotNull() & (n >= 3), F.when(left < 1e-12, 0.0).otherwise(student_p(rho * F.sqrt((n - 2) / left), n - 2)))


def mann_whitney(df: DataFrame, value: str, first: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, m, u, effect, p): how often the first group's values are above the second's, ties half; p of no more than that by chance, by the normal tail with ties and continuity; null below 3 a side."""
    x = df.select(*by, F.col(value).alias("v"), first.alias("o")).where("v IS NOT NULL")
    ties = x.groupBy(*by, "v").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum((F.pow("t", F.lit(3.0)) - F.col("t"))).alias("ties"))
    a = roc_auc(x, "v", F.col("o"), by)
    a = a.join(ties, list(by)) if by else a.join(F.broadcast(ties))
    n, m = F.col("n1").cast("double"), F.col("n0").cast("double")
    all_ = n + m
    u = F.col("auc") * n * m
    sd = F.sqrt(n * m / 12 * (all_ + 1 - F.col("ties") / (all_ * (all_ - 1))))
    enough = (n >= 3) & (m >= 3)
    z = F.try_divide(u - n * m / 2 - 0.5, sd)
    return a.select(*by, F.col("n1").alias("n"), F.col("n0").alias("m"), F.when(enough, u).alias("u"), F.when(enough, F.col("auc")).alias("effect"), F.when(enough, normal_tail(z)).alias("p"))


def loglog(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, elasticity, intercept, r2, stderr, p) of ln y on ln x, positive pairs only; null below 3. One pass of sums, whatever the number of keys."""
    pos = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    g = pos.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("s"), F.regr_intercept("ly", "lx").alias("i"), F.regr_r2("ly", "lx").alias("r2"), F.var_pop("lx").alias("sxx"), F.var_pop("ly").alias("syy")
    )
    g = g.withColumn("stderr", F.sqrt((1 - F.col("r2")) * F.try_divide("syy", "sxx") / F.greatest(F.col("n") - 2, F.lit(1))))
    ok = lambda c: F.when(F.col("n") >= 3, F.col(c))
    p = F.when(F.col("n") >= 3, F.coalesce(student_p(F.try_divide("s", "stderr"), F.col("n") - 2), F.lit(0.0)))
    return g.select(*by, "n", ok("s").alias("elasticity"), ok("i").alias("intercept"), ok("r2").alias("r2"), ok("stderr").alias("stderr"), p.alias("p"))


def at_area(maps: DataFrame, value: str, area: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, least): the value from which on a map of maps(by, value) has at least as many cells as the one row of area(n) says, and as few more as its ties allow."""
    counts = maps.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    placed = running(counts, value, ["_k"], by, descending=True).join(F.broadcast(area))
    return placed.where(F.col("before__k") + F.col("_k") >= F.col("n")).groupBy(*by).agg(F.max(value).alias("least"))


def paired(df: DataFrame, reference: str, test: str) -> DataFrame:
    """(n, slope, r2, bias, rmse)"""
    d = F.col(test) - F.col(reference)
    both = df.where(F.col(reference).isNotNull() & F.col(test).isNotNull())
    return both.agg(F.count("*").alias("n"), F.regr_slope(test, reference).alias("slope"), F.regr_r2(test, reference).alias("r2"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"))


def agreement_matrix(maps: DataFrame, flags: list[str]) -> DataFrame:
    """(a, b, n, both, only_a, only_b, overall, kappa) for each pair of boolean columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    arr = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("p")
    g = confusion(maps.select(arr).select("p.*"), F.col("y"), F.col("x"), "a", "b")
    n = F.col("hits") + F.col("misses") + F.col("false_alarms") + F.col("rejections")
    return g.select("a", "b", n.alias("n"), F.col("hits").alias("both"), F.col("misses").alias("only_a"), F.col("false_alarms").alias("only_b"), "overall", "kappa")


def kappa_matrix(maps: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """(a, b, kappa, overall, n) for each pair of boolean columns."""
    return agreement_matrix(maps, flags).select("a", "b", "kappa", "overall", "n")


def weightings(spark, draws: int, n: int) -> DataFrame:
    """(draw, w): n weights of each draw, Dirichlet(1, ..., 1): normalised -ln of hashed uniforms, so the same in every run."""
    draw = spark.range(draws).select(F.col("id").alias("draw"))
    e = [-F.log((F.pmod(F.xxhash64(F.col("draw"), F.lit(j)), F.lit(1 << 40)) + 0.5) / float(1 << 40)) for j in range(n)]
    total = sum(e[1:], e[0])
    return draw.select("draw", F.array(*[x / total for x in e]).alias("w"))


def robustness(cells: DataFrame, components: list[str], draws: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(row, col, mean_rank, top_share) of cells under the weightings draws(draw, w, ws: the sum of w; 2,000 random ones): the mean rank, and the share of draws in the top k.

    Equal scores share their mean rank. A draw's scores are ranked by ranges, so that no task holds a whole draw.
    """
    if draws is None:
        draws = weightings(cells.sparkSession, 2000, len(components)).withColumn("ws", F.lit(1.0))
    s = sum((F.col("w")[j] * F.col(c) for j, c in enumerate(components[1:], 1)), F.col("w")[0] * F.col(components[0])) / F.col("ws")
    x = cut(cells.crossJoin(F.broadcast(draws)).select("row", "col", "draw", F.round(s, 9).alias("s")))  # draws: some thousands of rows
    r = running(x.groupBy("draw", "s").agg(F.count("*").alias("n")), "s", ["n"], ("draw",), descending=True)
    r = r.select("draw", "s", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"), (F.col("before_n") < k).alias("top"))
    return x.join(r, ["draw", "s"]).groupBy("row", "col").agg(F.avg("rank").alias("mean_rank"), F.avg(F.col("top").cast("int")).alias("top_share"))
