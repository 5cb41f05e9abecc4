"""Queries of the grid: block reducers, change, form, stencils, vegetation and heat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import change as C
from ..operators import reduce as B
from ..operators import stencil as S
from ..operators import vector as V
from ..operators import zones as Z
from ..sources import views as v
from .registry import R, query

N = v.ROWS
PAIR = "pair AS (SELECT row, col, max(frac) FILTER (WHERE year = 1997) AS v0, max(frac) FILTER (WHERE year = 2001) AS v1 FROM built GROUP BY row, col)"
CHG = PAIR + ", chg AS (SELECT row, col, v0, v1, v1 - v0 AS delta, v0 >= 0.3 AS was, v1 >= 0.3 AS is_, v0 < 0.3 AND v1 >= 0.3 AND v1 - v0 >= 0.05 AS new_ FROM pair)"


def pair(spark, d, a=1997, b=2001):
    return C.two_epochs(v.built(spark, d), "frac", a, b)


def chg(spark, d):
    return C.built_change(pair(spark, d), 0.3, 0.05)


def lights_in(spark, d, year):
    return v.lights(spark, d).where(F.col("year") == year).select("row", "col", F.nullif("value", F.lit(0.0)).alias("v"))


CLS = "(CASE WHEN value = 0 THEN 0 WHEN value < 60 THEN 1 WHEN value < 120 THEN 2 ELSE 4 END)"


def classes(spark, d):
    x = F.col("value")
    return v.lights(spark, d).where("year = 1999").select("row", "col", F.when(x == 0, 0).when(x < 60, 1).when(x < 120, 2).otherwise(4).alias("cls"))


@query(f"SELECT row // 7 AS row, col // 7 AS col, {R('sum(people)')} AS people FROM population WHERE year = 2001 GROUP BY 1, 2")
def grid_sum_blocks(spark, d):
    return B.block_reduce(v.population(spark, d).where("year = 2001"), 7, {"people": "sum"})


@query(f"SELECT row // 5 AS row, col // 5 AS col, {R('avg(nullif(value, 0))')} AS v FROM lights WHERE year = 1995 GROUP BY 1, 2")
def grid_mean_blocks(spark, d):
    return B.block_reduce(lights_in(spark, d, 1995), 5, {"v": "mean"})


@query(f"SELECT row // 5 AS row, col // 5 AS col, {R('max(nullif(value, 0))')} AS v FROM lights WHERE year = 1995 GROUP BY 1, 2")
def grid_max_blocks(spark, d):
    return B.block_reduce(lights_in(spark, d, 1995), 5, {"v": "max"})


@query("SELECT row // 3 AS row, col // 3 AS col, (sum((value > 150)::INT) > 0)::BIGINT AS bright FROM lights WHERE year = 1998 GROUP BY 1, 2")
def grid_any_blocks(spark, d):
    return B.block_reduce(v.lights(spark, d).where("year = 1998").select("row", "col", (F.col("value") > 150).alias("bright")), 3, {"bright": "any"})


@query(
    f"""WITH k AS (SELECT row // 5 AS row, col // 5 AS col, {CLS} AS cls, count(*) AS n FROM lights WHERE year = 1999 GROUP BY 1, 2, 3)
SELECT row, col, arg_max(cls, n * 10 - cls)::BIGINT AS cls FROM k GROUP BY 1, 2"""
)
def grid_majority_blocks(spark, d):
    return B.block_reduce(classes(spark, d), 5, {"cls": "majority"})


@query(
    f"""WITH k AS (SELECT row // 2 AS row, col // 2 AS col, min(CASE {CLS} WHEN 4 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS r FROM lights WHERE year = 1999 GROUP BY 1, 2)
SELECT row, col, [4, 2, 1, 0][r + 1]::BIGINT AS cls FROM k"""
)
def grid_priority_blocks(spark, d):
    return B.block_reduce(classes(spark, d), 2, {"cls": "priority"}, {"cls": [4, 2, 1, 0]})


@query(
    f"""SELECT l.row // 5 AS row, l.col // 5 AS col, {R('sum(people)')} AS people, {R('avg(value)')} AS light, max(frac >= 0.5)::INT::BIGINT AS urban, {R('max(frac)')} AS top
FROM lights l JOIN population p USING (row, col, year) JOIN built b USING (row, col, year) WHERE year = 2000 GROUP BY 1, 2"""
)
def reporting_grid(spark, d):
    keys = ["row", "col", "year"]
    wide = v.lights(spark, d).join(v.population(spark, d), keys).join(v.built(spark, d), keys).where("year = 2000")
    wide = wide.select("row", "col", "people", F.col("value").alias("light"), (F.col("frac") >= 0.5).alias("urban"), F.col("frac").alias("top"))
    return B.block_reduce(wide, 5, {"people": "sum", "light": "mean", "urban": "any", "top": "max"})


@query(f"SELECT row // 5 AS row, col // 5 AS col, {R('avg(coalesce(nullif(value, 0), 0))')} AS v FROM lights WHERE year = 1996 GROUP BY 1, 2")
def city_block_mean(spark, d):
    return B.block_reduce(lights_in(spark, d, 1996), 5, {"v": "mean0"})


@query(f"SELECT row // 5 AS row, col // 5 AS col, {R('avg(value) FILTER (WHERE frac >= 0.3)')} AS masked, {R('sum(CASE WHEN frac >= 0.3 THEN value END) / greatest(count(*) FILTER (WHERE frac >= 0.3), 1)')} AS eligible FROM lights JOIN built USING (row, col, year) WHERE year = 2001 GROUP BY 1, 2")
def masked_block_mean(spark, d):
    x = v.lights(spark, d).join(v.built(spark, d), ["row", "col", "year"]).where("year = 2001")
    inside = F.when(F.col("frac") >= 0.3, F.col("value"))
    return x.groupBy(B.block("row", 5).alias("row"), B.block("col", 5).alias("col")).agg(F.avg(inside).alias("masked"), (F.sum(inside) / F.greatest(F.count(inside), F.lit(1))).alias("eligible"))


_SUM = "SELECT '{0}' AS name, " + ", ".join([R("avg({0})") + " AS mean", R("quantile_cont({0}, 0.5)") + " AS median", R("quantile_cont({0}, 0.9)") + " AS p90", R("max({0})") + " AS max", R("sum({0})") + " AS sum"]) + ", count(*) FILTER (WHERE {0} <> 0) AS n_nonzero FROM w"


@query("WITH w AS (SELECT value AS light, frac AS built FROM lights JOIN built USING (row, col, year) WHERE year = 2001) " + _SUM.format("light") + " UNION ALL " + _SUM.format("built"))
def grid_summary(spark, d):
    w = v.lights(spark, d).join(v.built(spark, d), ["row", "col", "year"]).where("year = 2001").select(F.col("value").alias("light"), F.col("frac").alias("built"))
    return B.summarise(w, ["light", "built"])


@query(
    "SELECT year, count(value) AS n, " + ", ".join(R(f"quantile_cont(value, {q})") + f" AS {n}" for q, n in ((0.05, "p5"), (0.25, "q1"), (0.5, "med"), (0.75, "q3"), (0.95, "p95"))) + f", {R('avg(value)')} AS mean FROM lights GROUP BY year"
)
def quantile_profile(spark, d):
    return B.quantile_profile(v.lights(spark, d), F.col("value"), "year")


@query(f"WITH {CHG} SELECT row, col, {R('v0')} AS f0, {R('v1')} AS f1, {R('delta')} AS delta, was AS was_urban, is_ AS is_urban, new_ AS new_urban FROM chg")
def builtup_change(spark, d):
    return chg(spark, d)


@query(
    f"""WITH {CHG}, g AS (SELECT count(*) FILTER (WHERE was) AS urban0, count(*) FILTER (WHERE is_) AS urban1, count(*) FILTER (WHERE new_) AS gained, count(*) FILTER (WHERE was AND NOT is_) AS lost FROM chg)
SELECT *, CASE WHEN urban0 > 0 AND urban1 > 0 THEN {R('(urban1 / urban0) ** 0.25 - 1')} END AS cagr FROM g"""
)
def urban_cagr(spark, d):
    return C.urban_growth(chg(spark, d), 4)


FORM = CHG + ", dens AS (SELECT c.row, c.col, coalesce(sum(n.was::INT), 0) / 29.0::DOUBLE AS density FROM chg c CROSS JOIN disk3 o LEFT JOIN chg n ON n.row = c.row + o.dr AND n.col = c.col + o.dc GROUP BY 1, 2), form AS (SELECT c.*, density, CASE WHEN NOT new_ THEN 0 WHEN density >= 0.5 THEN 1 WHEN density >= 0.05 THEN 2 ELSE 3 END AS form FROM chg c JOIN dens USING (row, col))"


def forms(spark, d):
    return C.expansion_form(chg(spark, d), 3, N, N)


@query(f"WITH {FORM} SELECT row, col, {R('density')} AS density, form::BIGINT AS form FROM form")
def expansion_form(spark, d):
    return forms(spark, d).select("row", "col", "density", "form")


@query(f"WITH {FORM} SELECT form::BIGINT AS form, count(*) AS n, {R('count(*)')} AS km2, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM form WHERE form > 0 GROUP BY form")
def form_summary(spark, d):
    return C.form_summary(forms(spark, d))


@query(
    f"""WITH {FORM}, b AS (SELECT row // 5 AS row, col // 5 AS col, min(CASE form WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS r, sum(new_::INT) AS new_cells FROM form GROUP BY 1, 2)
SELECT row, col, [3, 2, 1, 0][r + 1]::BIGINT AS form, new_cells::BIGINT AS new_cells FROM b"""
)
def new_land_blocks(spark, d):
    """Reporting blocks with new urban land, and of which kind."""
    f = forms(spark, d).select("row", "col", "form", F.col("new_urban").cast("int").alias("new_cells"))
    return B.block_reduce(f, 5, {"form": "priority", "new_cells": "sum"}, {"form": [3, 2, 1, 0]})


@query(f"WITH {PAIR} SELECT r.i AS ring, count(v1) AS n, {R('avg(v1)')} AS mean FROM range(40) r(i) LEFT JOIN pair ON floor(sqrt((row - 24.5) ** 2 + (col - 24.5) ** 2))::BIGINT = r.i GROUP BY 1")
def radial_profile(spark, d):
    dist = F.sqrt(F.pow(F.col("row") - 24.5, F.lit(2.0)) + F.pow(F.col("col") - 24.5, F.lit(2.0)))
    return C.radial_profile(pair(spark, d), F.col("v1"), dist, 1.0, 40)


def _gauss_sql(source: str, value: str, sigma: float) -> str:
    w = S.gaussian_1d(sigma)
    r = len(w) // 2
    tab = ", ".join(f"({k - r}, {x!r}::DOUBLE)" for k, x in enumerate(w))
    ref = lambda c: f"(CASE WHEN (({c}) + 100) % 100 < 50 THEN (({c}) + 100) % 100 ELSE 99 - (({c}) + 100) % 100 END)"
    return f"""gw AS (SELECT * FROM (VALUES {tab}) t(k, w)),
g1 AS (SELECT c.row, c.col, sum(coalesce(s.{value}, 0) * w) AS x FROM {source} c CROSS JOIN gw JOIN {source} s ON s.col = c.col AND s.row = {ref("c.row + k")} GROUP BY 1, 2),
g2 AS (SELECT c.row, c.col, sum(s.x * w) AS smooth FROM g1 c CROSS JOIN gw JOIN g1 s ON s.row = c.row AND s.col = {ref("c.col + k")} GROUP BY 1, 2)"""


@query(f"WITH {CHG}, dd AS (SELECT row, col, greatest(delta, 0) AS delta FROM chg), {_gauss_sql('dd', 'delta', 1.5)}, lv AS (SELECT quantile_cont(smooth, 0.9) AS l FROM g2 WHERE smooth > 0) SELECT row, col, {R('smooth')} AS smooth, coalesce(smooth > 0 AND round(smooth, 9) >= round(l, 9), false) AS hot FROM g2, lv")
def growth_hotspots(spark, d):
    s = S.gaussian(chg(spark, d).select("row", "col", F.greatest("delta", F.lit(0.0)).alias("delta")), "delta", 1.5, N, N)
    return C.hotspots(s.withColumn("r", F.round("smooth", 9)), "r", 0.9).select("row", "col", "smooth", "hot")


@query(f"SELECT a.row, a.col, {R('avg(b.frac)')} AS mean FROM (SELECT * FROM built WHERE year = 2000) a CROSS JOIN disk3 o JOIN built b ON b.year = 2000 AND b.row = greatest(0, least(49, a.row + o.dr)) AND b.col = greatest(0, least(49, a.col + o.dc)) GROUP BY 1, 2")
def circular_mean(spark, d):
    return S.circular_mean(v.built(spark, d).where("year = 2000"), "frac", 3, N, N)


@query(f"SELECT a.row, a.col, {R('sum(b.people)')} AS sum FROM cells a CROSS JOIN disk3 o JOIN population b ON b.year = 2001 AND b.row = a.row + o.dr AND b.col = a.col + o.dc GROUP BY 1, 2")
def disk_population(spark, d):
    return S.disk_sum(v.population(spark, d).where("year = 2001"), "people", 3, N, N)


@query(f"WITH s AS (SELECT row, col, value FROM lights WHERE year = 2001), {_gauss_sql('s', 'value', 1.0)} SELECT row, col, {R('smooth')} AS smooth FROM g2")
def gaussian_smooth(spark, d):
    return S.gaussian(v.lights(spark, d).where("year = 2001"), "value", 1.0, N, N)


@query(f"""WITH s AS (SELECT a.row, a.col, avg(b.value) AS mean FROM lights a CROSS JOIN range(-1, 2) i(dr) CROSS JOIN range(-1, 2) j(dc)
JOIN lights b ON b.year = 2001 AND b.row = greatest(0, least(49, a.row + dr)) AND b.col = greatest(0, least(49, a.col + dc)) WHERE a.year = 2001 GROUP BY 1, 2) SELECT row, col, {R('mean')} AS mean FROM s""")
def uniform_mean(spark, d):
    s = S.stencil(v.lights(spark, d).where("year = 2001"), "value", S.square(1), N, N, "nearest")
    return s.select("row", "col", (F.col("total") / F.col("weight")).alias("mean"))


@query(f"SELECT a.row, a.col, {R('coalesce(sum(p.n / (1.0 + o.dr * o.dr + o.dc * o.dc)), 0)')} AS access FROM cells a CROSS JOIN disk3 o LEFT JOIN (SELECT row, col, count(*) AS n FROM poi WHERE grp = 'purchase' GROUP BY 1, 2) p ON p.row = a.row + o.dr AND p.col = a.col + o.dc GROUP BY 1, 2")
def gravity_access(spark, d):
    n = V.density(v.poi(spark, d).where("group = 'purchase'"), v.grid(spark))
    return S.stencil(n, "n", S.gravity(3), N, N).select("row", "col", F.col("total").alias("access"))


@query(f"WITH {PAIR} SELECT a.row, a.col, {R('least(30, coalesce(min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)), 99))')} AS km FROM pair a LEFT JOIN pair b ON b.v1 >= 0.6 GROUP BY 1, 2")
def edge_distance(spark, d):
    return S.nearest_distance(pair(spark, d).withColumn("far", F.col("v1") >= 0.6), "far")


NDVI = "nd AS (SELECT row, col, max(1 - frac) FILTER (WHERE year = 1996) AS v0, max(1 - frac) FILTER (WHERE year = 2001) AS v1 FROM built GROUP BY row, col)"


def ndvi(spark, d):
    """A stand-in for a vegetation index: what isn't built."""
    return C.two_epochs(v.built(spark, d).withColumn("g", 1 - F.col("frac")), "g", 1996, 2001)


@query(f"WITH {NDVI} SELECT row, col, {R('v0')} AS v0, {R('v1')} AS v1, v0 >= 0.6 AND v1 - v0 <= -0.3 AS lost, v1 >= 0.6 AND v1 - v0 >= 0.3 AS gained FROM nd")
def green_change(spark, d):
    return C.green_change(ndvi(spark, d), 0.6, 0.3)


@query(f"WITH {NDVI} SELECT count(*) FILTER (WHERE v0 >= 0.6 AND v1 - v0 <= -0.3) AS lost, count(*) FILTER (WHERE v0 >= 0.6 AND v1 - v0 <= -0.3 AND v1 <= 0.5) AS to_built, {R('avg(v1 - v0)')} AS mean_delta FROM nd")
def green_conversion(spark, d):
    g = C.green_change(ndvi(spark, d), 0.6, 0.3)
    return g.agg(F.count_if("lost").alias("lost"), F.count_if(F.col("lost") & (F.col("v1") <= 0.5)).alias("to_built"), F.avg(F.col("v1") - F.col("v0")).alias("mean_delta"))


@query(f"WITH {PAIR} SELECT row, col, {R('v0')} AS v0, {R('v1')} AS v1, v1 - v0 >= 0.15 AND v1 >= 0.3 AS gain FROM pair")
def built_gain(spark, d):
    return C.built_gain(pair(spark, d))


@query(f"WITH {NDVI} SELECT row, col, {R('greatest(0, least(1, 1 - v1)) * (1 - greatest(0, least(1, v1 / 0.3)))')} AS deficit FROM nd")
def green_deficit(spark, d):
    return ndvi(spark, d).select("row", "col", C.green_deficit(1 - F.col("v1"), F.col("v1")).alias("deficit"))


HEAT = "h AS (SELECT row, col, value / 10 AS t, frac FROM lights JOIN built USING (row, col, year) WHERE year = 2000), hb AS (SELECT median(t) AS base FROM h WHERE frac < 0.3), hi AS (SELECT row, col, frac, t - base AS intensity, t - base >= 3 AS hotspot FROM h, hb)"


def heat(spark, d):
    h = v.lights(spark, d).join(v.built(spark, d), ["row", "col", "year"]).where("year = 2000").select("row", "col", (F.col("value") / 10).alias("t"), "frac")
    return C.heat_island(h, "t", F.col("frac") < 0.3)


@query(f"WITH {HEAT} SELECT row, col, {R('intensity')} AS intensity, hotspot FROM hi")
def heat_island(spark, d):
    return heat(spark, d).select("row", "col", "intensity", "hotspot")


@query(f"WITH {HEAT} SELECT {R('max(intensity)')} AS top, {R('avg(intensity) FILTER (WHERE frac >= 0.3)')} AS mean_urban, {R('avg(intensity) FILTER (WHERE intensity > 0)')} AS mean_positive, count(*) FILTER (WHERE hotspot) AS hot FROM hi")
def heat_summary(spark, d):
    i = F.col("intensity")
    return heat(spark, d).agg(F.max(i).alias("top"), F.avg(F.when(F.col("frac") >= 0.3, i)).alias("mean_urban"), F.avg(F.when(i > 0, i)).alias("mean_positive"), F.count_if("hotspot").alias("hot"))


@query(f"WITH {HEAT}, x AS (SELECT row, col, greatest(intensity, 0) * people * (2 - (1 - hi.frac)) AS raw FROM hi JOIN population p USING (row, col) WHERE p.year = 2000), t AS (SELECT quantile_cont(raw, 0.99) AS top FROM x) SELECT row, col, {R('greatest(0, least(1, raw / nullif(top, 0)))')} AS vulnerability FROM x, t")
def heat_vulnerability(spark, d):
    x = heat(spark, d).join(v.population(spark, d).where("year = 2000").drop("year"), ["row", "col"])
    raw = F.greatest("intensity", F.lit(0.0)) * F.col("people") * (2 - (1 - F.col("frac")))
    return C.over_percentile(x, raw, "vulnerability").select("row", "col", "vulnerability")


@query(f"WITH m AS (SELECT row, col, year, frac - lag(frac, 3) OVER (PARTITION BY row, col ORDER BY year) AS g FROM built) SELECT row, col, year, {R('greatest(g, 0)')} AS momentum FROM m WHERE g IS NOT NULL")
def growth_momentum(spark, d):
    return C.momentum(v.built(spark, d), "frac", 3)


@query(f"SELECT row, col, {R('greatest(-1, least(1, (a - b) / greatest(a + b, 0.0001)))')} AS nd, {R('CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END')} AS entropy, {R('100 * (a - b) / nullif(b, 0)')} AS percent, {R('1 / (1 + exp(-greatest(-50, least(50, a / 20 - 3))))')} AS sigmoid, {R('ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))')} AS logit FROM (SELECT row, col, max(value) FILTER (WHERE year = 2001) AS a, max(value) FILTER (WHERE year = 1995) AS b FROM lights GROUP BY 1, 2) x JOIN (SELECT row, col, frac AS p FROM built WHERE year = 2001) y USING (row, col)")
def spectral_algebra(spark, d):
    x = C.two_epochs(v.lights(spark, d), "value", 1995, 2001).join(v.built(spark, d).where("year = 2001").drop("year"), ["row", "col"])
    a, b, p = F.col("v1"), F.col("v0"), F.col("frac")
    return x.select("row", "col", X.normalised_difference(a, b).alias("nd"), X.entropy_bits(p).alias("entropy"), X.percent_difference(a, b).alias("percent"), X.sigmoid(a / 20 - 3).alias("sigmoid"), X.logit(p).alias("logit"))


@query(f"WITH {CHG}, b AS (SELECT DISTINCT (row // 8) * 7 + col // 8 AS block FROM chg WHERE NOT was) SELECT block, (ntile(5) OVER (ORDER BY (block * 7919 + 104729) % 10007, block))::BIGINT AS fold FROM b")
def spatial_folds(spark, d):
    """Five folds of the blocks that have cells which are not yet urban."""
    return Z.folds(chg(spark, d).where("NOT was_urban").select(Z.block_id(8, 7).alias("block")))


_ZONES_SQL = f"""WITH RECURSIVE {{views}}, {PAIR}, m AS (SELECT row, col, row * 50 + col AS id, v1 FROM pair WHERE v1 >= 0.55),
reach AS (SELECT id, id AS lab, row, col FROM m UNION SELECT b.id, r.lab, b.row, b.col FROM reach r JOIN m b ON abs(b.row - r.row) <= 1 AND abs(b.col - r.col) <= 1),
lab AS (SELECT id, min(lab) AS label FROM reach GROUP BY id),
g AS (SELECT label, count(*) AS n_cells, avg(row) AS centroid_row, avg(col) AS centroid_col, avg(v1) AS mean_score FROM lab JOIN m USING (id) GROUP BY label)
SELECT row_number() OVER (ORDER BY n_cells DESC, mean_score DESC, label) AS zone_id, label, n_cells, {R('n_cells')} AS km2, {R('centroid_row')} AS centroid_row, {R('centroid_col')} AS centroid_col, {R('mean_score')} AS mean_score FROM g WHERE n_cells >= 2"""


@query(_ZONES_SQL.format(views=v.SQL.strip()[5:]), with_views=False)
def ghost_zones(spark, d):
    """Connected zones of at least two cells."""
    cells = pair(spark, d).where("v1 >= 0.55")
    return Z.zone_stats(Z.label_zones(cells, N), cells, "v1", 2)


@query("SELECT row, col, v0 >= 0.5 OR v1 >= 0.5 AS either, v0 >= 0.5 AND v1 >= 0.5 AS both, v1 >= 0.5 AND NOT v0 >= 0.5 AS only_new FROM pair".join([f"WITH {PAIR} ", ""]))
def mask_algebra(spark, d):
    a, b = F.col("v0") >= 0.5, F.col("v1") >= 0.5
    return pair(spark, d).select("row", "col", (a | b).alias("either"), (a & b).alias("both"), (b & ~a).alias("only_new"))
