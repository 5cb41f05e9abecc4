"""Queries that hold the layers against other data: hold-out in time, census, economy, other maps, other projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import change as C
from ..operators import layers as L
from ..operators import scoring as K
from ..operators import stencil as S
from ..operators import tiles as Q
from ..operators import trend as T
from ..operators.order import median
from ..operators.reduce import block
from ..operators.storage import cut
from ..sources import views as v
from .grid import CHG, NDVI, _gauss_sql, chg, lights_in, ndvi
from .layers import _NEW, _OLD, SUHI, intensity, polygons, scenes
from .registry import R, query
from .trends import ACT, LT, MW, REL, RULE_SQL, TYPO, _trend_sql, mw_sql, t_sql, typed, types, types_by_rule

N = v.ROWS

# Classes by what was known in 1998, against the years after it.
_KNOWN = TYPO.replace(ACT, ACT.replace("(SELECT * FROM lights WHERE year = 2001) l", "(SELECT row, col, avg(value) AS value FROM lights WHERE year BETWEEN 1996 AND 1998 GROUP BY 1, 2) l")).replace(LT, _trend_sql("lt", "(SELECT * FROM lights WHERE year <= 1998)", 2))
_CITY = REL.replace("year = 2001 AND frac >= 0.45", "year = 1997 AND frac >= 0.3").replace(_trend_sql("rt", "rel"), _trend_sql("rt", "(SELECT * FROM rel WHERE year <= 1998)", 2))


@query(f"""WITH {_KNOWN}, {_CITY}, {RULE_SQL}, oc AS (SELECT row, col, round(avg(value) FILTER (WHERE year >= 1999) - avg(value) FILTER (WHERE year BETWEEN 1996 AND 1998), 9) AS v FROM rel GROUP BY 1, 2),
hc AS (SELECT rule, row, col, type = 2 AS o, v FROM rc JOIN oc USING (row, col) WHERE type IN (2, 5)),
x AS (SELECT rule, 'cells' AS unit, o, v FROM hc UNION ALL SELECT rule, 'blocks', o, round(avg(v), 9) FROM hc GROUP BY rule, o, row // 5, col // 5), {mw_sql('x', 'rule, unit')} SELECT rule, unit, {MW} FROM mz""")
def typology_holdout(spark, d):
    """Whether land that was filling up by 1998 gained more light afterwards, relative to the city of 1997, than ghost growth: by rule, for cells and for blocks, with p."""
    level = v.lights(spark, d).where("year BETWEEN 1996 AND 1998").groupBy("row", "col").agg(F.avg("value").alias("l"))
    city = v.built(spark, d).where("year = 1997 AND frac >= 0.3").select("row", "col")
    series = cut(T.relative_series(v.lights(spark, d), city))
    classes = types_by_rule(typed(spark, d, level, 1998), T.trend(series.where("year <= 1998"))).where("type IN (2, 5)")
    mean = lambda a, b: F.avg(F.when(F.col("year").between(a, b), F.col("value")))
    later = series.groupBy("row", "col").agg(F.round(mean(1999, 2001) - mean(1996, 1998), 9).alias("v"))
    x = cut(classes.join(later, ["row", "col"]).select("rule", "row", "col", (F.col("type") == 2).alias("o"), "v"))
    blocks = x.groupBy("rule", "o", block("row", 5).alias("r"), block("col", 5).alias("c")).agg(F.round(F.avg("v"), 9).alias("v"))
    both = x.select("rule", F.lit("cells").alias("unit"), "o", "v").unionByName(blocks.select("rule", F.lit("blocks").alias("unit"), "o", "v"))
    return K.mann_whitney(both, "v", F.col("o"), ("rule", "unit"))


def _clip_sql() -> str:
    """SQL: polygons cut to cells by one half-plane after the other, then the area by the corners."""
    steps = ["""vert AS (SELECT n_nationkey AS poly, k, (n_nationkey * 7) % 42 + dx AS x, (n_nationkey * 11) % 40 + dy AS y FROM nation, (VALUES (0, 0.0, 0.0), (1, 8.0, 1.5), (2, 4.2, 3.1), (3, 7.3, 9.0), (4, 0.7, 6.1)) t(k, dx, dy)),
bb AS (SELECT poly, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vert GROUP BY 1),
c0 AS (SELECT poly, row, col, k, x::DOUBLE AS x, y::DOUBLE AS y FROM bb JOIN cells ON col + 1 > x0 AND col < x1 AND row + 1 > y0 AND row < y1 JOIN vert USING (poly))"""]
    for i, side in enumerate(("x - col", "col + 1 - x", "y - row", "row + 1 - y")):
        far = side.replace("x", "nx").replace("y", "ny")
        steps.append(f"""d{i} AS (SELECT *, {side} AS s, {far} AS t FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM c{i} WINDOW w AS (PARTITION BY poly, row, col ORDER BY k))),
c{i + 1} AS (SELECT poly, row, col, 2 * k AS k, x, y FROM d{i} WHERE s >= 0 UNION ALL SELECT poly, row, col, 2 * k + 1, x + (nx - x) * s / (s - t), y + (ny - y) * s / (s - t) FROM d{i} WHERE (s >= 0) <> (t >= 0))""")
    steps.append("""e4 AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM c4 WINDOW w AS (PARTITION BY poly, row, col ORDER BY k)),
shares AS (SELECT poly, row, col, abs(sum((x - col) * (ny - row) - (nx - col) * (y - row))) / 2 AS share FROM e4 GROUP BY 1, 2, 3 HAVING share > 1e-9)""")
    return ",\n".join(steps)


CLIP = _clip_sql()


def shares(spark, d):
    return Q.cell_shares(polygons(spark, d), N, N)


@query(f"WITH {CLIP} SELECT poly, row, col, {R('share')} AS share FROM shares")
def cell_shares(spark, d):
    """The share of each cell that is inside a polygon."""
    return shares(spark, d)


CENSUS = f"""{CLIP}, zone AS (SELECT poly, sum(share * people) FILTER (WHERE year = 2001) AS a1, sum(share * people) FILTER (WHERE year = 1997) AS a0, sum(share * price) FILTER (WHERE year = 2001) AS b1, sum(share * price) FILTER (WHERE year = 1997) AS b0
FROM shares JOIN (SELECT row, col, year, n AS people, price FROM cum) USING (row, col) GROUP BY 1),
cs AS (SELECT c_nationkey AS poly, count(*) FILTER (WHERE year(o_orderdate) <= 2001) AS c1, count(*) FILTER (WHERE year(o_orderdate) <= 1997) AS c0 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
tt AS (SELECT (SELECT sum(c1) FROM cs) AS c, sum(n) AS a, sum(price) AS b FROM cum WHERE year = 2001),
ct AS (SELECT poly, c0, c1, a0 * c / a AS a0, a1 * c / a AS a1, b0 * c / b AS b0, b1 * c / b AS b1 FROM zone JOIN cs USING (poly), tt)"""


def census(spark, d):
    """(poly, c0, c1, a0, a1, b0, b1): records of a nation's customers up to 1997 and 2001, and what two layers put there, each spread over all records of 2001 in all."""
    layer = v.cumulative(spark, d).where("year IN (1997, 2001)")
    at = lambda c, y: F.sum(F.when(F.col("year") == y, F.col("share") * F.col(c)))
    zone = shares(spark, d).join(layer, ["row", "col"]).groupBy("poly").agg(at("n", 1997).alias("a0"), at("n", 2001).alias("a1"), at("price", 1997).alias("b0"), at("price", 2001).alias("b1"))
    o = v.table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.year("o_orderdate") <= 1997).alias("c0"), F.count_if(F.year("o_orderdate") <= 2001).alias("c1"))
    by = o.join(v.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("poly")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    by = cut(by)
    total = layer.where("year = 2001").agg(F.sum("n").alias("a"), F.sum("price").alias("b")).join(by.agg(F.sum("c1").alias("c")))
    x = zone.join(by, "poly").join(F.broadcast(total))
    return x.select("poly", "c0", "c1", *[(F.col(f"{k}{y}") * F.col("c") / F.col(k)).alias(f"{k}{y}") for k in "ab" for y in (0, 1)])


@query(f"WITH {CENSUS} SELECT poly, c1 AS census, {R('a1')} AS counted, {R('b1')} AS valued, {R('100 * (a1 - c1) / nullif(c1, 0)')} AS counted_error, {R('100 * (b1 - c1) / nullif(c1, 0)')} AS valued_error FROM ct")
def population_by_district(spark, d):
    """A census by nation, and two layers' area-weighted sums over the nation's polygon, with their errors in percent."""
    c = F.col("c1")
    error = lambda k: X.percent_difference(F.col(k), c)
    return census(spark, d).select("poly", c.alias("census"), F.col("a1").alias("counted"), F.col("b1").alias("valued"), error("a1").alias("counted_error"), error("b1").alias("valued_error"))


@query(f"""WITH {CENSUS}, l AS (SELECT 'counted' AS layer, c0, c1, a0 AS e0, a1 AS e1 FROM ct UNION ALL SELECT 'valued', c0, c1, b0, b1 FROM ct),
g AS (SELECT layer, count(*) FILTER (WHERE c1 > 0 AND e1 > 0) AS k, regr_slope(ln(e1), ln(c1)) FILTER (WHERE c1 > 0 AND e1 > 0) AS s, regr_r2(ln(e1), ln(c1)) FILTER (WHERE c1 > 0 AND e1 > 0) AS r2, var_pop(ln(e1)) FILTER (WHERE c1 > 0 AND e1 > 0) / var_pop(ln(c1)) FILTER (WHERE c1 > 0 AND e1 > 0) AS ratio FROM l GROUP BY 1),
p AS (SELECT *, s / sqrt((1 - r2) * ratio / (k - 2)) AS t FROM g)
SELECT layer, count(*) AS n, {R('median(100 * (e1 - c1) / c1)')} AS median_error, {R('avg(abs(100 * (e1 - c1) / c1))')} AS mean_absolute_error, count(*) FILTER (WHERE abs(100 * (e1 - c1) / c1) <= 10) AS within10, {R('100 * (sum(e1) - sum(c1)) / sum(c1)')} AS total_error,
{R('100 * (sum(c1) - sum(c0)) / sum(c0)')} AS census_growth, {R('100 * (sum(e1) - sum(e0)) / sum(e0)')} AS layer_growth, {R('any_value(p.s)')} AS elasticity, {R('any_value(p.r2)')} AS r2, {R(f"any_value({t_sql('t', '(k - 2)')})")} AS p FROM l JOIN p USING (layer) GROUP BY layer""")
def population_validation(spark, d):
    """Two layers against the census: errors over all nations, growth since 1997, and the fit of logarithms."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), F.col(f"{k}0").alias("e0"), F.col(f"{k}1").alias("e1")) for name, k in (("counted", "a"), ("valued", "b"))]))
    x = cut(census(spark, d).select("c0", "c1", rows.alias("l")).select("l.*", "c0", "c1").withColumn("error", X.percent_difference(F.col("e1"), F.col("c1"))))
    g = x.groupBy("layer").agg(
        F.count("*").alias("n"), F.avg(F.abs("error")).alias("mean_absolute_error"), F.count_if(F.abs("error") <= 10).alias("within10"), X.percent_difference(F.sum("e1"), F.sum("c1")).alias("total_error"),
        X.percent_difference(F.sum("c1"), F.sum("c0")).alias("census_growth"), X.percent_difference(F.sum("e1"), F.sum("e0")).alias("layer_growth"),
    )
    fit = K.loglog(x, "c1", "e1", ("layer",)).select("layer", "elasticity", "r2", "p")
    return g.join(median(x, F.col("error"), "median_error", ["layer"]), "layer").join(fit, "layer")


ECONOMY = f"""{CLIP}, bl AS (SELECT 'block' AS level, (row // 5) * 10 + col // 5 AS unit, sum(value) FILTER (WHERE year = 1997) AS l0, sum(value) FILTER (WHERE year = 2001) AS l1, sum(price) FILTER (WHERE year = 1997) AS o0, sum(price) FILTER (WHERE year = 2001) AS o1, (sum(n) FILTER (WHERE year = 2001))::DOUBLE AS jobs
FROM lights JOIN cum USING (row, col, year) GROUP BY 2),
zl AS (SELECT poly, sum(share * value) FILTER (WHERE year = 1997) AS l0, sum(share * value) FILTER (WHERE year = 2001) AS l1 FROM shares JOIN lights USING (row, col) GROUP BY 1),
ac AS (SELECT c_nationkey AS poly, sum(o_totalprice) FILTER (WHERE year(o_orderdate) <= 1997) AS o0, sum(o_totalprice) FILTER (WHERE year(o_orderdate) <= 2001) AS o1, count(*)::DOUBLE AS jobs FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) <= 2001 GROUP BY 1),
na AS (SELECT 'nation' AS level, poly AS unit, l0, l1, o0, o1, jobs, n_regionkey FROM zl JOIN ac USING (poly) JOIN nation ON n_nationkey = poly),
un AS (SELECT * FROM bl UNION ALL SELECT level, unit, l0, l1, o0, o1, jobs FROM na UNION ALL SELECT 'region', n_regionkey, sum(l0), sum(l1), sum(o0), sum(o1), sum(jobs) FROM na GROUP BY n_regionkey),
me AS (SELECT level, unnest([{{'measure': 'lights_output', 'x': l1, 'y': o1}}, {{'measure': 'lights_jobs', 'x': l1, 'y': jobs}}, {{'measure': 'jobs_output', 'x': jobs, 'y': o1}},
  {{'measure': 'per_job', 'x': CASE WHEN jobs >= 5 THEN l1 / jobs END, 'y': CASE WHEN jobs >= 5 THEN o1 / jobs END}}, {{'measure': 'growth', 'x': l1 / nullif(l0, 0), 'y': o1 / nullif(o0, 0)}}], recursive := true) FROM un)"""


def units(spark, d):
    """(level, unit, l0, l1, o0, o1, jobs): light and output in 1997 and 2001 and jobs, of blocks, nations and regions."""
    at = lambda c, y: F.sum(F.when(F.col("year") == y, c))
    cells = v.lights(spark, d).join(v.cumulative(spark, d), ["row", "col", "year"])
    b = cells.groupBy((block("row", 5) * 10 + block("col", 5)).alias("unit")).agg(
        *[at(F.col(c), y).alias(k) for k, c, y in (("l0", "value", 1997), ("l1", "value", 2001), ("o0", "price", 1997), ("o1", "price", 2001))], at(F.col("n"), 2001).cast("double").alias("jobs")
    )
    light = F.col("share") * F.col("value")
    zone = shares(spark, d).join(v.lights(spark, d), ["row", "col"]).groupBy("poly").agg(at(light, 1997).alias("l0"), at(light, 2001).alias("l1"))
    o = v.table(spark, d, "orders").where(F.year("o_orderdate") <= 2001).groupBy("o_custkey").agg(F.sum(F.when(F.year("o_orderdate") <= 1997, F.col("o_totalprice"))).alias("o0"), F.sum("o_totalprice").alias("o1"), F.count("*").alias("jobs"))
    o = o.join(v.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("poly")).agg(F.sum("o0").alias("o0"), F.sum("o1").alias("o1"), F.sum("jobs").cast("double").alias("jobs"))
    n = cut(zone.join(o, "poly").join(v.table(spark, d, "nation"), F.col("n_nationkey") == F.col("poly")).select(F.col("poly").cast("long").alias("unit"), "l0", "l1", "o0", "o1", "jobs", "n_regionkey"))
    r = n.groupBy(F.col("n_regionkey").cast("long").alias("unit")).agg(*[F.sum(c).alias(c) for c in ("l0", "l1", "o0", "o1", "jobs")])
    return L.stacked({"block": b, "nation": n, "region": r}, "level")


@query(f"""WITH {ECONOMY}, rk AS (SELECT *, rank() OVER (PARTITION BY level, measure ORDER BY x) + (count(*) OVER (PARTITION BY level, measure, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY level, measure ORDER BY y) + (count(*) OVER (PARTITION BY level, measure, y) - 1) / 2.0::DOUBLE AS ry FROM me WHERE x IS NOT NULL AND y IS NOT NULL),
sp AS (SELECT level, measure, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM rk GROUP BY 1, 2),
lg AS (SELECT level, measure, count(*) AS k, regr_slope(ln(y), ln(x)) AS s, regr_intercept(ln(y), ln(x)) AS i, regr_r2(ln(y), ln(x)) AS r2, sqrt((1 - regr_r2(ln(y), ln(x))) * var_pop(ln(y)) / var_pop(ln(x)) / greatest(count(*) - 2, 1)) AS se FROM me WHERE x > 0 AND y > 0 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT level, measure, n, {R('rho')} AS rho, CASE WHEN (1 - rho) * (1 + rho) < 1e-12 THEN 0 ELSE {R(t_sql('rho * sqrt((n - 2) / ((1 - rho) * (1 + rho)))', '(n - 2)'))} END AS rho_p, k AS n_log, {R('s')} AS elasticity, {R('i')} AS intercept, {R('r2')} AS r2, {R('se')} AS stderr, {R(t_sql('s / se', '(k - 2)'))} AS p FROM sp LEFT JOIN lg USING (level, measure)""")
def economy_proxy(spark, d):
    """Light as a proxy of the economy: rank correlation and elasticity of five measures on three levels, all from one grouping by level and measure."""
    per = lambda c: F.when(F.col("jobs") >= 5, F.col(c) / F.col("jobs"))
    measures = {
        "lights_output": (F.col("l1"), F.col("o1")), "lights_jobs": (F.col("l1"), F.col("jobs")), "jobs_output": (F.col("jobs"), F.col("o1")), "per_job": (per("l1"), per("o1")),
        "growth": (F.try_divide("l1", "l0"), F.try_divide("o1", "o0")),
    }
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), x.alias("x"), y.alias("y")) for m, (x, y) in measures.items()]))
    x = cut(units(spark, d).select("level", long.alias("m")).select("level", "m.*"))
    by = ("level", "measure")
    rank, fit = K.spearman(x, "x", "y", by), K.loglog(x, "x", "y", by).where("n >= 3").withColumnRenamed("n", "n_log")
    return rank.join(fit, list(by), "left").select(*by, "n", "rho", K.correlation_p(F.col("rho"), F.col("n")).alias("rho_p"), "n_log", "elasticity", "intercept", "r2", "stderr", "p")


_OTHER = ("people", "light", "pois", "terrain")


@query(f"""WITH m AS (SELECT b.row, b.col, b.frac, p.people, l.value AS light, coalesce(k.n, 0)::DOUBLE AS pois, s.score AS terrain FROM (SELECT * FROM built WHERE year = 2001) b JOIN (SELECT * FROM population WHERE year = 2001) p USING (row, col)
JOIN (SELECT * FROM lights WHERE year = 2001) l USING (row, col) JOIN surface s USING (row, col) LEFT JOIN (SELECT row, col, count(*) AS n FROM poi GROUP BY 1, 2) k USING (row, col)),
a AS (SELECT count(*) AS n FROM m WHERE frac >= 0.3), q AS (SELECT {', '.join(f"list({c} ORDER BY {c} DESC) AS {c}" for c in _OTHER)} FROM m),
f AS (SELECT frac >= 0.3 AS built, {', '.join(f"m.{c} >= q.{c}[a.n] AS {c}" for c in _OTHER)} FROM m, q, a),
pr AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM f" for i, a in enumerate(('built', *_OTHER)) for b in ('built', *_OTHER)[i + 1:])}),
g AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE x AND y) AS n_both, count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE y AND NOT x) AS only_b, avg((x = y)::INT) AS po, avg(x::INT) * avg(y::INT) + (1 - avg(x::INT)) * (1 - avg(y::INT)) AS pe FROM pr GROUP BY 1, 2)
SELECT a, b, n, n_both AS both, only_a, only_b, {R('po')} AS overall, {R('(po - pe) / nullif(1 - pe, 0)')} AS kappa FROM g""")
def agreement_at_equal_area(spark, d):
    """Five maps of the city, each cut where it has the area of the built map: agreement and kappa of each pair."""
    m = v.built(spark, d).where("year = 2001").select("row", "col", "frac").join(v.population(spark, d).where("year = 2001").drop("year"), ["row", "col"])
    m = m.join(v.lights(spark, d).where("year = 2001").select("row", "col", F.col("value").alias("light")), ["row", "col"]).join(v.surface(spark, d).withColumnRenamed("score", "terrain"), ["row", "col"])
    m = cut(m.join(v.poi(spark, d).groupBy("row", "col").agg(F.count("*").cast("double").alias("pois")), ["row", "col"], "left").na.fill({"pois": 0.0}))
    long = m.select("row", "col", F.explode(F.array(*[F.struct(F.lit(c).alias("map"), F.col(c).alias("value")) for c in _OTHER])).alias("m")).select("m.*")
    limits = K.at_area(long, "value", m.agg(F.count_if(F.col("frac") >= 0.3).alias("n")), ("map",))
    limits = limits.agg(*[F.max(F.when(F.col("map") == c, F.col("least"))).alias(f"_{c}") for c in _OTHER])
    flags = m.join(F.broadcast(limits)).select((F.col("frac") >= 0.3).alias("built"), *[F.coalesce(F.col(c) >= F.col(f"_{c}"), F.lit(False)).alias(c) for c in _OTHER])
    return K.agreement_matrix(flags, ["built", *_OTHER])


@query(f"""WITH {TYPO}, {SUHI.replace(CHG + ', ', '', 1)}, {NDVI} SELECT type::BIGINT AS type, count(*) AS n, {R('avg(b.i)')} AS intensity, {R('avg(b.i - a.i)')} AS intensity_change, {R('avg(nd.v1)')} AS green, {R('avg((nd.v0 >= 0.6 AND nd.v1 - nd.v0 <= -0.3)::INT)')} AS green_lost,
{R('avg(p.people)')} AS people, {R('avg((p.people >= 3)::INT)')} AS peopled FROM tc JOIN su a ON a.row = tc.row AND a.col = tc.col AND a.year = 1997 JOIN su b ON b.row = tc.row AND b.col = tc.col AND b.year = 2001 JOIN nd ON nd.row = tc.row AND nd.col = tc.col JOIN population p ON p.row = tc.row AND p.col = tc.col AND p.year = 2001 GROUP BY 1""")
def class_cross_checks(spark, d):
    """What other layers say of the typology's classes: heat and its change, green and green lost, people."""
    key = ["row", "col"]
    x = types(spark, d).select(*key, "type").join(intensity(spark, d, 1997).drop("f1"), key).join(intensity(spark, d, 2001).drop("f1"), key)
    x = x.join(C.green_change(ndvi(spark, d), 0.6, 0.3).select(*key, "v1", "lost"), key).join(v.population(spark, d).where("year = 2001").drop("year"), key)
    share = lambda c: F.avg(c.cast("int"))
    return x.groupBy("type").agg(
        F.count("*").alias("n"), F.avg("i2001").alias("intensity"), F.avg(F.col("i2001") - F.col("i1997")).alias("intensity_change"), F.avg("v1").alias("green"), share(F.col("lost")).alias("green_lost"),
        F.avg("people").alias("people"), share(F.col("people") >= 3).alias("peopled"),
    )


def _stack_sql() -> str:
    scene = ", ".join(f"CASE WHEN year(l_shipdate) <= 1998 THEN {n} ELSE {o} END AS {b}" for n, o, b in zip(_NEW, _OLD, L.BANDS, strict=True))
    mean = ", ".join(f"avg({b}) FILTER (WHERE now) AS {b}_t, avg({b}) FILTER (WHERE NOT now) AS {b}_prev" for b in L.BANDS)
    nd = lambda a, b, e: f"CASE WHEN {a}_{e} IS NOT NULL THEN greatest(-1, least(1, ({a}_{e} - {b}_{e}) / greatest({a}_{e} + {b}_{e}, 1e-4))) END"
    index = lambda e: ", ".join([f"{nd('nir', 'red', e)} AS ndvi_{e}", f"{nd('swir1', 'nir', e)} AS ndbi_{e}", f"{nd('green', 'nir', e)} AS ndwi_{e}", f"({' + '.join(f'{b}_{e}' for b in L.BANDS)}) / 6 AS brightness_{e}"])
    names = [*L.BANDS, "ndvi", "ndbi", "ndwi", "brightness"]
    cols = [f"{R(f'{n}_{e}')} AS {n}_{e}" for e in ("t", "prev") for n in names] + [f"{R(f'{n}_t - {n}_prev')} AS {n}_change" for n in names]
    return f"""WITH s AS (SELECT (l_partkey % 50 + l_partkey * 37 // 11 % 50) // 2 AS row, (l_orderkey % 50 + l_orderkey * 37 // 11 % 50) // 2 AS col, year(l_shipdate) >= 1999 AS now, {scene} FROM lineitem WHERE (l_partkey & 30) = 0 AND (l_suppkey & 3072) = 0),
m AS (SELECT row, col, {mean} FROM s GROUP BY 1, 2), i AS (SELECT *, {index('t')}, {index('prev')} FROM m) SELECT row, col, {', '.join(cols)} FROM i"""


@query(_stack_sql(), with_views=False)
def channel_stack(spark, d):
    """Thirty channels of a cell: six bands and four indices now, before, and their differences."""
    s = scenes(spark, d)
    return L.channel_stack(s.select(v.place("l_partkey").alias("row"), v.place("l_orderkey").alias("col"), "part", *L.BANDS), F.col("part") == "new")


_S2 = _gauss_sql("s", "there", 1.5)
for _old, _to in (("gw", "hw"), ("g1", "h1"), ("g2", "h2")):
    _S2 = _S2.replace(_old, _to)


@query(f"WITH s AS (SELECT row, col, nullif(value, 0) AS value, (value <> 0)::INT::DOUBLE AS there FROM lights WHERE year = 1995), {_gauss_sql('s', 'value', 1.5)}, {_S2} SELECT row, col, CASE WHEN h2.smooth > 1e-6 THEN {R('g2.smooth / h2.smooth')} END AS smooth FROM g2 JOIN h2 USING (row, col)")
def gaussian_ignoring_nulls(spark, d):
    """Light, where there is any, smoothed without counting the dark as 0."""
    return S.gaussian_ignoring_nulls(lights_in(spark, d, 1995), "v", 1.5, N, N)


# The series' coefficients for the ellipsoid, and its mean meridian radius.
_ALPHA = (8.377318206244698e-4, 7.608527773572307e-7, 1.197645503329453e-9, 2.429170607201359e-12)
_BETA = (8.377321640579488e-4, 5.905870152220203e-8, 1.673482665283997e-10, 2.164798040063e-13)
_RADIUS, _ECC = 6367449.145823415, 0.0818191908426215


def _utm_sql() -> str:
    sum_ = lambda cs, f, g, a, b, sign: " ".join(f"{sign} {c!r} * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, c in enumerate(cs, 1))
    return f"""WITH e AS (SELECT event_id, (user_id % 6 + 75.0::DOUBLE) + (event_id % 100) / 100.0::DOUBLE AS lon, (event_id % 60 - 30) * 1.0::DOUBLE + 0.25 AS lat FROM events),
z AS (SELECT *, floor((lon + 180) / 6)::BIGINT + 1 AS zone, lat < 0 AS south FROM e),
c AS (SELECT *, radians(lon - (zone * 6 - 183)) AS l, tan(2 * atan(tan(pi() / 4 + radians(lat) / 2) * pow((1 - {_ECC!r} * sin(radians(lat))) / (1 + {_ECC!r} * sin(radians(lat))), {_ECC!r} / 2)) - pi() / 2) AS t FROM z),
p AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM c),
f AS (SELECT *, 500000 + 0.9996::DOUBLE * {_RADIUS!r} * (eta {sum_(_ALPHA, 'cos', 'sinh', 'xi', 'eta', '+')}) AS east, 0.9996::DOUBLE * {_RADIUS!r} * (xi {sum_(_ALPHA, 'sin', 'cosh', 'xi', 'eta', '+')}) + CASE WHEN south THEN 10000000 ELSE 0 END AS north FROM p)
SELECT event_id, zone, round(east, 3) + 0 AS east, round(north, 3) + 0 AS north, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS returns FROM f"""


@query(_utm_sql(), with_views=False)
def transverse_mercator(spark, d):
    """Longitude and latitude in their zone of the transverse Mercator grid, in metres to the millimetre, and back; whether the way back ends within a millimetre."""
    e = v.table(spark, d, "events").select("event_id", (F.col("user_id") % 6 + 75.0 + (F.col("event_id") % 100) / F.lit(100.0)).alias("lon0"), ((F.col("event_id") % 60 - 30) * 1.0 + 0.25).alias("lat0"))
    e = e.withColumns({"zone": F.floor((F.col("lon0") + 180) / 6) + 1, "south": F.col("lat0") < 0})
    east, north = X.utm(F.col("lon0"), F.col("lat0"), F.col("zone"), F.col("south"))
    e = e.withColumns({"east": east, "north": north})
    lon, lat = X.utm_back(F.col("east"), F.col("north"), F.col("zone"), F.col("south"))
    e = e.withColumns({"lon": lon, "lat": lat})
    off = X.haversine_km(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0")) * 1e6
    return e.select("event_id", "zone", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), "lon", "lat", (off < 1).alias("returns"))
