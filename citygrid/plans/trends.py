"""Queries of yearly series, activity, typology and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import activity as A
from ..operators import change as C
from ..operators import growth as G
from ..operators import order as O
from ..operators import scoring as K
from ..operators import trend as T
from ..operators import zones as Z
from ..operators.storage import cut
from ..sources import views as v
from .grid import CHG, PAIR, chg, pair
from .registry import R, query

N = v.ROWS

# Student's t for 5 degrees of freedom (seven years): the closed sum of trend()
P5 = "(CASE WHEN 1 - r * r < 1e-12 THEN 0 ELSE greatest(0, 1 - 2 / pi() * (atan(abs(t) / sqrt(5)) + sin(atan(abs(t) / sqrt(5))) * cos(atan(abs(t) / sqrt(5))) * (1 + 2 / 3.0::DOUBLE * cos(atan(abs(t) / sqrt(5))) ** 2))) END)"


#: The same for 2 degrees of freedom (four years).
P2 = "(CASE WHEN 1 - r * r < 1e-12 THEN 0 ELSE greatest(0, 1 - sin(atan(abs(t) / sqrt(2)))) END)"


def t_sql(t: str, df: str, steps: int = 20000) -> str:
    """SQL: the two-sided p of Student's t by the midpoint rule over the angle, both in the tail and whole."""
    start = f"atan(abs({t}) / sqrt({df}))"
    integral = lambda a: f"list_sum(list_transform(range({steps}), lambda at_: cos({a} + (pi() / 2 - {a}) * (at_ + 0.5) / {steps}) ** ({df} - 1))) * (pi() / 2 - {a})"
    return f"({integral(start)} / ({integral('0')}))"


def normal_sql(z: str, steps: int = 20000) -> str:
    """SQL: the tail of the normal distribution beyond z, by the midpoint rule."""
    tail = f"(list_sum(list_transform(range({steps}), lambda at_: exp(-((abs({z}) + 12 * (at_ + 0.5) / {steps}) ** 2) / 2))) * 12 / {steps} / sqrt(2 * pi()))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def _trend_sql(name: str, source: str, df: int = 5) -> str:
    return f"""{name}0 AS (SELECT row, col, count(*) AS n, round(covar_pop(value, year) / var_pop(year), 9) AS slope, avg(value) AS mean, avg(year) AS mx,
CASE WHEN var_pop(value) > 1e-12 THEN greatest(-1, least(1, covar_pop(value, year) / sqrt(var_pop(year) * var_pop(value)))) ELSE 0 END AS r FROM {source} GROUP BY row, col),
{name} AS (SELECT *, {({5: P5, 2: P2})[df]} AS p FROM (SELECT *, r * sqrt({df} / greatest(1 - r * r, 1e-300)) AS t FROM {name}0))"""


LT = _trend_sql("lt", "lights")
REL = "lg AS (SELECT row, col, year, ln(greatest(value, 0) + 1) AS g FROM lights), ref AS (SELECT row, col FROM built WHERE year = 2001 AND frac >= 0.45), base AS (SELECT year, median(g) AS b FROM lg JOIN ref USING (row, col) GROUP BY year), rel AS (SELECT row, col, year, g - b AS value FROM lg JOIN base USING (year)), " + _trend_sql("rt", "rel")


def reference(spark, d):
    return v.built(spark, d).where("year = 2001 AND frac >= 0.45").select("row", "col")


def relative(spark, d):
    return T.relative_series(v.lights(spark, d), reference(spark, d))


@query(f"WITH {LT} SELECT row, col, {R('slope')} AS slope, {R('mean - slope * mx')} AS intercept, {R('r')} AS r, {R('p')} AS p, {R('mean')} AS mean, n FROM lt")
def light_trend(spark, d):
    return T.trend(v.lights(spark, d))


@query(f"WITH {REL} SELECT row, col, {R('slope')} AS slope, {R('r')} AS r, {R('p')} AS p, n FROM rt")
def relative_trend(spark, d):
    return T.trend(relative(spark, d)).select("row", "col", "slope", "r", "p", "n")


@query(f"SELECT row, col, {R('avg(value)')} AS mean FROM lights WHERE year IN (1999, 2000, 2001) GROUP BY 1, 2")
def light_window_mean(spark, d):
    return T.window_mean(v.lights(spark, d), [1999, 2000, 2001])


@query(f"SELECT year, {R('sum(value)')} AS sol, {R('avg((value > 100)::INT)')} AS lit FROM lights GROUP BY year")
def sum_of_lights(spark, d):
    return v.lights(spark, d).groupBy("year").agg(F.sum("value").alias("sol"), F.avg((F.col("value") > 100).cast("int")).alias("lit"))


@query(f"WITH {LT}, {REL} SELECT l.row, l.col, l.slope > 0 AS raw_up, l.slope <= 0 AS raw_down, l.slope > 0 AND l.p < 0.1 AS sig_up, t.slope > 0 AND t.p < 0.1 AS rel_up, t.slope < 0 AND t.p < 0.1 AS rel_down FROM lt l JOIN rt t USING (row, col)")
def rising_masks(spark, d):
    t, r = T.trend(v.lights(spark, d)).select("row", "col", "slope", "p"), T.trend(relative(spark, d)).select("row", "col", F.col("slope").alias("rs"), F.col("p").alias("rp"))
    x = [F.col(c) for c in ("slope", "p", "rs", "rp")]
    raw, sig, rel = T.rising("raw", *x), T.rising("significant", *x), T.rising("relative_significant", *x)
    return t.join(r, ["row", "col"]).select("row", "col", raw[0].alias("raw_up"), raw[1].alias("raw_down"), sig[0].alias("sig_up"), rel[0].alias("rel_up"), rel[1].alias("rel_down"))


@query(f"SELECT row, col, CASE WHEN frac >= 0.1 THEN {R('value / frac')} END AS activity FROM lights JOIN built USING (row, col, year) WHERE year = 2001")
def activity_per_built(spark, d):
    x = v.lights(spark, d).join(v.built(spark, d), ["row", "col", "year"]).where("year = 2001")
    return x.select("row", "col", F.when(F.col("frac") >= 0.1, F.col("value") / F.col("frac")).alias("activity"))


def _rank_sql(e: str) -> str:
    return f"((rank() OVER (ORDER BY {e}) + (count(*) OVER (PARTITION BY {e}) - 1) / 2.0::DOUBLE - 1) / greatest(count(*) OVER () - 1, 1))"


ACT = f"""ai0 AS (SELECT row, col, b.frac, l.value / b.frac AS li, coalesce(p.n, 0) / b.frac AS pi, pp.people / b.frac AS po FROM (SELECT * FROM built WHERE year = 2001 AND frac >= 0.3) b
JOIN (SELECT * FROM lights WHERE year = 2001) l USING (row, col) JOIN (SELECT * FROM population WHERE year = 2001) pp USING (row, col) LEFT JOIN (SELECT row, col, count(*) AS n FROM poi GROUP BY 1, 2) p USING (row, col)),
ai AS (SELECT row, col, frac, 0.45 * {_rank_sql('round(li, 9)')} + 0.35 * {_rank_sql('round(pi, 9)')} + 0.2 * {_rank_sql('round(po, 9)')} AS activity FROM ai0)"""


def activity(spark, d, level=None):
    """The activity index; level(row, col, l): another level of light than that of 2001."""
    b = v.built(spark, d).where("year = 2001 AND frac >= 0.3").select("row", "col", "frac")
    x = b.join(level if level is not None else v.lights(spark, d).where("year = 2001").select("row", "col", F.col("value").alias("l")), ["row", "col"])
    x = x.join(v.population(spark, d).where("year = 2001").select("row", "col", "people"), ["row", "col"])
    x = x.join(v.poi(spark, d).groupBy("row", "col").agg(F.count("*").alias("n")), ["row", "col"], "left")
    x = x.select("row", "col", "frac", F.round(F.col("l") / F.col("frac"), 9).alias("a"), F.round(F.coalesce("n", F.lit(0)) / F.col("frac"), 9).alias("b"), F.round(F.col("people") / F.col("frac"), 9).alias("c"))
    x = cut(x)
    for c, to in (("a", "lights"), ("b", "poi"), ("c", "population")):
        x = A.rank01(x, c, to)
    return x.select("row", "col", "frac", A.weighted_index(x, {"lights": 0.45, "poi": 0.35, "population": 0.2}).alias("activity"))


@query(f"WITH {ACT} SELECT row, col, {R('frac')} AS frac, {R('activity')} AS activity FROM ai")
def activity_index(spark, d):
    return activity(spark, d)


EXP = f"""{ACT}, ed AS (SELECT list_sort(list_distinct(quantile_cont(frac, [{", ".join(repr(i / 20) for i in range(21))}]))) AS e, median(activity) AS al FROM ai),
bi AS (SELECT ai.*, least(len(list_filter(e, lambda z: z <= frac)), len(e) - 1) AS b FROM ai, ed),
mi AS (SELECT avg(frac) AS cx, median(activity) AS cy FROM bi GROUP BY b HAVING count(*) >= 20), mn AS (SELECT *, lead(cx) OVER (ORDER BY cx) AS nx, lead(cy) OVER (ORDER BY cx) AS ny, row_number() OVER (ORDER BY cx) AS i, count(*) OVER () AS n FROM mi),
ex AS (SELECT ai.*, coalesce((SELECT CASE WHEN nx IS NULL THEN cy ELSE cy + (ny - cy) * (ai.frac - cx) / (nx - cx) END FROM mn WHERE n >= 2 AND cx <= ai.frac ORDER BY cx DESC LIMIT 1), (SELECT cy FROM mn WHERE n >= 2 AND i = 1), (SELECT al FROM ed)) AS expected FROM ai)"""


def expected(spark, d, level=None):
    return A.expected_activity(activity(spark, d, level), "frac", "activity")


@query(f"WITH {EXP} SELECT row, col, {R('activity')} AS activity, {R('expected')} AS expected FROM ex")
def expected_activity(spark, d):
    return expected(spark, d).select("row", "col", "activity", "expected")


TYPO = f"""{EXP}, {CHG}, {LT}, rs AS (SELECT *, round(activity - expected, 9) AS resid FROM ex), lo AS (SELECT quantile_cont(resid, 0.25) AS q FROM rs),
ty AS (SELECT c.row, c.col, resid, coalesce(resid <= q + 1e-12 AND resid < 0, false) AS low, c.is_ AS urban, v1 - v0 >= 0.2 AS grown, slope > 0 AS up, slope <= 0 AS down, q, v1 - v0 AS delta FROM chg c LEFT JOIN rs USING (row, col) JOIN lt USING (row, col), lo),
tc AS (SELECT *, CASE WHEN urban AND grown AND low AND NOT up THEN 5 WHEN urban AND low AND down AND NOT grown THEN 4 WHEN urban AND grown AND NOT low THEN 3 WHEN urban AND grown AND low AND up THEN 2 WHEN urban THEN 1 ELSE 0 END AS type FROM ty)"""


def typed(spark, d, level=None, until=2001):
    """Cells with what the typology asks of them; with a level of light and a last year of its own, what was known by then."""
    r = expected(spark, d, level).select("row", "col", F.round(F.col("activity") - F.col("expected"), 9).alias("resid"))
    r = cut(r)
    q = O.percentiles(r, F.col("resid"), [0.25]).select(F.col("q")[0].alias("q"))
    x = chg(spark, d).join(r, ["row", "col"], "left").join(T.trend(v.lights(spark, d).where(F.col("year") <= until)).select("row", "col", "slope", "p"), ["row", "col"]).join(F.broadcast(q))
    return x.withColumn("low", F.coalesce((F.col("resid") <= F.col("q") + 1e-12) & (F.col("resid") < 0), F.lit(False)))


def types(spark, d):
    x = typed(spark, d)
    return x.withColumn("type", A.typology(x, F.col("is_urban"), F.col("delta") >= 0.2, F.col("low"), F.col("slope") > 0, F.col("slope") <= 0))


@query(f"WITH {TYPO} SELECT row, col, type::BIGINT AS type, {R('resid')} AS resid FROM tc")
def ghost_typology(spark, d):
    return types(spark, d).select("row", "col", "type", "resid")


@query(f"WITH {TYPO} SELECT t.k AS type, count(tc.type) AS n, {R('count(tc.type) / (SELECT count(*) FROM tc)')} AS share FROM range(6) t(k) LEFT JOIN tc ON tc.type = t.k GROUP BY 1")
def typology_counts(spark, d):
    return A.type_counts(types(spark, d), "type")


@query(f"WITH {TYPO}, p AS (SELECT quantile_cont(greatest(-resid, 0), 0.95) AS p95 FROM tc WHERE resid IS NOT NULL) SELECT row, col, {R('least(1, greatest(-resid, 0) / nullif(p95, 0)) * least(1, greatest(delta, 0) / 0.5)')} AS score FROM tc, p WHERE resid IS NOT NULL")
def ghost_score(spark, d):
    x = types(spark, d).where("resid IS NOT NULL").withColumn("deficit", F.greatest(-F.col("resid"), F.lit(0.0)))
    x = C.over_percentile(x, F.col("deficit"), "s", 0.95)
    return x.select("row", "col", (F.col("s") * F.least(F.lit(1.0), F.greatest("delta", F.lit(0.0)) / 0.5)).alias("score"))


RULE_SQL = """rl AS (SELECT unnest(['raw', 'significant', 'relative', 'relative_significant']) AS rule),
rr AS (SELECT rl.rule, y.*, CASE rl.rule WHEN 'raw' THEN l.slope > 0 WHEN 'significant' THEN l.slope > 0 AND l.p < 0.1 WHEN 'relative' THEN t.slope > 0 ELSE t.slope > 0 AND t.p < 0.1 END AS rup,
CASE rl.rule WHEN 'raw' THEN l.slope <= 0 WHEN 'significant' THEN l.slope < 0 AND l.p < 0.1 WHEN 'relative' THEN t.slope < 0 ELSE t.slope < 0 AND t.p < 0.1 END AS rdown
FROM rl CROSS JOIN ty y JOIN lt l USING (row, col) JOIN rt t USING (row, col)),
rc AS (SELECT rule, row, col, CASE WHEN urban AND grown AND low AND NOT rup THEN 5 WHEN urban AND low AND rdown AND NOT grown THEN 4 WHEN urban AND grown AND NOT low THEN 3 WHEN urban AND grown AND low AND rup THEN 2 WHEN urban THEN 1 ELSE 0 END AS type FROM rr)"""


def types_by_rule(x, relative_trend):
    """(rule, row, col, type) of cells as typed() gives them, under each definition of rising."""
    x = x.join(relative_trend.select("row", "col", F.col("slope").alias("rs"), F.col("p").alias("rp")), ["row", "col"])
    c = [F.col(n) for n in ("slope", "p", "rs", "rp")]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), T.rising(n, *c)[0].alias("up"), T.rising(n, *c)[1].alias("down")) for n in T.RULES]))
    x = x.select("row", "col", "is_urban", "delta", "low", rules.alias("r")).select("row", "col", "is_urban", "delta", "low", "r.*")
    return x.withColumn("type", A.typology(x, F.col("is_urban"), F.col("delta") >= 0.2, F.col("low"), F.col("up"), F.col("down"))).select("rule", "row", "col", "type")


@query(f"""WITH {TYPO}, {REL}, {RULE_SQL}
SELECT rl.rule, k.type, count(rc.type) AS n, {R('count(rc.type) / (SELECT count(*) FROM ty)')} AS share FROM rl CROSS JOIN range(6) k(type) LEFT JOIN rc ON rc.rule = rl.rule AND rc.type = k.type GROUP BY 1, 2""")
def rule_sensitivity(spark, d):
    """Areas of the typology's classes under each definition of rising."""
    return A.type_counts(types_by_rule(typed(spark, d), T.trend(relative(spark, d))), "type", "rule", T.RULES)


@query(f"WITH x AS (SELECT row, col, {_rank_sql('value')} AS a FROM lights WHERE year = 2001), y AS (SELECT row, col, {_rank_sql('coalesce(n, 0)')} AS b FROM cells LEFT JOIN (SELECT row, col, count(*) AS n FROM poi GROUP BY 1, 2) USING (row, col)) SELECT row, col, {R('sqrt(a * b)')} AS intensity FROM x JOIN y USING (row, col)")
def commercial_intensity(spark, d):
    from ..operators.vector import density

    x = v.lights(spark, d).where("year = 2001").join(density(v.poi(spark, d), v.grid(spark)), ["row", "col"])
    x = A.rank01(A.rank01(x, "value", "a"), "n", "b")
    return x.select("row", "col", F.sqrt(F.col("a") * F.col("b")).alias("intensity"))


LAG = REL + """, f AS (SELECT row, col, year, value, value - lag(value, 3) OVER w AS growth3, avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS level2,
regr_slope(value, year) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS slope4, lead(value, 2) OVER w - value AS target FROM rel WINDOW w AS (PARTITION BY row, col ORDER BY year))"""


@query(f"WITH {LAG} SELECT row, col, year, {R('growth3')} AS growth3, {R('level2')} AS level2, {R('slope4')} AS slope4, {R('target')} AS target FROM f WHERE year >= 1998")
def lag_features(spark, d):
    w = Window.partitionBy("row", "col").orderBy("year")
    at = lambda k: F.max("value").over(w.rangeBetween(k, k))
    x = relative(spark, d).select("row", "col", "year", (F.col("value") - at(-3)).alias("growth3"), F.avg("value").over(w.rangeBetween(-1, 0)).alias("level2"), F.regr_slope("value", "year").over(w.rangeBetween(-3, 0)).alias("slope4"), (at(2) - F.col("value")).alias("target"))
    return x.where("year >= 1998")


# A prediction to score: new land foreseen where the surface and the earlier fraction are high
PRED = f"{CHG}, pr AS (SELECT row, col, s.score * 0.5 + v0 AS p, new_ AS o, v0, v1, (row // 10) * 5 + col // 10 AS block FROM chg JOIN surface s USING (row, col) WHERE NOT was)"


def scored(spark, d):
    x = chg(spark, d).join(v.surface(spark, d), ["row", "col"]).where("NOT was_urban")
    return x.select("row", "col", (F.col("score") * 0.5 + F.col("f0")).alias("p"), F.col("new_urban").alias("o"), "f0", "f1", Z.block_id(10, 5).alias("block"))


_CONF = f"""count(*) FILTER (WHERE y AND o) AS hits, count(*) FILTER (WHERE NOT y AND o) AS misses, count(*) FILTER (WHERE y AND NOT o) AS false_alarms, count(*) FILTER (WHERE NOT y AND NOT o) AS rejections"""
_DERIVED = f"""hits, misses, false_alarms, rejections, {R('hits / nullif(hits + misses + false_alarms, 0)')} AS fom, {R('hits / nullif(hits + misses, 0)')} AS producer, {R('hits / nullif(hits + false_alarms, 0)')} AS user,
{R('ov')} AS overall, {R('(ov - e) / nullif(1 - e, 0)')} AS kappa, {R('(false_alarms + rejections) / nullif(n, 0)')} AS null_overall"""
_EXPECT = "SELECT *, (hits + rejections) / nullif(n, 0) AS ov, ((hits + misses) * (hits + false_alarms) + (rejections + misses) * (rejections + false_alarms)) / nullif(n::DOUBLE * n, 0) AS e FROM (SELECT *, hits + misses + false_alarms + rejections AS n FROM c)"


@query(f"WITH {PRED}, c AS (SELECT {_CONF} FROM (SELECT p >= 0.55 AS y, o FROM pr)) SELECT {_DERIVED} FROM ({_EXPECT})")
def change_metrics(spark, d):
    return K.confusion(scored(spark, d), F.col("p") >= 0.55, F.col("o"))


@query(f"WITH {PRED}, c AS (SELECT band, {_CONF} FROM (SELECT floor(v0 * 10)::BIGINT AS band, p >= 0.55 AS y, o FROM pr) GROUP BY band) SELECT band, {_DERIVED} FROM ({_EXPECT})")
def error_by_band(spark, d):
    return K.confusion(scored(spark, d).withColumn("band", F.floor(F.col("f0") * 10)), F.col("p") >= 0.55, F.col("o"), "band")


_AUC = "SELECT {0} count(*) FILTER (WHERE o) AS n1, count(*) FILTER (WHERE NOT o) AS n0, sum(r) FILTER (WHERE o) AS s FROM (SELECT *, rank() OVER ({1} ORDER BY p) + (count(*) OVER ({2} p) - 1) / 2.0::DOUBLE AS r FROM pr) {3}"


@query(f"WITH {PRED}, a AS ({_AUC.format('', '', 'PARTITION BY', '')}) SELECT n1, n0, {R('(s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0)')} AS auc FROM a")
def roc_auc(spark, d):
    return K.roc_auc(scored(spark, d), "p", F.col("o"))


@query(f"WITH {PRED}, a AS ({_AUC.format('block,', 'PARTITION BY block', 'PARTITION BY block,', 'GROUP BY block')}) SELECT block, n1, n0, {R('(s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0)')} AS auc FROM a")
def block_auc(spark, d):
    return K.roc_auc(scored(spark, d), "p", F.col("o"), ("block",))


@query(f"WITH {PRED}, s AS (SELECT p, count(*) AS k, sum(o::INT) AS k1 FROM pr GROUP BY p), c AS (SELECT k, k1, sum(k1) OVER w / sum(k) OVER w AS pre FROM s WINDOW w AS (ORDER BY p DESC)), g AS (SELECT sum(k)::BIGINT AS n, sum(k1) AS n1, sum(k1 * pre) AS s FROM c) SELECT n, {R('n1 / n')} AS base, {R('s / nullif(n1, 0)')} AS ap, {R('(s / nullif(n1, 0)) / (n1 / n)')} AS lift FROM g")
def average_precision(spark, d):
    return K.average_precision(scored(spark, d), "p", F.col("o"))


@query(f"WITH {PRED}, r AS (SELECT o, row_number() OVER (ORDER BY p DESC, row, col) AS rn, count(*) OVER () AS n, count(*) FILTER (WHERE o) OVER () AS n1 FROM pr), f AS (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS fraction) SELECT fraction, count(*) AS taken, count(*) FILTER (WHERE o) AS hits, {R('count(*) FILTER (WHERE o) / count(*)')} AS precision, {R('count(*) FILTER (WHERE o) / max(n1)')} AS recall FROM r, f WHERE rn <= greatest(1, round(n * fraction)) GROUP BY fraction")
def precision_at_k(spark, d):
    return K.precision_at(scored(spark, d), [0.01, 0.05, 0.1, 0.2], F.col("o"), "p")


@query(f"WITH {PRED}, e AS (SELECT quantile_cont(p, [{', '.join(repr(i / 10) for i in range(1, 10))}]) AS e FROM pr), b AS (SELECT len(list_filter(e, lambda z: z <= p)) AS bin, p, o::INT AS o FROM pr, e) SELECT bin, count(*) AS n, {R('avg(p)')} AS mean_p, {R('avg(o)')} AS rate, {R('abs(avg(p) - avg(o))')} AS gap FROM b GROUP BY bin")
def calibration(spark, d):
    return K.calibration(scored(spark, d), "p", F.col("o"))


@query(f"WITH {PRED}, b AS (SELECT quantile_cont(p, [{', '.join(repr(i / 10) for i in range(1, 10))}]) AS e FROM pr), c AS (SELECT len(list_filter(e, lambda z: z <= p)) AS bin, count(*) AS n, abs(avg(p) - avg(o::INT)) AS gap FROM pr, b GROUP BY 1) SELECT (SELECT {R('avg((p - o::INT) ** 2)')} FROM pr) AS brier, {R('sum(n * gap) / sum(n)')} AS ece FROM c")
def calibration_error(spark, d):
    x = scored(spark, d)
    ece = K.calibration(x, "p", F.col("o")).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return x.agg(F.avg(F.pow(F.col("p") - F.col("o").cast("int"), F.lit(2.0))).alias("brier")).join(F.broadcast(ece))


@query(f"""WITH {PRED}, r AS (SELECT o, row_number() OVER (ORDER BY p DESC, row, col) AS rn FROM pr), n AS (SELECT count(*) AS n FROM r), m AS (SELECT n, least(200, n) AS m FROM n),
pt AS (SELECT DISTINCT round_even(k * (n - 1)::DOUBLE / greatest(m - 1, 1), 0)::BIGINT + 1 AS flagged FROM m, LATERAL (SELECT unnest(range(m)) AS k))
SELECT flagged, count(*) FILTER (WHERE o) AS hits FROM pt JOIN r ON rn <= flagged GROUP BY 1 UNION ALL SELECT 0, 0""")
def toc_curve(spark, d):
    return K.toc(scored(spark, d), "p", F.col("o"), 200)


@query(f"WITH {PRED} SELECT row, col, {R('p')} AS p FROM pr ORDER BY p DESC, row, col LIMIT 100")
def top_n_allocation(spark, d):
    return K.top_n(scored(spark, d), 100, F.desc("p"), F.col("row"), F.col("col")).select("row", "col", "p")


@query(f"WITH {PAIR}, r AS (SELECT {_rank_sql('v0')} AS a, {_rank_sql('v1')} AS b FROM pair) SELECT count(*) AS n, {R('corr(a, b)')} AS rho FROM r")
def spearman(spark, d):
    return K.spearman(pair(spark, d), "v0", "v1")


@query(f"""WITH x AS (SELECT ln(value) AS ly, ln(people) AS lx FROM lights JOIN population USING (row, col, year) WHERE value > 0 AND people > 0), g AS (SELECT count(*) AS n, regr_slope(ly, lx) AS s, regr_intercept(ly, lx) AS i, regr_r2(ly, lx) AS r2, sqrt((1 - regr_r2(ly, lx)) * var_pop(ly) / var_pop(lx) / (count(*) - 2)) AS se FROM x)
SELECT n, {R('s')} AS elasticity, {R('i')} AS intercept, {R('r2')} AS r2, {R('se')} AS stderr, {R(t_sql('s / se', '(n - 2)'))} AS p FROM g""")
def loglog_elasticity(spark, d):
    return K.loglog(v.lights(spark, d).join(v.population(spark, d), ["row", "col", "year"]), "people", "value")


@query(f"WITH {PAIR} SELECT count(*) AS n, {R('regr_slope(v1, v0)')} AS slope, {R('regr_r2(v1, v0)')} AS r2, {R('avg(v1 - v0)')} AS bias, {R('sqrt(avg((v1 - v0) ** 2))')} AS rmse FROM pair")
def paired_comparison(spark, d):
    return K.paired(pair(spark, d), "v0", "v1")


def mw_sql(source: str, by: str = "") -> str:
    """SQL: n, m, u, effect and p of source(by, v, o)."""
    part, plus = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""mr AS (SELECT {plus}v, o, rank() OVER ({part} ORDER BY v) + (count(*) OVER (PARTITION BY {plus}v) - 1) / 2.0::DOUBLE AS r FROM {source} WHERE v IS NOT NULL),
mt AS (SELECT {plus}sum(t::DOUBLE ** 3 - t) AS ties FROM (SELECT {plus}v, count(*) AS t FROM mr GROUP BY {plus}v) {group}),
mg AS (SELECT {plus}(count(*) FILTER (WHERE o))::DOUBLE AS n, (count(*) FILTER (WHERE NOT o))::DOUBLE AS m, sum(r) FILTER (WHERE o) AS s FROM mr {group}),
mu AS (SELECT mg.*, ties, s - n * (n + 1) / 2 AS u FROM mg {f"JOIN mt USING ({by})" if by else ", mt"}),
mz AS (SELECT *, n >= 3 AND m >= 3 AS ok, CASE WHEN n >= 3 AND m >= 3 THEN (u - n * m / 2 - 0.5) / nullif(sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))), 0) END AS z FROM mu)"""


MW = f"n::BIGINT AS n, m::BIGINT AS m, CASE WHEN ok THEN {R('u')} END AS u, CASE WHEN ok THEN {R('u / (n * m)')} END AS effect, CASE WHEN ok THEN {R(normal_sql('z'))} END AS p"


@query(f"WITH {PAIR}, x AS (SELECT v1 AS v, v0 >= 0.3 AS o FROM pair), {mw_sql('x')} SELECT {MW} FROM mz")
def mann_whitney_u(spark, d):
    return K.mann_whitney(pair(spark, d), "v1", F.col("v0") >= 0.3)


_MAPS = ("y97", "y98", "y99", "y00", "y01")
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS y, {b} AS o FROM m" for i, a in enumerate(_MAPS) for b in _MAPS[i + 1 :])


@query(f"""WITH m AS (SELECT row, col, {", ".join(f"max(frac) FILTER (WHERE year = {y}) >= 0.3 AS y{y % 100:02d}" for y in range(1997, 2002))} FROM built GROUP BY 1, 2), l AS ({_PAIRS}),
c AS (SELECT a, b, {_CONF} FROM l GROUP BY a, b) SELECT a, b, {R('(ov - e) / nullif(1 - e, 0)')} AS kappa, {R('ov')} AS overall, n FROM ({_EXPECT})""")
def kappa_matrix(spark, d):
    b = v.built(spark, d).groupBy("row", "col").agg(*[(F.max(F.when(F.col("year") == y, F.col("frac"))) >= 0.3).alias(f"y{y % 100:02d}") for y in range(1997, 2002)])
    return K.kappa_matrix(b, ["row", "col"], list(_MAPS))


@query(f"WITH {PAIR} SELECT {R('count(*) FILTER (WHERE v0 >= 0.3 AND v1 >= 0.5) / nullif(count(*) FILTER (WHERE v0 >= 0.3 OR v1 >= 0.5), 0)')} AS iou FROM pair")
def map_iou(spark, d):
    a, b = F.col("v0") >= 0.3, F.col("v1") >= 0.5
    return pair(spark, d).agg(F.try_divide(F.count_if(a & b), F.count_if(a | b)).alias("iou"))


@query(f"WITH {PRED}, t AS (SELECT ntile(10) OVER (ORDER BY p, row, col) AS decile, p, v1 - v0 AS g FROM pr) SELECT decile, count(*) AS n, {R('avg(p)')} AS predicted, {R('avg(g)')} AS observed FROM t GROUP BY decile")
def decile_table(spark, d):
    x = O.tiles(scored(spark, d), "p", ("row", "col"), 10, "decile")
    return x.groupBy("decile").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg(F.col("f1") - F.col("f0")).alias("observed"))


@query(f"""WITH {LAG}, x AS (SELECT row, col, round(growth3, 9) AS p, round(target, 9) AS o FROM f WHERE year = 1999), k AS (SELECT *, row_number() OVER (ORDER BY p DESC, row, col) AS rp, row_number() OVER (ORDER BY o DESC, row, col) AS ro,
{_rank_sql('p')} AS ap, {_rank_sql('o')} AS ao, greatest(1, round_even(0.2 * count(*) OVER (), 0)) AS top FROM x)
SELECT count(*) AS n, {R('corr(ap, ao)')} AS rho, {R('1 - sum((o - p) ** 2) / (count(*) * var_pop(o))')} AS r2, {R('avg(abs(o - p))')} AS mae, {R('count(*) FILTER (WHERE rp <= top AND ro <= top) / max(top)')} AS top_precision FROM k""")
def regression_metrics(spark, d):
    """A forecast that goes on with the last three years' growth, against the next two years'."""
    w = Window.partitionBy("row", "col").orderBy("year")
    at = lambda k: F.max("value").over(w.rangeBetween(k, k))
    x = relative(spark, d).select("row", "col", "year", (F.col("value") - at(-3)).alias("p"), (at(2) - F.col("value")).alias("o")).where("year = 1999")
    return K.regression(x.withColumns({"p": F.round("p", 9), "o": F.round("o", 9)}), "p", "o")


@query(f"WITH {REL} SELECT CASE WHEN p > 0.1 THEN 'in step' WHEN slope > 0 THEN 'faster' WHEN slope < 0 THEN 'slower' ELSE 'in step' END AS class, count(*) AS n FROM rt JOIN lights l USING (row, col) WHERE l.year = 2001 AND ln(greatest(l.value, 0) + 1) >= ln(101) GROUP BY 1")
def trend_classes(spark, d):
    """Active cells by their trend relative to the core."""
    active = v.lights(spark, d).where(F.col("year") == 2001).where(X.log_radiance(F.col("value")) >= F.log1p(F.lit(100.0))).select("row", "col")
    slope = F.col("slope")
    c = F.when(F.col("p") > 0.1, "in step").when(slope > 0, "faster").when(slope < 0, "slower").otherwise("in step")
    return T.trend(relative(spark, d)).join(active, ["row", "col"], "left_semi").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT year, {R('avg(value)')} AS mean, {R('CASE WHEN stddev_pop(value) < 1e-6 THEN 1 ELSE stddev_pop(value) END')} AS sd FROM lights GROUP BY year")
def normaliser(spark, d):
    sd = F.stddev_pop("value")
    return v.lights(spark, d).groupBy("year").agg(F.avg("value").alias("mean"), F.when(sd < 1e-6, 1.0).otherwise(sd).alias("sd"))


@query()
def ca_allocation(spark, d):
    """Demand from the growth so far, allocated in eight rounds with neighbourhood feedback."""
    g = C.urban_growth(chg(spark, d), 4).collect()[0]
    cells = chg(spark, d).join(v.surface(spark, d), ["row", "col"]).select("row", "col", "score", F.col("is_urban").alias("urban"))
    return G.allocate(cells, G.extrapolate_demand(g["urban0"], g["urban1"], 4, 1), N, N)


@query(f"WITH RECURSIVE {v.SQL.strip()[5:]}, s AS (SELECT row, col, score, row_number() OVER (ORDER BY score DESC, row, col) AS i FROM surface), pick AS (SELECT 1 AS rank, [i] AS taken, [row] AS rs, [col] AS cs FROM s WHERE i = 1 UNION ALL SELECT rank + 1, list_append(taken, n.i), list_append(rs, n.row), list_append(cs, n.col) FROM pick, LATERAL (SELECT i, row, col FROM s WHERE len(list_filter(list_zip(rs, cs), lambda z: (z[1] - s.row) ** 2 + (z[2] - s.col) ** 2 < 25)) = 0 ORDER BY i LIMIT 1) n WHERE rank < 10) SELECT u.rank::INT AS rank, s.row, s.col, {R('s.score')} AS score FROM (SELECT unnest(taken) AS i, unnest(range(1, 11)) AS rank FROM pick WHERE rank = 10) u JOIN s USING (i)".replace("u.rank::INT", "u.rank::BIGINT"), with_views=False)
def spaced_sites(spark, d):
    return Z.spaced(v.surface(spark, d), "score", 10, 5.0)
