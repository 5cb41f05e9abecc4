"""Queries of points, roads, tables and news."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import news as W
from ..operators import stencil as S
from ..operators import trend as T
from ..operators import vector as V
from ..operators.activity import rank01
from ..operators.order import median, numbered
from ..operators.storage import cut, new_path
from ..operators.scoring import robustness
from ..operators.zones import spaced
from ..sources import views as v
from ..sources.scenes import scan_scenes, write_scenes
from .grid import CHG, chg
from .registry import R, query
from .trends import LT, _rank_sql

N = v.ROWS


@query("SELECT c.row, c.col, count(p.grp) AS n FROM cells c LEFT JOIN poi p USING (row, col) GROUP BY 1, 2")
def poi_density(spark, d):
    return V.density(v.poi(spark, d), v.grid(spark))


SEG = """sg AS (SELECT way_id, class, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM road WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
sl AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS len, greatest(1, ceil(round(sqrt((x2 - x) ** 2 + (y2 - y) ** 2), 9) / 50))::BIGINT AS n FROM sg WHERE x2 IS NOT NULL),
pc AS (SELECT way_id, floor((y + (y2 - y) * ((k + 0.5) / n)) / 100)::BIGINT AS row, floor((x + (x2 - x) * ((k + 0.5) / n)) / 100)::BIGINT AS col, len / n * CASE class WHEN '1' THEN 5 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 0.5 END AS metres
FROM sl, LATERAL (SELECT unnest(range(n)) AS k))"""
ROAD_WEIGHTS = {"1": 5.0, "2": 3.0, "3": 2.0}


@query(f"WITH {SEG} SELECT row, col, {R('round(sum(metres), 3)')} AS metres FROM pc GROUP BY 1, 2")
def road_density(spark, d):
    p = V.road_pieces(v.road(spark, d), 50, 100, ROAD_WEIGHTS)
    return p.groupBy("row", "col").agg(F.round(F.sum("metres"), 3).alias("metres"))


@query(f"WITH {SEG} SELECT DISTINCT row, col FROM pc JOIN (SELECT DISTINCT way_id FROM road WHERE class = '1') USING (way_id)")
def major_road_mask(spark, d):
    """Cells that ways with a vertex of the first class pass; ways are chosen before they are cut into pieces."""
    r = v.road(spark, d).where("way_id IS NOT NULL").withColumn("major", F.max(F.col("class") == "1").over(Window.partitionBy("way_id"))).where("major")
    return V.road_pieces(r, 50, 100, ROAD_WEIGHTS).select("row", "col").distinct()


@query("WITH p AS (SELECT DISTINCT way_id, round(x / 20)::BIGINT AS sx, round(y / 20)::BIGINT AS sy FROM road), s AS (SELECT sx, sy FROM p GROUP BY 1, 2 HAVING count(*) >= 2) SELECT floor(sy * 20 / 100.0)::BIGINT AS row, floor(sx * 20 / 100.0)::BIGINT AS col, count(*) AS n FROM s GROUP BY 1, 2")
def junctions(spark, d):
    return V.junctions(v.road(spark, d), 20, 100)


@query(f"WITH k AS (SELECT row, col, grp, count(*) AS k, sum(CASE grp WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS f FROM poi GROUP BY 1, 2, 3) SELECT row, col, sum(k)::BIGINT AS n, count(*) AS kinds, {R('sum(f)')} AS footfall, {R('ln(sum(k)) - sum(k * ln(k)) / sum(k)')} AS entropy FROM k GROUP BY 1, 2")
def poi_mix_entropy(spark, d):
    return V.mix(v.poi(spark, d), {"purchase": 3.0, "signup": 2.0, "click": 1.0})


@query("SELECT grp AS \"group\", count(*) AS n FROM poi GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_poi_kinds(spark, d):
    return v.poi(spark, d).groupBy("group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group").limit(3)


@query(f"SELECT r_name, n_name, count(*) AS customers, {R('sum(c_acctbal)')} AS balance, {R('max_by(c_acctbal, c_custkey)')} AS last_balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2", with_views=False)
def district_accounts(spark, d):
    n = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = v.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"), F.max_by("c_acctbal", "c_custkey").alias("last_balance"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), "balance", "last_balance")


@query(f"SELECT n_name, {R('round(sum(l_extendedprice * (1 - l_discount)), 2)')} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING sum(l_quantity) > 0", with_views=False)
def zonal_revenue(spark, d):
    li = v.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.sum("l_quantity").alias("q"))
    x = li.join(v.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(v.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("q").alias("q")).where("q > 0").drop("q")


@query("SELECT n_name, max_by(c_name, (c_acctbal, c_custkey)) AS largest FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", with_views=False)
def largest_in_district(spark, d):
    c = v.table(spark, d, "customer").join(v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("largest"))


@query(f"""WITH e AS (SELECT avg(p_retailprice) AS m, p_brand FROM part GROUP BY 2), x AS (SELECT p_brand, p_retailprice AS p, m FROM part JOIN e USING (p_brand))
SELECT p_brand, count(*) AS n, {R('median(abs(100 * (p - m) / m))')} AS median_error, {R('avg(abs(p - m))')} AS mae, {R('avg((abs(p - m) <= 0.1 * m)::INT)')} AS within10, {R('100 * (sum(p) - sum(m)) / sum(m)')} AS total_error FROM x GROUP BY GROUPING SETS ((p_brand), ())""", with_views=False)
def district_errors(spark, d):
    """Errors by group and, without a group, in total."""
    p = v.table(spark, d, "part")
    x = p.join(p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")), "p_brand").select("p_brand", F.col("p_retailprice").alias("p"), "m")
    x = x.union(x.select(F.lit(None).cast("string"), "p", "m")).withColumn("key", F.coalesce("p_brand", F.lit("")))
    off = F.col("p") - F.col("m")
    g = x.groupBy("key").agg(
        F.max("p_brand").alias("p_brand"), F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), F.avg((F.abs(off) <= 0.1 * F.col("m")).cast("int")).alias("within10"),
        X.percent_difference(F.sum("p"), F.sum("m")).alias("total_error"),
    )
    return g.join(median(x, F.abs(X.percent_difference(F.col("p"), F.col("m"))), "median_error", ["key"]), "key").select("p_brand", "n", "median_error", "mae", "within10", "total_error")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages", with_views=False)
def text_cleaning(spark, d):
    return v.table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"), X.slug(F.col("url")).alias("slug"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("WITH t AS (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM article) SELECT id, len(list_filter(w, lambda x: x NOT IN ('the','of','and','to','in','is','a','on','for','at','with','by','as','be','it','that','this'))) AS n_tokens FROM t")
def title_tokens(spark, d):
    return v.article(spark, d).select("id", F.size(W.tokens(F.col("title"))).alias("n_tokens"))


DIRECTION = "CASE WHEN kind = 'error' THEN 'negative' WHEN kind = 'view' THEN 'neutral' ELSE 'positive' END"


def direction():
    return F.when(F.col("kind") == "error", "negative").when(F.col("kind") == "view", "neutral").otherwise("positive")


STATUS_SQL = "CASE user_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(W.STATUS)) + " END"


def status():
    """The stand-in of an article's status: statuses in turn by user."""
    return F.element_at(F.array(*[F.lit(k) for k in W.STATUS]), (F.col("user_id") % 10).cast("int") + 1)


@query(f"""WITH a AS (SELECT id, title || ' ' || body AS t, {DIRECTION} AS direction, {STATUS_SQL} AS status FROM article), c AS (SELECT *, regexp_matches(t, '{W.TEMPORARY}', 'i') AS temporary, regexp_matches(t, '{W.NEGATIVE}', 'i') AS neg, regexp_matches(t, '{W.POSITIVE}', 'i') AS pos FROM a),
r AS (SELECT *, CASE WHEN temporary THEN 'temporary' WHEN status IN ('delayed', 'stalled', 'cancelled') AND NOT neg THEN 'setback without a cue' WHEN direction = 'negative' AND NOT neg THEN 'negative without a cue' WHEN direction = 'positive' AND NOT pos THEN 'positive without a cue' END AS reason FROM c)
SELECT id, coalesce(reason <> 'temporary', true) AS is_event, CASE WHEN reason = 'setback without a cue' THEN 'unclear' ELSE status END AS status, CASE WHEN reason IS NULL OR reason = 'temporary' THEN direction ELSE 'neutral' END AS direction, reason FROM r""")
def evidence_check(spark, d):
    """Labels held against their texts' cues, which are all of a text that meets the events."""
    a = v.article(spark, d, cues=W.cues(F.concat_ws(" ", "title", "body")))
    return a.select("id", W.judge(F.col("cues"), direction(), status()).alias("e")).select("id", "e.*")


EFFECT = "CASE kind WHEN 'purchase' THEN 0.9 WHEN 'signup' THEN 0.6 WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.2 WHEN 'error' THEN 0.5 ELSE 0 END"
RADIUS = "CASE kind WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 2.0 WHEN 'click' THEN 1.0 WHEN 'view' THEN 1.0 WHEN 'error' THEN 2.0 ELSE 1.0 END"
SIGN = f"(CASE WHEN {STATUS_SQL} IN ('delayed', 'stalled', 'cancelled') THEN -1.0 ELSE CASE {DIRECTION} WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END END)"
WEIGHT = f"(CASE {STATUS_SQL} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in W.STATUS.items()) + " END)"
BASIS = "(CASE WHEN value > 50 THEN 1.0 ELSE 0.6 END)"
IMPACT = f"""im AS (SELECT id, kind, source, 'p' || (user_id % 40) AS place, user_id, round({SIGN} * {EFFECT} * {WEIGHT} * {BASIS} * 0.5 ** ((greatest(0, date_diff('day', published::DATE, DATE '2024-06-01')) / 30.44::DOUBLE) / 12), 9) AS impact,
({STATUS_SQL} IN ('delayed', 'stalled', 'cancelled'))::BIGINT AS setback FROM article)"""


def impacts(spark, d):
    a = v.article(spark, d)
    basis = F.when(F.col("value") > 50, W.BASIS["reported_fact"]).otherwise(W.BASIS["announcement_or_plan"])
    i = W.impact(F.col("kind"), direction(), status(), basis, W.age_months(F.col("published"), F.lit("2024-06-01").cast("date")))
    return a.select("id", "kind", "source", F.concat(F.lit("p"), F.col("user_id") % 40).alias("place"), "user_id", F.round(i, 9).alias("impact"), W.is_setback(status()).cast("int").alias("setback"))


@query(f"WITH {IMPACT} SELECT id, {R('impact')} AS impact FROM im")
def news_impact(spark, d):
    return impacts(spark, d).select("id", "impact")


@query(f"WITH {IMPACT}, g AS (SELECT kind, place, setback, count(*) AS n_articles, count(DISTINCT source) AS n_sources, max_by(id, (abs(impact), -id)) AS best_id, max_by(impact, (abs(impact), -id)) AS best FROM im GROUP BY 1, 2, 3) SELECT kind, place, setback, n_articles, n_sources, best_id, {R('best * least(1, 0.5 + 0.25 * n_sources)')} AS impact FROM g")
def news_events(spark, d):
    return W.cluster_events(impacts(spark, d))


PLACED = f"""{IMPACT}, pe AS (SELECT kind, row, col, setback, max_by(impact, (abs(impact), -id)) * least(1, 0.5 + 0.25 * count(DISTINCT source)) AS impact, {RADIUS} AS radius FROM (SELECT *, user_id % 50 AS row, (user_id * 7) % 50 AS col FROM im) GROUP BY kind, row, col, setback),
nz AS (SELECT c.row, c.col, tanh(coalesce(sum(e.impact * exp(-((c.row - e.row) ** 2 + (c.col - e.col) ** 2) / radius ** 2)) FILTER (WHERE e.row % 10 <> 0), 0) / 1.5) AS idx FROM cells c LEFT JOIN pe e ON true GROUP BY 1, 2)"""


def placed_events(spark, d):
    """Clustered events with their cell and their kind's radius; those of every tenth row stand for events that name no place."""
    at = F.split("place", ",")
    e = W.cluster_events(impacts(spark, d).withColumn("place", F.concat_ws(",", F.col("user_id") % 50, F.col("user_id") * 7 % 50)))
    return e.select("impact", at[0].cast("long").alias("row"), at[1].cast("long").alias("col"), W.radius(F.col("kind")).alias("radius"), (at[0].cast("long") % 10 == 0).alias("citywide"))


@query(f"WITH {PLACED} SELECT row, col, {R('idx')} AS index FROM nz")
def news_zone_index(spark, d):
    """Located events over all cells, each kind with its radius."""
    return W.zone_index(v.grid(spark), placed_events(spark, d).where("NOT citywide"))


@query(f"WITH {PLACED} SELECT count(*) AS n, {R('tanh(sum(impact) / 3.0)')} AS city FROM pe WHERE row % 10 = 0")
def news_city_index(spark, d):
    """Events without a place say how much, not where."""
    return placed_events(spark, d).where("citywide").agg(F.count("*").alias("n"), F.tanh(F.sum("impact") / 3.0).alias("city"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE kind = 'error') AS setbacks, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) + 0 AS share FROM article GROUP BY 1 ORDER BY n DESC, source LIMIT 8")
def news_rollup(spark, d):
    g = v.article(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("setbacks"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total)).select("source", "n", "setbacks", (F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), "source").limit(8)


@query("SELECT kind, id, published FROM article QUALIFY row_number() OVER (PARTITION BY kind ORDER BY published DESC, id) <= 8")
def latest_per_query(spark, d):
    w = Window.partitionBy("kind").orderBy(F.desc("published"), "id")
    return v.article(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("kind", "id", "published")


@query()
def news_dedupe(spark, d):
    """Articles of which no newer one with a title 0.7 alike is kept."""
    return W.dedupe(v.article(spark, d))


DRAWS = 2000


def draw_uniform(draw, j):
    """A number in (0, 1) for a draw and a component: two steps of a congruential generator, so that every engine has the same."""
    step = lambda x: (x * 1103515245 + 12345) % 2147483648
    return (step(step(step(draw * 8 + j) % 1048573)) + 0.5) / 2147483648.0


COMPONENTS = ("market_now", "activity_now", "activity_growth", "urban_growth", "access")
_U = [f"(-ln({draw_uniform_sql}))" for draw_uniform_sql in [f"((((((((draw * 8 + {j}) * 1103515245 + 12345) % 2147483648) % 1048573) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648 + 0.5::DOUBLE) / 2147483648.0::DOUBLE" for j in range(5)]]
OPP = f"""{CHG}, {LT}, {SEG}, rdm AS (SELECT row, col, round(sum(metres), 3) AS m FROM pc GROUP BY 1, 2),
dn AS (SELECT c.row, c.col, sum(p.people) AS market_now, sum(g.new_::INT) AS urban_growth FROM cells c CROSS JOIN disk3 o LEFT JOIN chg g ON g.row = c.row + o.dr AND g.col = c.col + o.dc LEFT JOIN population p ON p.year = 2001 AND p.row = c.row + o.dr AND p.col = c.col + o.dc GROUP BY 1, 2),
ra AS (SELECT c.row, c.col, sum(coalesce(r.m, 0)) / 29.0::DOUBLE AS access FROM cells c CROSS JOIN disk3 o LEFT JOIN rdm r ON r.row = greatest(0, least(49, c.row + o.dr)) AND r.col = greatest(0, least(49, c.col + o.dc)) GROUP BY 1, 2),
op0 AS (SELECT row, col, market_now, ln(l.value + 1) AS activity_now, lt.slope AS activity_growth, urban_growth, round(access, 6) AS access FROM dn JOIN ra USING (row, col) JOIN lt USING (row, col) JOIN chg USING (row, col) JOIN (SELECT * FROM lights WHERE year = 2001) l USING (row, col) WHERE chg.v1 >= 0.1 OR urban_growth >= 3),
op AS (SELECT row, col, {', '.join(f"{_rank_sql(c)} AS {c}" for c in COMPONENTS)} FROM op0),
oc AS (SELECT *, ({' + '.join(COMPONENTS)}) / 5 AS score FROM op)"""


def opportunity(spark, d):
    """Candidate zones and the ranks of their five components."""
    c = chg(spark, d)
    near = S.disk_sum(v.population(spark, d).where("year = 2001"), "people", 3, N, N).withColumnRenamed("sum", "market_now")
    new = S.disk_sum(c.select("row", "col", F.col("new_urban").cast("double").alias("n")), "n", 3, N, N).withColumnRenamed("sum", "urban_growth")
    metres = road_density(spark, d)
    roads = S.circular_mean(v.grid(spark).join(metres, ["row", "col"], "left").select("row", "col", F.coalesce("metres", F.lit(0.0)).alias("m")), "m", 3, N, N)
    x = near.join(new, ["row", "col"]).join(roads.select("row", "col", F.round("mean", 6).alias("access")), ["row", "col"])
    x = x.join(v.lights(spark, d).where("year = 2001").select("row", "col", X.log_radiance(F.col("value")).alias("activity_now")), ["row", "col"])
    x = x.join(T.trend(v.lights(spark, d)).select("row", "col", F.col("slope").alias("activity_growth")), ["row", "col"])
    x = x.join(c.select("row", "col", "f1"), ["row", "col"]).where("f1 >= 0.1 OR urban_growth >= 3").select("row", "col", *[F.col(k).alias(f"v_{k}") for k in COMPONENTS])
    x = cut(x)
    for k in COMPONENTS:
        x = rank01(x, f"v_{k}", k, missing="median")
    return x.select("row", "col", *COMPONENTS)


def _score():
    return sum((F.col(k) for k in COMPONENTS[1:]), F.col(COMPONENTS[0])) / 5


@query(f"WITH {OPP} SELECT row, col, {', '.join(f'{R(c)} AS {c}' for c in COMPONENTS)}, {R('score')} AS score FROM oc")
def opportunity_score(spark, d):
    return opportunity(spark, d).withColumn("score", _score())


@query(f"""WITH {OPP}, w0 AS (SELECT draw, {', '.join(f'{u} AS w{j}' for j, u in enumerate(_U))} FROM range({DRAWS}) t(draw)), w AS (SELECT *, w0 + w1 + w2 + w3 + w4 AS ws FROM w0),
sc AS (SELECT draw, row, col, round(({' + '.join(f'w{j} * {c}' for j, c in enumerate(COMPONENTS))}) / ws, 9) AS s FROM op CROSS JOIN w), r AS (SELECT draw, row, col, rank() OVER (PARTITION BY draw ORDER BY s DESC) AS lo, count(*) OVER (PARTITION BY draw, s) AS k FROM sc)
SELECT row, col, {R('avg(lo + (k - 1) / 2.0::DOUBLE)')} AS mean_rank, {R('avg((lo <= 10)::INT)')} AS top_share FROM r GROUP BY 1, 2""")
def opportunity_robustness(spark, d):
    """Mean rank and share of draws in the top ten, under 2,000 random weightings of the components; equal scores share their mean rank."""
    u = [-F.log(draw_uniform(F.col("id"), F.lit(j))) for j in range(5)]
    total = sum(u[1:], u[0])
    w = spark.range(DRAWS).select(F.col("id").alias("draw"), F.array(*u).alias("w"), total.alias("ws"))
    return robustness(opportunity(spark, d), list(COMPONENTS), w, 10)


@query()
def opportunity_top10(spark, d):
    """The zones that any of the weightings puts in the top ten."""
    return opportunity_robustness(spark, d).where("top_share > 0")


@query(f"WITH {PLACED} SELECT row, col, {R('idx')} AS index FROM nz")
def news_zone_index_whole(spark, d):
    """news_zone_index under its earlier name."""
    return news_zone_index(spark, d)


@query()
def opportunity_sites(spark, d):
    """Ten sites at least five cells apart, after news."""
    x = opportunity_score(spark, d).join(news_zone_index(spark, d), ["row", "col"])
    return spaced(x.withColumn("s", F.col("score") + 0.1 * X.clip(F.col("index"), -1, 1)), "s", 10, 5.0)


@query(f"""WITH {OPP}, {PLACED}, b AS (SELECT row, col, row_number() OVER (ORDER BY round(score, 9) DESC, row, col) AS before, row_number() OVER (ORDER BY round(score + 0.1 * greatest(-1, least(1, idx)), 9) DESC, row, col) AS after FROM oc JOIN nz USING (row, col))
SELECT row, col, before, after, before - after AS moved FROM b""")
def rank_movement(spark, d):
    """Ranks before and after news."""
    x = opportunity(spark, d).join(news_zone_index(spark, d), ["row", "col"]).select("row", "col", F.round(_score(), 9).alias("a"), F.round(_score() + 0.1 * X.clip(F.col("index"), -1, 1), 9).alias("b"))
    x = numbered(numbered(x, "a", ("row", "col"), "before", descending=True), "b", ("row", "col"), "after", descending=True)
    return x.select("row", "col", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), (F.col("before") - F.col("after")).cast("long").alias("moved"))


@query(f"SELECT event_id, {R('2 * 6371 * asin(sqrt(sin((radians(lat) - radians(25.3)) / 2) ** 2 + cos(radians(25.3)) * cos(radians(lat)) * sin((radians(lon) - radians(82.97)) / 2) ** 2))')} AS km, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::BIGINT AS epsg FROM (SELECT event_id, (user_id % 360) - 180.0::DOUBLE AS lon, (event_id % 160) - 80.0::DOUBLE AS lat FROM events)", with_views=False)
def haversine_and_zone(spark, d):
    e = v.table(spark, d, "events").select("event_id", (F.col("user_id") % 360 - 180.0).alias("lon"), (F.col("event_id") % 160 - 80.0).alias("lat"))
    return e.select("event_id", X.haversine_km(F.lit(82.97), F.lit(25.3), F.col("lon"), F.col("lat")).alias("km"), X.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last FROM events WHERE event_type <> 'error' GROUP BY 1, 2", with_views=False)
def scene_counts(spark, d):
    e = v.table(spark, d, "events").where("event_type <> 'error'")
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min(t).alias("first"), F.max(t).alias("last"))


@query("SELECT event_id, (user_id & 30) = 0 AS clear, ((user_id >> 2) & 3) <= 1 AS good FROM events", with_views=False)
def quality_bits(spark, d):
    u = F.col("user_id")
    return v.table(spark, d, "events").select("event_id", (u.bitwiseAND(30) == 0).alias("clear"), (F.shiftright(u, 2).bitwiseAND(3) <= 1).alias("good"))


@query(f"SELECT user_id % 50 AS row, event_type, {R('median(value)')} AS median, {R('avg(value)')} AS mean, mode_.m AS mode, {R('arg_max(value, event_id)')} AS mosaic FROM events e JOIN (SELECT r, t, min_by(b, (-k, b)) AS m FROM (SELECT user_id % 50 AS r, event_type AS t, floor(value / 10)::BIGINT AS b, count(*) AS k FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) mode_ ON r = user_id % 50 AND t = event_type GROUP BY 1, 2, mode_.m", with_views=False)
def temporal_composite(spark, d):
    """Median, mean, most frequent class (of tens, the lowest on ties) and last value of each cell's series."""
    e = v.table(spark, d, "events").select((F.col("user_id") % 50).alias("row"), "event_type", "value", "event_id")
    g = e.groupBy("row", "event_type").agg(F.avg("value").alias("mean"), F.mode(F.floor(F.col("value") / 10), deterministic=True).alias("mode"), F.max_by("value", "event_id").alias("mosaic"))
    return g.join(median(e, F.col("value"), "median", ["row", "event_type"]), ["row", "event_type"]).select("row", "event_type", "median", "mean", "mode", "mosaic")

@query("SELECT event_id, user_id % 50 AS row, event_id % 50 AS col, strftime(ts, '%Y-%m-%d') AS day, round(value, 6) + 0 AS cloud FROM events WHERE user_id % 50 BETWEEN 11 AND 24 AND event_id % 50 BETWEEN 30 AND 44 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND value <= 40", with_views=False)
def scene_scan(spark, d):
    """Scenes of an area and a time with little cloud, from a table laid out along a space-filling curve."""
    e = v.table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("row"), (F.col("event_id") % 50).alias("col"), F.to_date("ts").alias("day"), F.col("value").alias("cloud"))
    path = new_path(spark)
    write_scenes(e, path)
    found = scan_scenes(spark, path, (11, 24, 30, 44), ("2024-01-05", "2024-01-20"), 40.0)
    return found.select("event_id", "row", "col", F.col("day").cast("string").alias("day"), "cloud")
