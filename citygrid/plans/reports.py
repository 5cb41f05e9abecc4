"""Queries of summaries: news in one row, ranked events and zones, profiles, areas of interest with their grids, other projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import activity as A
from ..operators import change as C
from ..operators import growth as G
from ..operators import news as W
from ..operators import scoring as K
from ..operators import stencil as S
from ..operators import tiles as Q
from ..operators import zones as Z
from ..operators.order import numbered, percentiles
from ..operators.storage import cut
from ..sources import views as v
from .grid import _ZONES_SQL, PAIR, _gauss_sql, chg, pair
from .records import BASIS, IMPACT, PLACED, impacts, placed_events
from .registry import R, query
from .trends import TYPO, typed

N = v.ROWS


@query(f"""WITH {PLACED}, sr AS (SELECT max(k) / sum(k) AS top, sum(k) AS n FROM (SELECT source, count(*) AS k FROM article GROUP BY 1))
SELECT n::BIGINT AS articles, (SELECT count(*) FROM article WHERE {BASIS} = 1.0) AS reported_fact, (SELECT count(*) FROM article WHERE {BASIS} < 1.0) AS announcement_or_plan, {R('top')} AS max_source_share,
(SELECT count(*) FROM pe) AS events, (SELECT count(*) FROM pe WHERE impact > 0) AS positive, (SELECT count(*) FROM pe WHERE impact < 0) AS negative, (SELECT count(*) FROM pe WHERE row % 10 <> 0) AS located FROM sr""")
def news_profile(spark, d):
    """The news in one row: articles by basis, the largest source's share, events by sign, and how many have a place."""
    a = cut(v.article(spark, d).select("source", (F.col("value") > 50).alias("fact")))
    n = a.agg(F.count("*").alias("articles"), F.count_if("fact").alias("reported_fact"), F.count_if(~F.col("fact")).alias("announcement_or_plan"))
    top = a.groupBy("source").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("max_source_share"))
    e = placed_events(spark, d).agg(F.count("*").alias("events"), F.count_if(F.col("impact") > 0).alias("positive"), F.count_if(F.col("impact") < 0).alias("negative"), F.count_if(~F.col("citywide")).alias("located"))
    return n.join(F.broadcast(top)).join(F.broadcast(e))


@query(f"""WITH {IMPACT}, g AS (SELECT kind, place, setback, max_by(impact, (abs(impact), -id)) * least(1, 0.5 + 0.25 * count(DISTINCT source)) AS impact FROM im GROUP BY 1, 2, 3)
SELECT row_number() OVER (ORDER BY round(abs(impact), 9) DESC, kind, place, setback) AS rank, kind, place, setback, {R('impact')} AS impact FROM g""")
def strongest_events(spark, d):
    """Events by how strong they are, whichever way."""
    e = W.cluster_events(impacts(spark, d)).select("kind", "place", "setback", "impact", F.round(F.abs("impact"), 9).alias("s"), F.struct("place", "setback").alias("tie"))
    return numbered(e, "s", ("kind", "tie"), "rank", descending=True).select("rank", "kind", "place", "setback", "impact")


@query(f"""WITH {PAIR}, ds AS (SELECT v1, sqrt((row - 24.5) ** 2 + (col - 24.5) ** 2) AS km FROM pair), p AS (SELECT ceil(quantile_cont(km, 0.99) - 1e-9)::BIGINT AS n FROM ds)
SELECT r.i AS ring, count(v1) AS n, {R('avg(v1)')} AS mean FROM (SELECT unnest(range(n)) AS i FROM p) r LEFT JOIN ds ON floor(km)::BIGINT = r.i GROUP BY 1""")
def radial_profile_whole(spark, d):
    """Rings of 1 km as far as 99 % of the cells reach."""
    x = cut(pair(spark, d).select("v1", F.sqrt(F.pow(F.col("row") - 24.5, F.lit(2.0)) + F.pow(F.col("col") - 24.5, F.lit(2.0))).alias("km")))
    return C.radial_profile(x, F.col("v1"), F.col("km"), 1.0)


@query(f"WITH s AS (SELECT row, col, value FROM lights WHERE year = 2001), {_gauss_sql('s', 'value', 1.0)} SELECT row, col, CASE WHEN frac >= 0.1 THEN {R('smooth / frac')} END AS activity FROM g2 JOIN (SELECT * FROM built WHERE year = 2001) USING (row, col)")
def activity_per_built_smooth(spark, d):
    """Light, smoothed first, over the built fraction; null where hardly anything is built."""
    s = S.gaussian(v.lights(spark, d).where("year = 2001"), "value", 1.0, N, N).join(v.built(spark, d).where("year = 2001"), ["row", "col"])
    return s.select("row", "col", F.when(F.col("frac") >= 0.1, F.col("smooth") / F.col("frac")).alias("activity"))


@query("SELECT * FROM (" + _ZONES_SQL.format(views=v.SQL.strip()[5:]).replace("v1 >= 0.55", "v1 >= 0.2").replace("n_cells >= 2", "n_cells >= 1") + ") WHERE zone_id <= 25", with_views=False)
def largest_zones(spark, d):
    """The 25 largest zones, numbered by area and then by score."""
    cells = pair(spark, d).where("v1 >= 0.2")
    return Z.zone_stats(Z.label_zones(cells, N), cells, "v1", 1).where("zone_id <= 25")


@query("SELECT p_name AS kind, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20", with_views=False)
def top_part_kinds(spark, d):
    """The 20 most frequent kinds."""
    return v.table(spark, d, "part").groupBy(F.col("p_name").alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(20)


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 400) AS snippet, strftime(ts, '%Y-%m-%d') AS day FROM pages LEFT JOIN events ON event_id = page_id", with_views=False)
def page_snippets(spark, d):
    """A page's host, the first 400 characters of its text, and its day."""
    day = v.table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1, 10).alias("day"))
    p = v.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.substring(X.strip_html(F.col("html")), 1, 400).alias("snippet"))
    return p.join(day, "page_id", "left")


def cities(spark, d):
    """(city, lon0, lat0, lon1, lat1): boundaries around the events of every fortieth user."""
    lon, lat = F.col("user_id") % 6 + 75.0 + (F.col("event_id") % 100) / F.lit(100.0), (F.col("user_id") % 40 - 20) * 1.5 + (F.col("event_id") % 37) / F.lit(37.0) * (F.col("user_id") % 40) / 40
    e = v.table(spark, d, "events").select((F.col("user_id") % 40).alias("city"), (lon - F.col("user_id") % 6 + F.col("user_id") % 40 % 6).alias("lon"), lat.alias("lat"))
    return e.groupBy("city").agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"), F.max("lon").alias("lon1"), F.max("lat").alias("lat1"))


_CITY_SQL = """ev AS (SELECT user_id % 40 AS city, user_id % 6 + 75.0::DOUBLE + (event_id % 100) / 100.0::DOUBLE - user_id % 6 + user_id % 40 % 6 AS lon, (user_id % 40 - 20) * 1.5::DOUBLE + (event_id % 37) / 37.0::DOUBLE * (user_id % 40) / 40 AS lat FROM events),
bo AS (SELECT city, min(lon) AS lon0, min(lat) AS lat0, max(lon) AS lon1, max(lat) AS lat1 FROM ev GROUP BY 1),
bu AS (SELECT *, (lon0 + lon1) / 2 AS lon, (lat0 + lat1) / 2 AS lat, least(8.0, greatest(3.0, 0.15 * greatest((lon1 - lon0) * 111.32 * cos(radians((lat0 + lat1) / 2)), (lat1 - lat0) * 111.32))) AS buffer FROM bo)"""


@query(f"""WITH {_CITY_SQL} SELECT city, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::BIGINT AS epsg, {R('buffer')} AS buffer_km,
{R('greatest(lon0 - buffer / (111.32 * cos(radians(lat))), lon - 40 / (111.32 * cos(radians(lat))))')} AS lon0, {R('greatest(lat0 - buffer / 111.32, lat - 40 / 111.32)')} AS lat0, {R('least(lon1 + buffer / (111.32 * cos(radians(lat))), lon + 40 / (111.32 * cos(radians(lat))))')} AS lon1, {R('least(lat1 + buffer / 111.32, lat + 40 / 111.32)')} AS lat1 FROM bu""", with_views=False)
def city_areas(spark, d):
    """Areas of interest: boundaries with a margin of 3 to 8 km, cropped to 80 km around their middle, and the code of their zone."""
    return Q.areas_of_interest(cities(spark, d), "city")


@query()
def city_grids(spark, d):
    """Cells of 2 km of every area of interest, in its zone's metres and in degrees."""
    return Q.grid_cells(Q.areas_of_interest(cities(spark, d), "city"), "city", 2000.0)


@query(f"""WITH {TYPO.replace("lo AS (SELECT quantile_cont(resid, 0.25) AS q FROM rs)", "lo AS (SELECT t.pq, (SELECT quantile_cont(resid, [0.15, 0.25, 0.35]) FROM rs)[t.i] AS q FROM (VALUES (1, 0.15::DOUBLE), (2, 0.25::DOUBLE), (3, 0.35::DOUBLE)) t(i, pq))").replace("down, q, v1 - v0 AS delta FROM", "down, q, pq, v1 - v0 AS delta FROM")}
SELECT l.pq AS quantile, t.k AS type, count(tc.type) AS n FROM lo l CROSS JOIN range(6) t(k) LEFT JOIN tc ON tc.type = t.k AND tc.pq = l.pq GROUP BY 1, 2""")
def deficit_sensitivity(spark, d):
    """Cells of the typology's classes by the quantile of residuals below which activity counts as low."""
    share = [0.15, 0.25, 0.35]
    x = cut(typed(spark, d).drop("q", "low"))
    q = percentiles(x, F.col("resid"), share)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("quantile"), F.col("q")[i].alias("limit")) for i, s in enumerate(share)]))
    x = x.join(F.broadcast(q)).select("*", each.alias("k")).select("*", "k.*")
    x = x.withColumn("low", F.coalesce((F.col("resid") <= F.col("limit") + 1e-12) & (F.col("resid") < 0), F.lit(False)))
    x = x.withColumn("type", A.typology(x, F.col("is_urban"), F.col("delta") >= 0.2, F.col("low"), F.col("slope") > 0, F.col("slope") <= 0))
    return A.type_counts(x, "type", "quantile", tuple(share)).select("quantile", "type", "n")


@query()
def projection_against_trend(spark, d):
    """Our allocation against another projection to 2003, which goes on with each cell's own last two years: agreement at that one's demand."""
    now = C.two_epochs(v.built(spark, d), "frac", 1999, 2001).select("row", "col", (F.col("v1") >= 0.3).alias("urban"), ((F.col("v1") < 0.3) & (2 * F.col("v1") - F.col("v0") >= 0.3)).alias("other"))
    x = cut(now.join(v.surface(spark, d), ["row", "col"]))
    ours = G.allocate(x, x.where("other").count(), N, N).select("row", "col", F.lit(True).alias("ours"))
    both = x.where("NOT urban").join(ours, ["row", "col"], "left").withColumn("ours", F.coalesce("ours", F.lit(False)))
    return K.confusion(both, F.col("ours"), F.col("other"))
