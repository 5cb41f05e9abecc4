"""Queries of layer arithmetic, frames and tiles, polygons, draws and texts' small parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import texts as TX
from ..operators import change as C
from ..operators import draws as D
from ..operators import gazetteer as Z
from ..operators import growth as G
from ..operators import layers as L
from ..operators import scoring as K
from ..operators import tiles as Q
from ..operators import vector as V
from ..operators.order import numbered, percentiles
from ..sources import views as v
from .grid import CHG, chg
from .registry import R, query
from .trends import LT, PRED, scored

N = v.ROWS
RURAL = f"{CHG}, rur AS (SELECT row, col, v1 < 0.45 AND NOT coalesce(l.value = 0, false) AND NOT (new_ OR v1 - v0 >= 0.25) AS rural FROM chg LEFT JOIN (SELECT * FROM lights WHERE year = 1995) l USING (row, col))"


def rural(spark, d):
    water = v.lights(spark, d).where("year = 1995").select("row", "col", (F.col("value") == 0).alias("water"))
    x = chg(spark, d).join(water, ["row", "col"], "left")
    return x.select("row", "col", "f1", L.rural(F.col("f1"), F.col("water"), F.col("new_urban") | (F.col("delta") >= 0.25), 0.45).alias("rural"))


@query(f"WITH {RURAL} SELECT row, col, rural FROM rur")
def rural_reference(spark, d):
    """Cells hardly built, not water and not recently built."""
    return rural(spark, d).select("row", "col", "rural")


SUHI = f"{RURAL}, tb AS (SELECT year, CASE WHEN count(*) FILTER (WHERE rural) >= 100 THEN median(value / 10) FILTER (WHERE rural) END AS base FROM lights JOIN rur USING (row, col) WHERE year IN (1997, 2001) GROUP BY year), su AS (SELECT row, col, year, value / 10 - base AS i FROM lights JOIN tb USING (year))"


def intensity(spark, d, year):
    x = v.lights(spark, d).where(F.col("year") == year).join(rural(spark, d), ["row", "col"]).withColumn("t", F.col("value") / 10)
    return C.heat_island(x, "t", F.col("rural"), least=100).select("row", "col", F.col("intensity").alias(f"i{year}"), "f1")


@query(f"WITH {SUHI} SELECT a.row, a.col, {R('b.i - a.i')} AS change FROM su a JOIN su b USING (row, col) WHERE a.year = 1997 AND b.year = 2001")
def suhi_change(spark, d):
    """Change of the heat island's intensity over the same rural cells."""
    x = intensity(spark, d, 1997).join(intensity(spark, d, 2001).drop("f1"), ["row", "col"])
    return x.select("row", "col", (F.col("i2001") - F.col("i1997")).alias("change"))


@query(f"""WITH {SUHI}, h AS (SELECT row, col, greatest(i, 0) AS heat, f.v1, s.score AS ndvi FROM su JOIN chg f USING (row, col) JOIN surface s USING (row, col) WHERE year = 2001), t AS (SELECT greatest(quantile_cont(heat, 0.95), 1e-6) AS top FROM h)
SELECT row, col, {R('greatest(0, least(1, heat / top * (1 - least(1, ndvi / 0.3)) * v1))')} AS potential FROM h, t""")
def cooling_potential(spark, d):
    x = intensity(spark, d, 2001).join(v.surface(spark, d), ["row", "col"])
    return L.cooling_potential(x, "i2001", F.col("score"), F.col("f1")).select("row", "col", "potential")


@query(f"WITH {SUHI}, h AS (SELECT f.v1 >= 0.6 AS a, f.v1 >= 0.4 AS b, coalesce(i >= 3, false) AS hot FROM su JOIN chg f USING (row, col) WHERE year = 2001) SELECT CASE WHEN a THEN 'urban' WHEN b THEN 'peri-urban' ELSE 'rural' END AS setting, count(*) AS n, count(*) FILTER (WHERE hot) AS hot FROM h GROUP BY 1")
def hotspots_by_setting(spark, d):
    x = intensity(spark, d, 2001)
    return x.groupBy(L.setting(F.col("f1"), 0.6, 0.4).alias("setting")).agg(F.count("*").alias("n"), F.count_if(F.col("i2001") >= 3).alias("hot"))


_OLD = [f"(({7000 + 500 * i} + (l_linenumber * 1000 + l_orderkey % 9000) * 2) * 0.0000275::DOUBLE - 0.2::DOUBLE)" for i in range(6)]
_NEW = [f"({o} * {a}::DOUBLE + {b}::DOUBLE)" for o, a, b in zip(_OLD, L.SLOPE, L.INTERCEPT)]


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f"CASE WHEN year(l_shipdate) <= 1998 THEN {n} ELSE {o} END AS {b}" for n, o, b in zip(_NEW, _OLD, L.BANDS))}, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f'{R(b)} AS {b}' for b in L.BANDS)}, {R('greatest(-1, least(1, (nir - red) / greatest(nir + red, 1e-4)))')} AS ndvi, {R('greatest(-1, least(1, (swir1 - nir) / greatest(swir1 + nir, 1e-4)))')} AS ndbi,
{R('greatest(-1, least(1, (green - nir) / greatest(green + nir, 1e-4)))')} AS ndwi, {R('(red + green + blue) / 3')} AS brightness, {R('(q * 100 + 40000) * 0.00341802::DOUBLE + 149.0::DOUBLE - 273.15::DOUBLE')} AS celsius FROM s WHERE (l_partkey & 30) = 0 AND (l_suppkey & 3072) = 0""", with_views=False)
def harmonised_scenes(spark, d):
    """Scenes of two sensors on one scale, with their indices, where no cloud bit is set."""
    both = scenes(spark, d)
    b = {k: F.col(k) for k in L.BANDS}
    ind = L.indices(b["red"], b["green"], b["blue"], b["nir"], b["swir1"])
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *L.BANDS, *[c.alias(k) for k, c in ind.items()], L.celsius(F.col("l_quantity") * 100 + 40000).alias("celsius"))


def scenes(spark, d):
    """Line items as clear scenes of two sensors, harmonised."""
    li = v.table(spark, d, "lineitem")
    old = F.year("l_shipdate") <= 1998
    dn = {b: F.lit(7000 + 500 * i) + (F.col("l_linenumber") * 1000 + F.col("l_orderkey") % 9000) * 2 for i, b in enumerate(L.BANDS)}
    li = li.where(L.clear(F.col("l_partkey"), "qa_pixel") & L.clear(F.col("l_suppkey"), "qa60"))
    parts = {"old": li.where(old).withColumns({b: L.reflectance(x, b) for b, x in dn.items()}), "new": li.where(~old).withColumns({b: L.reflectance(x) for b, x in dn.items()})}
    return L.stacked(parts)


@query("SELECT user_id % 50 AS row, count(*) AS scenes, count(DISTINCT ts::DATE) AS days, count(DISTINCT ts::DATE) >= 10 AS enough FROM events GROUP BY 1", with_views=False)
def composite_depth(spark, d):
    return L.composite_depth(v.table(spark, d, "events").select((F.col("user_id") % 50).alias("row"), "ts"), ["row"], "ts", 10)


@query("WITH m AS (SELECT r, c, min_by(b, (-k, b)) AS cls FROM (SELECT user_id % 50 AS r, event_id % 50 AS c, event_type AS b, count(*) AS k FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT r AS row, c AS col, cls = 'purchase' AS flag FROM m", with_views=False)
def class_mask(spark, d):
    """Cells whose most frequent class is the one asked for."""
    return v.poi(spark, d).groupBy("row", "col").agg((F.mode("group", deterministic=True) == "purchase").alias("flag"))


@query(f"""WITH {PRED}, s AS (SELECT row, col, p >= 0.55 AS y, o FROM pr), f AS (SELECT c.row, c.col, was, coalesce(y, false) AS y, new_ AS o FROM chg c LEFT JOIN s USING (row, col))
SELECT row, col, (CASE WHEN y AND NOT o THEN 4 WHEN NOT y AND o THEN 3 WHEN y AND o THEN 2 WHEN was THEN 1 ELSE 0 END)::BIGINT AS outcome FROM f""")
def outcome_classes(spark, d):
    y = scored(spark, d).select("row", "col", (F.col("p") >= 0.55).alias("y"))
    x = chg(spark, d).join(y, ["row", "col"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    return x.select("row", "col", L.outcome(F.col("was_urban"), F.col("y"), F.col("new_urban")).alias("outcome"))


@query(f"SELECT a.row, a.col, {R('a.frac * (1 - 0.4::DOUBLE) + b.frac * 0.4::DOUBLE')} AS frac FROM built a JOIN built b USING (row, col) WHERE a.year = 1995 AND b.year = 2000")
def interpolated_epoch(spark, d):
    """1997 between the epochs of 1995 and 2000."""
    p = C.two_epochs(v.built(spark, d), "frac", 1995, 2000)
    return p.select("row", "col", L.between(F.col("v0"), F.col("v1"), F.lit(1997), 1995, 2000).alias("frac"))


@query("SELECT a.y AS year, b.y AS until FROM (SELECT DISTINCT year(o_orderdate)::BIGINT AS y FROM orders) a JOIN (SELECT DISTINCT year(o_orderdate)::BIGINT AS y FROM orders) b ON b.y = a.y + 2 WHERE a.y IN (SELECT year(l_shipdate) FROM lineitem) AND b.y IN (SELECT year(l_shipdate) FROM lineitem)", with_views=False)
def transition_discovery(spark, d):
    labels = v.table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"))
    return L.transitions(labels, v.table(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("year")), 2)


@query(f"""WITH g AS (SELECT row, col, year, value, lead(value, 2) OVER w - value AS label FROM lights WINDOW w AS (PARTITION BY row, col ORDER BY year)), s AS (SELECT * FROM g WHERE year IN (1996, 1998))
SELECT year::VARCHAR AS part, count(*) AS n, {R('avg(value)')} AS mean, {R('avg(label)')} AS label FROM s GROUP BY 1""")
def stacked_transitions(spark, d):
    """Training rows of several transitions, one under the other, of the columns that all have."""
    w = Window.partitionBy("row", "col").orderBy("year").rangeBetween(2, 2)
    g = v.lights(spark, d).withColumn("label", F.max("value").over(w) - F.col("value"))
    parts = {"1996": g.where("year = 1996").withColumn("only_here", F.lit(1)), "1998": g.where("year = 1998")}
    return L.stacked(parts).groupBy("part").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg("label").alias("label"))


@query(f"""WITH p AS (SELECT row // 5 AS row, col // 5 AS col, sum(people) AS people FROM population WHERE year = 2001 GROUP BY 1, 2) SELECT row, col, {R('people / (500.0::DOUBLE * 500)')} AS per_m2, {R('people / (500.0::DOUBLE * 500) * 900')} AS per_pixel FROM p""")
def density_units(spark, d):
    """People per block, per square metre and per 30 m pixel."""
    p = v.population(spark, d).where("year = 2001").groupBy(F.floor(F.col("row") / 5).alias("row"), F.floor(F.col("col") / 5).alias("col")).agg(F.sum("people").alias("people"))
    m2 = X.per_m2(F.col("people"), 500.0)
    return p.select("row", "col", m2.alias("per_m2"), X.per_cell(m2, 30.0).alias("per_pixel"))


@query(f"""WITH b AS (SELECT way_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM road GROUP BY 1), s AS (SELECT way_id, floor(x0 / 500) * 500 AS minx, floor(y0 / 500) * 500 AS miny, ceil(x1 / 500) * 500 AS maxx, ceil(y1 / 500) * 500 AS maxy FROM b)
SELECT *, round((maxx - minx) / 500)::BIGINT AS width, round((maxy - miny) / 500)::BIGINT AS height, round((maxx - minx) / 500)::BIGINT * 5 AS fine_width, round((maxy - miny) / 500)::BIGINT * 5 AS fine_height FROM s""")
def frame_pairs(spark, d):
    """Frames around road ways, snapped outward, and the fine frames of the same extent."""
    b = v.road(spark, d).groupBy("way_id").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    return Q.frame_pair(b, 100.0, 500.0)


PIX = "px AS (SELECT prow, pcol, floor((5000.0 - (5000.0 - (prow + 0.5) * 30)) / 100)::BIGINT AS row, floor(((pcol + 0.5) * 30) / 100)::BIGINT AS col, (round(o_totalprice * 100)::BIGINT % 1009) / 1009.0::DOUBLE AS value, 1 + o_orderkey % 3 AS w FROM (SELECT *, o_custkey % 170 AS prow, o_orderkey % 170 AS pcol FROM orders))"


def pixels(spark, d, res=30.0, side=170):
    """Orders as pixels of 30 m: the frame is a little larger than the grid."""
    p = v.table(spark, d, "orders").withColumns({"prow": F.col("o_custkey") % side, "pcol": F.col("o_orderkey") % side})
    y, x = N * 100.0 - (F.col("prow") + 0.5) * res, (F.col("pcol") + 0.5) * res
    row, col = Q.pixel_cell(x, y, 0.0, N * 100.0, 100.0, N, N)
    value = F.round(F.col("o_totalprice") * 100).cast("long") % 1009 / F.lit(1009.0)
    return p.select("prow", "pcol", row.alias("row"), col.alias("col"), value.alias("value"), (1 + F.col("o_orderkey") % 3).alias("w"))


@query(f"WITH {PIX} SELECT row, col, count(*) AS n, {R('sum(value * w) / sum(w)')} AS mean FROM px WHERE row < 50 AND col < 50 GROUP BY 1, 2")
def pixels_to_cells(spark, d):
    """30 m pixels in 100 m cells by their centres, weighted; pixels outside are left out."""
    return Q.to_cells(pixels(spark, d), F.col("value"), F.col("w"))


@query(f"WITH {PIX} SELECT row, col, avg((value > 0.45)::INT) > 0.5 AS flag FROM px WHERE row < 50 AND col < 50 GROUP BY 1, 2")
def projected_mask(spark, d):
    """Cells of which more than half the pixels are flagged."""
    return Q.mostly(pixels(spark, d), F.col("value") > 0.45)


@query(f"SELECT (c.row * 5 + i.k) // 12 AS row, (c.col * 5 + j.k) // 12 AS col, count(*) AS n, {R('avg(frac)')} AS mean FROM built c CROSS JOIN range(5) i(k) CROSS JOIN range(5) j(k) WHERE year = 2001 AND frac >= 0.3 GROUP BY 1, 2")
def nested_pixels(spark, d):
    """Urban cells as 5 x 5 pixels each, which are grouped anew into blocks of 12 that no cell's edge fits."""
    p = Q.nested(v.built(spark, d).where("year = 2001 AND frac >= 0.3"), 5)
    return p.groupBy(F.floor(F.col("prow") / 12).alias("row"), F.floor(F.col("pcol") / 12).alias("col")).agg(F.count("*").alias("n"), F.avg("frac").alias("mean"))


HELD = "hb AS (SELECT row // 10 AS br, col // 10 AS bc FROM population WHERE year = 2001 GROUP BY 1, 2 HAVING sum(people)::BIGINT % 3 = 0)"


@query(f"WITH ol AS (SELECT unnest(range(0, 47, 2)) AS p), {HELD}, m AS (SELECT row, col, (row // 10, col // 10) IN (SELECT (br, bc) FROM hb) AS val FROM cells), n AS (SELECT a.p AS row, b.p AS col, count(*) FILTER (WHERE val) AS k FROM ol a CROSS JOIN ol b JOIN m ON m.row BETWEEN a.p AND a.p + 3 AND m.col BETWEEN b.p AND b.p + 3 GROUP BY 1, 2) SELECT row, col, CASE WHEN k = 16 THEN 'val' ELSE 'train' END AS side FROM n WHERE k IN (0, 16)")
def tile_sides(spark, d):
    """Tiles wholly inside the validation blocks, or wholly outside; a block's population says whether it is one."""
    block = [F.floor(F.col("row") / 10).alias("br"), F.floor(F.col("col") / 10).alias("bc")]
    held = v.population(spark, d).where("year = 2001").groupBy(*block).agg(F.sum("people").cast("long").alias("n")).where("n % 3 = 0").select("br", "bc")
    mask = v.grid(spark).select("row", "col", *block).join(held, ["br", "bc"], "left_semi").select("row", "col")
    return Q.select_tiles(Q.origins(spark, N, N, 4, 2), mask, 4)


ORI = "ol AS (SELECT DISTINCT unnest(list_append(range(0, 50 - 16 + 1, 8), 34)) AS p), ot AS (SELECT a.p::BIGINT AS row, b.p::BIGINT AS col FROM ol a CROSS JOIN ol b)"


@query(f"WITH {ORI}, c AS (SELECT t.row AS tr, t.col AS tc, s.row, s.col, ln((s.score * 0.98 + 0.01) / (1 - (s.score * 0.98 + 0.01))) + ((t.row * 3 + t.col * 5) % 7 - 3) / 10.0::DOUBLE AS z FROM ot t JOIN surface s ON s.row BETWEEN t.row AND t.row + 15 AND s.col BETWEEN t.col AND t.col + 15) SELECT row, col, count(*) AS n, {R('1 / (1 + exp(-avg(z)))')} AS p FROM c GROUP BY 1, 2")
def overlap_prediction(spark, d):
    """Overlapping tiles' logits, averaged by cell."""
    t = Q.covered(Q.origins(spark, N, N, 16, 8), 16).join(v.surface(spark, d), ["row", "col"])
    z = X.logit(F.col("score") * 0.98 + 0.01) + ((F.col("tile_row") * 3 + F.col("tile_col") * 5) % 7 - 3) / F.lit(10.0)
    return Q.overlap_average(t.withColumn("logit", z))


@query(f"""WITH s AS (SELECT k.k, s.row, s.col, s.score FROM surface s CROSS JOIN range(8) k(k)), t AS (SELECT k, score, CASE k % 4 WHEN 0 THEN row WHEN 1 THEN 49 - col WHEN 2 THEN 49 - row ELSE col END AS r, CASE k % 4 WHEN 0 THEN col WHEN 1 THEN row WHEN 2 THEN 49 - col ELSE 49 - row END AS c FROM s)
SELECT k, {R('sum(score * r)')} AS by_row, {R('sum(score * (CASE WHEN k >= 4 THEN 49 - c ELSE c END))')} AS by_col FROM t GROUP BY 1""")
def square_symmetries(spark, d):
    """A surface under the eight symmetries, by its moments."""
    s = v.surface(spark, d).select("row", "col", "score", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    r, c = Q.symmetry(F.col("row"), F.col("col"), F.col("k"), N)
    return s.groupBy("k").agg(F.sum(F.col("score") * r).alias("by_row"), F.sum(F.col("score") * c).alias("by_col"))


@query(f"WITH {CHG}, b AS (SELECT (row // 7) * 8 + col // 7 AS block, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w FROM chg WHERE NOT was GROUP BY 1) SELECT block FROM b WHERE h >= 7 AND w >= 7")
def large_blocks(spark, d):
    """Blocks over whose whole span cells are still open."""
    from ..operators.zones import block_id

    return Q.large_blocks(chg(spark, d).where("NOT was_urban").select("row", "col", block_id(7, 8).alias("block")), 7)


_CORNERS = ((0.0, 0.0), (8.0, 1.5), (4.2, 3.1), (7.3, 9.0), (0.7, 6.1))
POLY = f"""corner AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(_CORNERS))}) t(k, dx, dy)),
edge AS (SELECT n_nationkey AS poly, (n_nationkey * 7) % 42 + a.dx AS x1, (n_nationkey * 11) % 40 + a.dy AS y1, (n_nationkey * 7) % 42 + b.dx AS x2, (n_nationkey * 11) % 40 + b.dy AS y2 FROM nation, corner a JOIN corner b ON b.k = (a.k + 1) % 5),
inside AS (SELECT poly, row, col FROM edge, cells WHERE (y1 > row + 0.5) <> (y2 > row + 0.5) AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


def polygons(spark, d):
    k = len(_CORNERS)
    pairs = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("ax", "ay", "bx", "by"), (*_CORNERS[i], *_CORNERS[(i + 1) % k]))]) for i in range(k)]))
    at = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("poly"), (F.col("n_nationkey") * 7 % 42).alias("x0"), (F.col("n_nationkey") * 11 % 40).alias("y0"), pairs.alias("e"))
    return at.select("poly", *[(F.col(o) + F.col(f"e.{c}")).alias(n) for n, o, c in (("x1", "x0", "ax"), ("y1", "y0", "ay"), ("x2", "x0", "bx"), ("y2", "y0", "by"))])


def cells_in_polygons(spark, d):
    cells = v.grid(spark).select((F.col("row") * N + F.col("col")).alias("id"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return Q.in_polygons(cells, polygons(spark, d), 4.0).select("poly", F.floor(F.col("id") / N).alias("row"), (F.col("id") % N).alias("col"))


@query(f"WITH {POLY} SELECT poly, row, col FROM inside")
def point_in_polygon(spark, d):
    return cells_in_polygons(spark, d)


@query(f"WITH {POLY} SELECT poly, count(*) AS cells, {R('sum(l.value)')} AS total, {R('avg(l.value)')} AS mean FROM inside JOIN (SELECT * FROM lights WHERE year = 2001) l USING (row, col) GROUP BY 1")
def polygon_sums(spark, d):
    """Sums and means of a layer over polygons."""
    x = cells_in_polygons(spark, d).join(v.lights(spark, d).where("year = 2001"), ["row", "col"])
    return x.groupBy("poly").agg(F.count("*").alias("cells"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


@query(f"WITH {POLY}, s AS (SELECT poly, year, avg(value) AS m FROM inside JOIN lights USING (row, col) GROUP BY 1, 2) SELECT poly, {R('arg_min(m, year)')} AS first, {R('arg_max(m, year)')} AS last, {R('arg_max(m, year) - arg_min(m, year)')} AS change FROM s GROUP BY 1")
def zone_series(spark, d):
    """A zone's mean in the first and the last year, and the change."""
    s = cells_in_polygons(spark, d).join(v.lights(spark, d), ["row", "col"]).groupBy("poly", "year").agg(F.avg("value").alias("m"))
    first, last = F.min_by("m", "year"), F.max_by("m", "year")
    return s.groupBy("poly").agg(first.alias("first"), last.alias("last"), (last - first).alias("change"))


@query(f"WITH s AS (SELECT year, sum(value) AS sol, CASE WHEN year <= 1998 THEN 'old' ELSE 'new' END AS version FROM lights GROUP BY year) SELECT version, min(year) AS first, max(year) AS last, {R('CASE WHEN arg_min(sol, year) > 0 AND max(year) > min(year) THEN (arg_max(sol, year) / arg_min(sol, year)) ** (1.0::DOUBLE / (max(year) - min(year))) - 1 END')} AS cagr FROM s GROUP BY 1")
def growth_by_version(spark, d):
    """Yearly growth of the sum of lights within each version of the product."""
    s = v.lights(spark, d).groupBy("year").agg(F.sum("value").alias("sol")).withColumn("version", F.when(F.col("year") <= 1998, "old").otherwise("new"))
    g = s.groupBy("version").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.min_by("sol", "year").alias("a"), F.max_by("sol", "year").alias("b"))
    years = F.col("last") - F.col("first")
    return g.select("version", "first", "last", F.when((F.col("a") > 0) & (years > 0), F.pow(F.col("b") / F.col("a"), 1 / years) - 1).alias("cagr"))


_CLS = "(CASE WHEN v1 >= 0.6 THEN 2 WHEN v1 >= 0.3 THEN 1 ELSE 0 END)"


@query(f"WITH {CHG} SELECT {_CLS}::BIGINT AS class, count(*) AS n, {R('avg(l.value)')} AS light, {R('avg(p.people)')} AS people FROM chg JOIN (SELECT * FROM lights WHERE year = 2001) l USING (row, col) JOIN (SELECT * FROM population WHERE year = 2001) p USING (row, col) GROUP BY 1")
def class_table(spark, d):
    """Means of layers over the classes of another."""
    x = chg(spark, d).join(v.lights(spark, d).where("year = 2001"), ["row", "col"]).join(v.population(spark, d).where("year = 2001").drop("year"), ["row", "col"])
    c = F.when(F.col("f1") >= 0.6, 2).when(F.col("f1") >= 0.3, 1).otherwise(0)
    return x.groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.avg("value").alias("light"), F.avg("people").alias("people"))


#: A surface's draws: its score and a noise that every engine has the same.
DRAW = "dr AS (SELECT k.k AS draw, s.row, s.col, round(0.7 * s.score + 0.3 * (((s.row * 50 + s.col + k.k * 3571) * 1103515245 + 12345) % 2147483648 % 10007) / 10007.0::DOUBLE, 9) AS score FROM surface s CROSS JOIN range(12) k(k))"


def noise(draw):
    return ((F.col("row") * 50 + F.col("col") + draw * 3571) * 1103515245 + 12345) % 2147483648 % 10007


def surfaces(spark, d):
    s = v.surface(spark, d).select("row", "col", "score", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("draw"))
    return s.select("draw", "row", "col", F.round(0.7 * F.col("score") + 0.3 * noise(F.col("draw")) / F.lit(10007.0), 9).alias("score"))


@query(f"WITH {DRAW} SELECT row, col, {R('avg(score)')} AS mean, {R('stddev_pop(score)')} AS spread FROM dr GROUP BY 1, 2")
def ensemble_surface(spark, d):
    return D.ensemble(surfaces(spark, d))


FREQ = f"{DRAW}, tk AS (SELECT row, col FROM dr QUALIFY row_number() OVER (PARTITION BY draw ORDER BY score DESC, row, col) <= 200), fq AS (SELECT c.row, c.col, count(t.row) / 12.0::DOUBLE AS p FROM cells c LEFT JOIN tk t ON t.row = c.row AND t.col = c.col GROUP BY 1, 2)"


def chances(spark, d):
    return D.frequency(D.top_by_draw(surfaces(spark, d), 200), v.grid(spark), 12)


@query(f"WITH {FREQ} SELECT row, col, {R('p')} AS p FROM fq")
def allocation_frequency(spark, d):
    """How often a cell is among the best of twelve draws."""
    return chances(spark, d)


@query(f"WITH {FREQ} SELECT row, col, {R('p')} AS p FROM fq ORDER BY p DESC, row, col LIMIT 200")
def consensus_prediction(spark, d):
    return D.consensus(chances(spark, d), 200)


@query(f"WITH {FREQ}, b AS (SELECT row, col FROM surface ORDER BY score DESC, row, col LIMIT 200) SELECT count(*) AS n, {R('avg((p >= 0.999)::INT)')} AS all_draws, {R('avg((p > 0.5)::INT)')} AS majority, {R('avg((p > 0)::INT)')} AS any_draw FROM b JOIN fq USING (row, col)")
def seed_agreement(spark, d):
    return D.agreement(chances(spark, d), v.surface(spark, d).orderBy(F.desc("score"), "row", "col").limit(200))


@query(f"""WITH {PRED}, n AS (SELECT count(*) FILTER (WHERE o) AS demand FROM pr), r AS (SELECT k.k AS draw, o, row_number() OVER (PARTITION BY k.k ORDER BY ((row * 50 + col + k.k * 3571) * 1103515245 + 12345) % 2147483648 % 10007 DESC, row, col) AS rn FROM pr CROSS JOIN range(20) k(k)),
h AS (SELECT draw, count(*) FILTER (WHERE o AND rn <= demand) AS hits FROM r, n GROUP BY 1) SELECT any_value(demand) AS demand, {R('avg(hits)')} AS mean_hits, {R('avg(coalesce(hits / nullif(hits + (demand - hits) * 2, 0), 0))')} AS mean_fom FROM h, n""")
def random_allocation(spark, d):
    """The observed number of cells placed at random, twenty times."""
    return D.random_baseline(scored(spark, d), F.col("o"), 20, noise)


@query(f"""WITH {PRED}, n AS (SELECT count(*) FILTER (WHERE o) AS k FROM pr), a AS (SELECT row, col, o, row_number() OVER (ORDER BY p DESC, row, col) <= k AS x, row_number() OVER (ORDER BY v0 DESC, row, col) <= k AS y FROM pr, n)
SELECT count(*) FILTER (WHERE x) AS demand, count(*) FILTER (WHERE x AND y) AS both, {R('count(*) FILTER (WHERE x AND y) / nullif(count(*) FILTER (WHERE x OR y), 0)')} AS fom FROM a""")
def projection_agreement(spark, d):
    """Two projections at equal demand."""
    s = scored(spark, d)
    n = s.agg(F.count_if("o").alias("k"))
    x = numbered(numbered(s, "p", ("row", "col"), "rx", descending=True), "f0", ("row", "col"), "ry", descending=True).join(F.broadcast(n))
    a, b = F.col("rx") <= F.col("k"), F.col("ry") <= F.col("k")
    return x.agg(F.count_if(a).alias("demand"), F.count_if(a & b).alias("both"), F.try_divide(F.count_if(a & b), F.count_if(a | b)).alias("fom"))


@query(f"""WITH {PRED}, b AS (SELECT block, p, o, rank() OVER (PARTITION BY block ORDER BY p) + (count(*) OVER (PARTITION BY block, p) - 1) / 2.0::DOUBLE AS r FROM pr), g AS (SELECT block, count(*) AS n, count(*) FILTER (WHERE o) AS n1, count(*) FILTER (WHERE NOT o) AS n0, sum(r) FILTER (WHERE o) AS s FROM b GROUP BY 1),
a AS (SELECT (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM g WHERE n >= 50 AND n1 > 0 AND n0 > 0) SELECT count(*) AS blocks, {R('avg(auc)')} AS mean, {R('stddev_pop(auc)')} AS sd, {R('min(auc)')} AS least FROM a""")
def block_auc_summary(spark, d):
    """AUC by block: mean, spread and least, of blocks of 50 rows and both classes."""
    a = K.roc_auc(scored(spark, d), "p", F.col("o"), ("block",)).where("n1 + n0 >= 50 AND n1 > 0 AND n0 > 0")
    return a.agg(F.count("*").alias("blocks"), F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"), F.min("auc").alias("least"))


_W7 = ", ".join(repr(i / 7) for i in range(1, 7))


@query(f"WITH {CHG}, q AS (SELECT list_sort(list_distinct(quantile_cont(v1, [{_W7}]))) AS b, quantile_cont(v1 - v0, 0.02) AS lo, quantile_cont(v1 - v0, 0.98) AS hi FROM chg) SELECT {R('b[1]')} AS first_break, {R('b[len(b)]')} AS last_break, len(b) AS breaks, {R('greatest(abs(lo), abs(hi))')} AS diverging_limit FROM q")
def class_breaks(spark, d):
    """Quantile breaks of seven classes, and a symmetric limit for a diverging scale."""
    c = chg(spark, d)
    b = percentiles(c, F.col("f1"), [i / 7 for i in range(1, 7)]).select(F.array_sort(F.array_distinct("q")).alias("b"))
    e = percentiles(c, F.col("delta"), [0.02, 0.98])
    lo, hi = F.abs(F.col("q")[0]), F.abs(F.col("q")[1])
    return b.join(F.broadcast(e)).select(F.col("b")[0].alias("first_break"), F.element_at("b", -1).alias("last_break"), F.size("b").alias("breaks"), F.greatest(lo, hi).alias("diverging_limit"))


@query("SELECT event_id, (least(2020, (1990 + event_id % 40) // 5 * 5))::BIGINT AS epoch, (strftime(make_date((1990 + event_id % 40)::INT - 1, (1 + event_id % 12)::INT, 1), '%Y-%m-%d')) AS first, strftime(last_day(make_date((1990 + event_id % 40)::INT, (1 + event_id % 12)::INT, 1)), '%Y-%m-%d') AS last FROM events", with_views=False)
def month_windows(spark, d):
    """The epoch of a year, and a season's window from the first day of a month to the last day of another."""
    e = v.table(spark, d, "events").select("event_id", (1990 + F.col("event_id") % 40).cast("int").alias("y"), (1 + F.col("event_id") % 12).cast("int").alias("m"))
    first, last = X.month_window(F.col("y"), F.col("m"), F.col("m"))
    return e.select("event_id", X.epoch_at(F.col("y")).alias("epoch"), first.alias("first"), last.alias("last"))


@query("""WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events) SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS utc, strftime(t + INTERVAL 330 MINUTE - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc2 FROM e""", with_views=False)
def date_parsing(spark, d):
    """Two forms of dates, read to UTC."""
    t = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    e = v.table(spark, d, "events").select("event_id", F.date_format(t, "yyyyMMdd'T'HHmmss'Z'").alias("a"), F.concat(F.date_format(t + F.expr("INTERVAL 330 MINUTE"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0530")).alias("b"))
    return e.select("event_id", TX.utc(F.col("a")).alias("utc"), TX.utc(F.col("b")).alias("utc2"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS loc, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, trim(regexp_replace(lower(loc), '[^a-z0-9]+', ' ', 'g')) AS norm, array_to_string(list_filter(list_transform(list_slice(regexp_split_to_array(loc, '\\s*(?:-|–|,|/|\\bto\\b|\\band\\b)\\s*'), 1, 3), lambda x: trim(x)), lambda x: len(x) >= 3), '|') AS places,
CASE WHEN ends_with(loc, ' - ' || host) THEN left(loc, len(loc) - len(host) - 3) ELSE loc END AS headline FROM t""", with_views=False)
def place_names(spark, d):
    """Titles of pages read as locations: normalised, split into places, without their source."""
    x = v.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("loc"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return x.select("page_id", TX.normal_place(F.col("loc")).alias("norm"), F.array_join(TX.places(F.col("loc")), "|").alias("places"), TX.without_source(F.col("loc"), F.col("host")).alias("headline"))


GAZETTEER = """an AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/[^"]*">([^<]+)</a>', 1)) AS name FROM pages UNION ALL SELECT page_id, array_to_string(list_slice(string_split(trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')), ' '), 1, 2), ' ') FROM pages),
nm AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS gram, page_id AS place FROM an WHERE length(name) >= 5),
ix AS (SELECT gram, len(string_split(gram, ' ')) AS words, min(place) AS place, count(*) >= 3 AND count(*) >= 0.018 * (SELECT count(DISTINCT place) FROM nm WHERE gram <> '') AS whole FROM nm WHERE gram <> '' GROUP BY gram)"""


def gazetteer(spark, d):
    """Places are pages; their names are what their links say, and the first two words of their titles."""
    p = v.table(spark, d, "pages")
    title = F.array_join(F.slice(F.split(TX.normal_place(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), " "), 1, 2), " ")
    names = F.concat(F.regexp_extract_all("html", F.lit('<a href="/[^"]*">([^<]+)</a>'), F.lit(1)), F.array(title))
    return Z.alias_index(p.select(F.explode(names).alias("name"), F.col("page_id").alias("place")).where(F.length("name") >= 5), 0.018, 3)


@query(f"""WITH {GAZETTEER}, tw AS (SELECT doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
tg AS (SELECT id, s.n AS words, unnest(range(0, len(w) - s.n + 1)) AS pos, w FROM tw, (SELECT DISTINCT words AS n FROM ix) s),
tm AS (SELECT id, pos, tg.words, gram, place, whole FROM tg JOIN ix ON ix.words = tg.words AND ix.gram = array_to_string(list_slice(w, pos + 1, pos + tg.words), ' ')),
tf AS (SELECT * FROM tm QUALIFY pos >= coalesce(max(pos + words) OVER (PARTITION BY id ORDER BY pos, words DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
td AS (SELECT id, gram, count(*) AS k, min(pos) AS pos, any_value(place) AS place, any_value(whole) AS whole FROM tf GROUP BY 1, 2),
tl AS (SELECT id, sum(k)::BIGINT AS names, coalesce(sum(k) FILTER (WHERE NOT whole), 0)::BIGINT AS local, list(gram ORDER BY pos) FILTER (WHERE NOT whole) AS g, arg_min(place, pos) FILTER (WHERE NOT whole) AS place FROM td GROUP BY 1)
SELECT doc_id AS id, coalesce(names, 0) AS names, coalesce(local, 0) AS local, coalesce(names > 0 AND local = 0, false) AS citywide, array_to_string(list_slice(g, 1, 3), '|') AS places, coalesce(place, -1) AS place FROM documents LEFT JOIN tl ON id = doc_id""", with_views=False)
def text_locations(spark, d):
    """Names of places in whole documents, and whether a document names only the whole city."""
    x = Z.locations(v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), gazetteer(spark, d))
    return x.withColumns({"places": F.when(F.col("places") != "", F.col("places")), "place": F.coalesce("place", F.lit(-1))})


#: What outputs don't carry besides parties: holders of licences that texts of the tables name.
HOLDERS = (*TX.PARTIES, "Apache License", "MIT License", "GNU General Public License")


@query(f"""WITH r AS (SELECT doc_id, text AS s, regexp_replace(text, '(^|[^A-Za-z])({TX.alternatives(HOLDERS)})($|[^A-Za-z])', '\\1[party]\\3', 'g') AS a FROM documents)
SELECT doc_id, length(a) AS n_chars, (length(a) - length(replace(a, '[party]', ''))) // 7 AS names, a <> s AS flagged, sha256(regexp_replace(a, '\\b({TX.ROLES})\\b', 'an official', 'gi')) AS neutral_sha256 FROM r""", with_views=False)
def redaction(spark, d):
    """Whole documents with the names of parties, holders and roles replaced: how many names there were, and what is left."""
    x = v.table(spark, d, "documents").select("doc_id", F.col("text").alias("s"), TX.redact(F.col("text"), HOLDERS).alias("a"))
    names = F.floor((F.length("a") - F.length(F.replace("a", F.lit("[party]"), F.lit("")))) / 7)
    return x.select("doc_id", F.length("a").cast("long").alias("n_chars"), names.alias("names"), (F.col("a") != F.col("s")).alias("flagged"), F.sha2(TX.without_roles(F.col("a")), 256).alias("neutral_sha256"))


@query(f"""WITH a AS (SELECT event_id, (value - 50) / 50 AS x, (value - 50) / 50 * (1 + ((event_id % 9) - 4) / 10.0::DOUBLE) * (CASE WHEN event_id % 11 = 0 THEN -1 ELSE 1 END) AS y FROM events), s AS (SELECT (x = 0 AND y = 0) OR (sign(x) = sign(y) AND abs(x - y) <= 0.25 * greatest(abs(x), abs(y))) AS same, x = y AS identical FROM a)
SELECT count(*) AS tested, count(*) FILTER (WHERE identical) AS identical, {R('avg(identical::INT)')} AS invariance, {R('avg(same::INT)')} AS score_invariance FROM s""", with_views=False)
def audit_shares(spark, d):
    """Shares of cases read the same twice, and of those scored the same."""
    x = (F.col("value") - 50) / 50
    y = x * (1 + (F.col("event_id") % 9 - 4) / F.lit(10.0)) * F.when(F.col("event_id") % 11 == 0, -1).otherwise(1)
    return TX.audit(v.table(spark, d, "events").select(x.alias("x"), y.alias("y")))


@query(f"""WITH al AS (SELECT * FROM (VALUES ('AUTOMOBILE', 'vehicles'), ('MACHINERY', 'industry'), ('BUILDING', 'industry'), ('FURNITURE', 'homes')) t(a, name)) SELECT coalesce(name, lower(c_mktsegment)) AS name, count(*) AS n, {R('round(sum(c_acctbal), 2)')} AS total FROM customer LEFT JOIN al ON a = c_mktsegment GROUP BY 1""", with_views=False)
def alias_join(spark, d):
    """Names through a table of aliases; what then has one name is summed."""
    return V.by_alias(v.table(spark, d, "customer"), "c_mktsegment", {"AUTOMOBILE": "vehicles", "MACHINERY": "industry", "BUILDING": "industry", "FURNITURE": "homes"}, "c_acctbal")


@query(f"""WITH e AS (SELECT event_id, (user_id % 6 + 75.0::DOUBLE) + (event_id % 100) / 100.0::DOUBLE AS lon, (event_id % 60 - 30) * 1.0::DOUBLE + 0.25 AS lat FROM events), t AS (SELECT event_id, lon, lat FROM e)
SELECT event_id, {R('6371007.181 * sqrt(2) * 2 / pi() * radians(lon) * cos(th)')} AS x, {R('6371007.181 * sqrt(2) * sin(th)')} AS y FROM (SELECT event_id, lon, lat, {TX.mollweide_theta_sql('radians(lat)')} AS th FROM t)""", with_views=False)
def mollweide(spark, d):
    """Longitude and latitude in the equal-area projection."""
    e = v.table(spark, d, "events").select("event_id", (F.col("user_id") % 6 + 75.0 + (F.col("event_id") % 100) / F.lit(100.0)).alias("lon"), ((F.col("event_id") % 60 - 30) * 1.0 + 0.25).alias("lat"))
    x, y = X.mollweide(F.col("lon"), F.col("lat"))
    return e.select("event_id", x.alias("x"), y.alias("y"))


@query(f"WITH {LT}, x AS (SELECT row, col, value AS v, p.people AS w FROM lights JOIN population p USING (row, col, year) WHERE year = 2001), m AS (SELECT avg(v) AS mv, stddev_pop(v) AS sv, avg(w) AS mw, stddev_pop(w) AS sw FROM x) SELECT count(*) AS n, {R('corr(v, w)')} AS r, {R('avg((v - mv) / sv * (w - mw) / sw)')} AS standardised FROM x, m")
def standardised_pair(spark, d):
    """Two channels, standardised, and their correlation."""
    x = v.lights(spark, d).join(v.population(spark, d), ["row", "col", "year"]).where("year = 2001")
    m = x.agg(F.avg("value").alias("mv"), F.stddev_pop("value").alias("sv"), F.avg("people").alias("mw"), F.stddev_pop("people").alias("sw"))
    z = (F.col("value") - F.col("mv")) / F.col("sv") * (F.col("people") - F.col("mw")) / F.col("sw")
    return x.join(F.broadcast(m)).agg(F.count("*").alias("n"), F.corr("value", "people").alias("r"), F.avg(z).alias("standardised"))
