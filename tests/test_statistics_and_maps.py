"""Tails, projections, clipping, look-ups, bags and scans against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citygrid.functions import exprs as X
from citygrid.operators import layers as L
from citygrid.operators import learning as M
from citygrid.operators import order as O
from citygrid.operators import scoring as K
from citygrid.operators import stencil as S
from citygrid.operators import storage
from citygrid.operators import tiles as Q
from citygrid.sources import scenes as Z


def t_tail(t, df, steps=3_000_000):
    a = math.atan(abs(t) / math.sqrt(df))
    integral = lambda lo: (np.cos(lo + (math.pi / 2 - lo) * (np.arange(steps) + 0.5) / steps) ** (df - 1)).sum() * (math.pi / 2 - lo)
    return integral(a) / integral(0)


@pytest.mark.parametrize(("t", "df"), [(2.0, 61), (2.0, 60), (2.0, 59), (0.5, 2498), (-3.0, 2498), (1.3, 2.5), (2.2, 7.75), (1.96, 100_000), (0.0, 100), (12.0, 400)])
def test_student_tail_of_any_degrees_of_freedom(spark, t, df):
    p = spark.range(1).select(X.student_p(F.lit(t), F.lit(float(df)))).first()[0]
    assert p == pytest.approx(t_tail(t, df), rel=1e-6, abs=1e-12)


def test_tails_and_gamma(spark):
    z = [-8.0, -3.999, -1.0, 0.0, 1e-9, 0.5, 2.0, 3.999, 4.0, 4.001, 8.0, 30.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", X.normal_tail(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)) / 2, rel=1e-9)
    x = [1e-3, 0.5, 1.0, 2.5, 7.0, 100.25, 1e6]
    for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", X.log_gamma(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-10, abs=1e-10)


def test_rank_sums_tell_shifted_samples_apart(spark):
    rnd = np.random.default_rng(1)
    rows = [("shift", float(x), True) for x in rnd.normal(1, 1, 300)] + [("shift", float(x), False) for x in rnd.normal(0, 1, 300)] + [("few", 1.0, True), ("few", 2.0, False)]
    df = spark.createDataFrame(rows, "k string, v double, o boolean")
    r = {x["k"]: x for x in K.mann_whitney(df, "v", F.col("o"), ("k",)).collect()}
    assert r["shift"]["p"] < 1e-3 and r["shift"]["effect"] > 0.6 and r["few"]["p"] is None
    assert K.mann_whitney(df.where("k = 'shift'"), "v", ~F.col("o")).first()["p"] > 0.5


def test_fits_of_many_groups_at_once(spark):
    rnd = random.Random(2)
    rows = [(k, x := rnd.uniform(1, 50), 3 * x**e * math.exp(rnd.gauss(0, 0.05))) for k, e in (("a", 0.7), ("b", -1.2)) for _ in range(400)] + [("c", 1.0, 1.0), ("a", -1.0, 2.0), ("a", None, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    fit = {r["k"]: r for r in K.loglog(df, "x", "y", ("k",)).collect()}
    assert fit["a"]["elasticity"] == pytest.approx(0.7, abs=0.02) and fit["b"]["elasticity"] == pytest.approx(-1.2, abs=0.02) and fit["c"]["elasticity"] is None
    assert fit["a"]["n"] == 400 and fit["a"]["p"] < 1e-9
    rho = {r["k"]: r["rho"] for r in K.spearman(df, "x", "y", ("k",)).collect()}
    assert rho["a"] > 0.95 and rho["b"] < -0.95 and rho["c"] is None


@pytest.mark.parametrize(("lon", "lat"), [(77.2, 28.6), (82.97, 25.3), (-46.6, -23.5), (3.0, 0.0), (5.999, 71.0), (-0.001, -60.0)])
def test_transverse_mercator_returns(spark, lon, lat):
    zone, south = math.floor((lon + 180) / 6) + 1, lat < 0
    x, y = X.utm(F.lit(lon), F.lit(lat), F.lit(zone), F.lit(south))
    e = spark.range(1).select(x.alias("x"), y.alias("y"))
    lo, la = X.utm_back(F.col("x"), F.col("y"), F.lit(zone), F.lit(south))
    r = e.select("x", "y", lo.alias("lon"), la.alias("lat")).first()
    assert r["lon"] == pytest.approx(lon, abs=1e-9) and r["lat"] == pytest.approx(lat, abs=1e-9)  # a tenth of a millimetre
    assert 160_000 < r["x"] < 840_000 and 0 <= r["y"] < 10_000_000


def clipped(poly, row, col):
    """Area of a polygon in a cell, by cutting it at the cell's four sides."""
    for side in (lambda p: p[0] - col, lambda p: col + 1 - p[0], lambda p: p[1] - row, lambda p: row + 1 - p[1]):
        out = []
        for a, b in zip(poly, poly[1:] + poly[:1]):
            s, t = side(a), side(b)
            if s >= 0:
                out.append(a)
            if (s >= 0) != (t >= 0):
                out.append((a[0] + (b[0] - a[0]) * s / (s - t), a[1] + (b[1] - a[1]) * s / (s - t)))
        poly = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1]))) / 2 if poly else 0.0


def test_shares_of_cells(spark):
    rnd = random.Random(4)
    polys = [[(2.5, 2.5), (7.25, 2.5), (7.25, 6.0), (2.5, 6.0)], [(0.0, 0.0), (9.0, 1.0), (4.0, 4.0), (8.0, 9.5), (1.0, 6.0)], [(-3.0, -2.0), (5.0, 5.0), (-1.0, 14.0)], [(1.0, 1.0), (1.0, 3.0), (4.0, 3.0), (4.0, 1.0)]]
    polys += [[(5 + rnd.uniform(1, 6) * math.cos(k), 5 + rnd.uniform(1, 6) * math.sin(k)) for k in np.linspace(0, 6, 9)] for _ in range(4)]
    edges = [(i, *a, *b) for i, p in enumerate(polys) for a, b in zip(p, p[1:] + p[:1])]
    got = {(r["poly"], r["row"], r["col"]): r["share"] for r in Q.cell_shares(spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double"), 10, 10).collect()}
    for i, p in enumerate(polys):
        for row in range(10):
            for col in range(10):
                assert got.get((i, row, col), 0.0) == pytest.approx(clipped(p, row, col), abs=1e-8)


def lattice(spark, n, m, f):
    return spark.createDataFrame([(r, c, f(r, c)) for r in range(n) for c in range(m)], "row long, col long, v double")


def test_box_means_are_those_of_the_stencil(spark):
    rnd = random.Random(6)
    x = lattice(spark, 17, 11, lambda r, c: None if (r + c) % 7 == 0 else rnd.random())
    got = {(r["row"], r["col"], r["radius"]): r["v"] for r in S.box_means(x, ["v"], [0, 1, 4, 30], 17, 11).collect()}
    assert len(got) == 17 * 11 * 4
    for radius in (1, 4):
        for r in S.stencil(x, "v", S.square(radius), 17, 11).collect():
            n = sum(0 <= r["row"] + i < 17 and 0 <= r["col"] + j < 11 for i in range(-radius, radius + 1) for j in range(-radius, radius + 1))
            assert got[r["row"], r["col"], radius] == pytest.approx(r["total"] / n)
    assert got[0, 0, 30] == pytest.approx(got[16, 10, 30])


@pytest.mark.parametrize("share", [0.0, 0.002, 0.02, 0.3, 1.0])
def test_distances_by_the_envelope(spark, share):
    rnd = random.Random(8)
    flag = {(r, c): rnd.random() < share for r in range(23) for c in range(31)}
    flag[5, 7] = flag[5, 7] or share > 0
    df = spark.createDataFrame([(r, c, f) for (r, c), f in flag.items()], "row int, col int, f boolean")
    on = [k for k, f in flag.items() if f]
    for r in S.nearest_distance(df, "f", 0.5, 9.0).collect():
        want = min((math.hypot(r["row"] - a, r["col"] - b) for a, b in on), default=None)
        assert r["km"] == pytest.approx(99.0 if want is None else min(9.0, want * 0.5))


def test_many_ranges_and_many_best_rows(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, i % 13, rnd.choice([0.0, rnd.randrange(500) / 7])) for i in range(3000)]
    df = spark.createDataFrame(rows, "row long, col long, v double")
    monkeypatch.setattr(O, "SHARE", 40)
    monkeypatch.setattr(O, "FEW", 10)
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    got = {(r["row"], r["col"]): r["n"] for r in O.numbered(df, "v", ("row", "col"), "n", descending=True).collect()}
    assert all(got[r[0], r[1]] == i for i, r in enumerate(want, 1))
    assert {(r["row"], r["col"]) for r in O.best(df, "v", ("row", "col"), 1234).collect()} == {r[:2] for r in want[:1234]}
    v = sorted(r[2] for r in rows)
    q = O.percentiles(df, F.col("v"), [0, 0.3, 0.9, 1]).first()["q"]
    assert q == pytest.approx(list(np.quantile(v, [0, 0.3, 0.9, 1])))


def test_thresholds_of_equal_area(spark):
    rows = [("a", float(i // 3)) for i in range(30)] + [("b", float(i)) for i in range(30)] + [("b", None)]
    area = spark.createDataFrame([(10,)], "n long")
    got = {r["map"]: r["least"] for r in K.at_area(spark.createDataFrame(rows, "map string, v double"), "v", area, ("map",)).collect()}
    assert got == {"a": 6.0, "b": 20.0}


def test_bags(spark):
    rnd = random.Random(3)
    rows = [(i // 40, i % 40, x := rnd.random(), rnd.random(), float(x > 0.6)) for i in range(1600)]
    df = spark.createDataFrame(rows, "row long, col long, a double, b double, label double")
    n = df.select(M.poisson_bag(1).alias("k")).groupBy("k").count().collect()
    share = {r["k"]: r["count"] / 1600 for r in n}
    assert share[0] == pytest.approx(math.exp(-1), abs=0.04) and share[2] == pytest.approx(math.exp(-1) / 2, abs=0.04) and sum(k * s for k, s in share.items()) == pytest.approx(1, abs=0.1)
    from pyspark.ml.feature import VectorAssembler

    x = storage.cut(VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(M.balanced(df)))
    bagged = M.Bagged(x, "x", trees=8, bags=4)
    out = bagged.chances(x, unseen=True).collect()
    drawn = df.select("row", "col", *[M.poisson_bag(i).alias(f"k{i}") for i in range(4)]).collect()
    never = {(r["row"], r["col"]) for r in drawn if min(r[f"k{i}"] for i in range(4)) > 0}
    assert {(r["row"], r["col"]) for r in out if r["p"] is None} == never and never
    good = [r for r in out if r["p"] is not None]
    assert np.mean([(r["p"] > 0.5) == (r["label"] == 1) for r in good]) > 0.95


def test_fewer_negatives_and_too_few_labels(spark):
    df = spark.createDataFrame([(i, 0, float(i % 10 == 0)) for i in range(1000)], "row long, col long, label double")
    some = M.fewer_negatives(df, 100)
    g = {r["label"]: (r["n"], r["w"]) for r in some.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert g == {1.0: (100, 100.0), 0.0: (100, pytest.approx(900.0))}
    w = {r["label"]: r["w"] for r in M.balanced(some, weight="weight").groupBy("label").agg(F.sum("w").alias("w")).collect()}
    assert w[0.0] == pytest.approx(w[1.0])
    assert M.fewer_negatives(df, 5000).count() == 1000
    for bad in (df.where("label = 1"), df.where("label = 0"), df.limit(0), df.where("row < 50")):
        with pytest.raises(M.TooFewLabels):
            M.balanced(bad)


def test_models_of_too_few_labels_are_null(spark):
    from citygrid.plans import models as P

    @P.few_labels_as_null("n long, auc double")
    def query(s, d):
        raise M.TooFewLabels("none")

    assert [tuple(r) for r in query(spark, "").collect()] == [(None, None)]


def test_heat_without_enough_rural_cells_is_null(spark):
    from citygrid.operators.change import heat_island

    x = spark.createDataFrame([(i, 0, 20.0 + i, i < 4) for i in range(10)], "row long, col long, t double, r boolean")
    assert {r["intensity"] for r in heat_island(x, "t", F.col("r"), least=5).collect()} == {None}
    assert {r["row"]: r["intensity"] for r in heat_island(x, "t", F.col("r"), least=4).collect()}[9] == 7.5
    assert heat_island(x, "t", F.col("row") < 0, least=1).where("hotspot").count() == 0


def test_channels_without_a_date_are_null(spark):
    rows = [(0, 0, True, *[0.1 * k for k in range(6)]), (0, 0, True, *[0.3 * k for k in range(6)]), (0, 0, False, *[0.1] * 6), (1, 1, True, *[0.2] * 6)]
    df = spark.createDataFrame(rows, "row long, col long, now boolean, " + ", ".join(f"{b} double" for b in L.BANDS))
    got = {(r["row"], r["col"]): r for r in L.channel_stack(df, F.col("now")).collect()}
    a = got[0, 0]
    assert len(a) == 32 and a["green_t"] == pytest.approx(0.2) and a["nir_change"] == pytest.approx(0.5) and a["brightness_t"] == pytest.approx(0.5) and a["ndvi_change"] == pytest.approx(0.2)
    assert got[1, 1]["ndvi_t"] == 0 and all(got[1, 1][k] is None for k in ("blue_prev", "ndvi_prev", "brightness_change"))


def test_smoothing_without_counting_gaps(spark):
    x = lattice(spark, 12, 12, lambda r, c: None if 3 <= r <= 8 and c < 6 else 5.0)
    got = [r["smooth"] for r in S.gaussian_ignoring_nulls(x, "v", 0.8, 12, 12).collect()]
    assert all(s is None or s == pytest.approx(5.0) for s in got) and sum(s is not None for s in got) > 108
    assert {r["smooth"] for r in S.gaussian_ignoring_nulls(lattice(spark, 5, 5, lambda r, c: None), "v", 1.0, 5, 5).collect()} == {None}


def test_scans_by_the_curve(spark, tmp_path):
    bounds = (5, 22, 9, 30)
    key = lambda r, c: sum(((r >> i) & 1) << (2 * i + 1) | ((c >> i) & 1) << (2 * i) for i in range(10))
    for most in (1, 4, 16, 1000):
        ranges = Z.key_ranges(*bounds, most=most)
        assert len(ranges) <= most and all(any(lo <= key(r, c) <= hi for lo, hi in ranges) for r in range(5, 23) for c in range(9, 31))
    exact = Z.key_ranges(*bounds, most=1000)
    assert sum(hi - lo + 1 for lo, hi in exact) == 18 * 22
    rows = [(i, i % 64, (i * 7) % 61, f"2024-01-{1 + i % 28:02d}", float(i % 101)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, row long, col long, day string, cloud double").withColumn("day", F.to_date("day"))
    path = f"file://{tmp_path}/scenes"
    Z.write_scenes(df, path, 8)
    found = Z.scan_scenes(spark, path, bounds, ("2024-01-05", "2024-01-09"), 40.0)
    want = {r[0] for r in rows if 5 <= r[1] <= 22 and 9 <= r[2] <= 30 and "2024-01-05" <= r[3] <= "2024-01-09" and r[4] <= 40}
    assert {r["id"] for r in found.collect()} == want and want
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = Z.scan_scenes(spark, path, bounds, ("2024-01-05", "2024-01-09"), 40.0)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key," in pushed and "LessThanOrEqual(cloud,40.0)" in pushed and "GreaterThanOrEqual(day," in pushed


def test_tables_are_cleared(spark):
    storage.cut(spark.range(3)).count()
    t = storage.cut(spark.range(5))
    assert storage.clear(spark) >= 2 and storage.clear(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(*t.inputFiles()).count()


def test_places_in_whole_texts(spark):
    from citygrid.operators import gazetteer as G

    names = [("Outer Ring Road", 7), ("Ring Road", 8), ("Hebbal", 3), ("hebbal!", 2), ("Delhi–NCR", 1), ("Delhi NCR", 2), ("delhi ncr", 3), (" - ", 9), (None, 4), ("Road", 5)]
    index = G.alias_index(spark.createDataFrame(names, "name string, place long"), 0.3, 3)
    assert {r["gram"]: (r["words"], r["place"], r["whole"]) for r in index.collect()} == {
        "outer ring road": (3, 7, False), "ring road": (2, 8, False), "hebbal": (1, 2, False), "delhi ncr": (2, 1, True), "road": (1, 5, False),
    }
    texts = {
        1: "From HEBBAL to the outer ring-road; Hebbal again, and the ring road.", 2: "Rs 900 crore in Delhi-NCR", 3: "", 4: None, 5: "road " * 5000 + "hebbal", 6: "nothing", 7: "Delhi/NCR, Outer Road",
    }
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in G.locations(df, index).collect()}
    assert got == {
        1: (4, 4, False, "hebbal|outer ring road|ring road", 2), 2: (1, 0, True, "", None), 3: (0, 0, False, None, None), 4: (0, 0, False, None, None), 5: (5001, 5001, False, "road|hebbal", 5),
        6: (0, 0, False, None, None), 7: (2, 1, False, "road", 5),
    }
    assert {r["place"] for r in G.locations(df.where("id = 1"), index).collect()} == {2}
    assert G.locations(df.limit(0), index).count() == 0 and G.names_in(df, index.limit(0)).count() == 0


def test_names_are_found_in_one_pass(spark, monkeypatch):
    """Texts were normalised and cut into grams anew for each size of names."""
    from citygrid.operators import gazetteer as G

    names = [("a", 1), ("a b", 2), ("b c d", 3), ("c d", 4), ("d e f g h i j k", 5), ("k k", 6), ("z", 7)]
    index = G.alias_index(spark.createDataFrame(names, "name string, place long"), 2.0, 3)
    df = spark.createDataFrame([(1, "A b c d e f g h i j k k k"), (2, "c d. b, c d"), (3, "k k k k k z"), (4, "x"), (5, None), (6, "a"), (7, "x d e f g h i j k")], "id long, text string")
    rows = lambda: sorted(map(tuple, G.names_in(df, index).select("id", "pos", "words", "gram", "place").collect()))
    got = rows()
    assert got == [
        (1, 0, 2, "a b", 2), (2, 0, 2, "c d", 4), (2, 2, 3, "b c d", 3), (3, 0, 2, "k k", 6), (3, 5, 1, "z", 7), (6, 0, 1, "a", 1), (7, 1, 8, "d e f g h i j k", 5),
    ]
    plan = G.names_in(df, index.where(f"words <= {G.SHORT}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    monkeypatch.setattr(G, "LISTED", 2)
    assert rows() == got


def test_names_of_ones_own_are_redacted(spark):
    from citygrid.functions import texts as TX

    row = spark.createDataFrame([("The Apache License and BJP; Apache Licensed",)], "s string").select(TX.redact(F.col("s"), ("Apache License",)).alias("a"), TX.redact(F.col("s")).alias("b")).first()
    assert row["a"] == "The [party] and BJP; Apache Licensed" and row["b"] == "The Apache License and [party]; Apache Licensed"


def test_areas_of_interest_and_their_grids(spark):
    rows = [(1, 77.0, 28.4, 77.4, 28.9), (2, 82.9, 25.2, 82.95, 25.25), (3, -48.0, -25.0, -44.0, -22.0)]
    a = {r["k"]: r for r in Q.areas_of_interest(spark.createDataFrame(rows, "k long, lon0 double, lat0 double, lon1 double, lat1 double"), "k").collect()}
    assert [a[k]["epsg"] for k in (1, 2, 3)] == [32643, 32644, 32723] and a[2]["buffer_km"] == 3.0 and a[3]["buffer_km"] == 8.0
    assert a[1]["buffer_km"] == pytest.approx(0.15 * 0.5 * 111.32) and (a[3]["lat1"] - a[3]["lat0"]) * 111.32 == pytest.approx(80)
    cells = Q.grid_cells(Q.areas_of_interest(spark.createDataFrame(rows, "k long, lon0 double, lat0 double, lon1 double, lat1 double"), "k"), "k", 5000.0).collect()
    for k in (1, 2, 3):
        mine = [r for r in cells if r["k"] == k]
        w, h = max(r["col"] for r in mine) + 1, max(r["row"] for r in mine) + 1
        assert sorted(r["cell_id"] for r in mine) == list(range(w * h)) and all(r["x"] % 5000 == 2500 and r["y"] % 5000 == 2500 for r in mine)
        # the frame holds the area: the outermost centres are at most half a cell inside of it
        half = 2.6 / 111
        assert min(r["lat"] for r in mine) < a[k]["lat0"] + half and max(r["lat"] for r in mine) > a[k]["lat1"] - half
        assert max(mine, key=lambda r: r["y"])["row"] == 0


def test_rings_as_far_as_the_cells_reach(spark):
    from citygrid.operators.change import radial_profile

    x = spark.createDataFrame([(float(i), i / 10) for i in range(100)], "v double, km double")
    assert [(r["ring"], r["n"]) for r in radial_profile(x, F.col("v"), F.col("km"), 1.0).orderBy("ring").collect()] == [(i, 10) for i in range(10)]
    assert radial_profile(x, F.col("v"), F.col("km"), 4.0).count() == 3 and radial_profile(x.limit(0), F.col("v"), F.col("km"), 1.0).count() == 0
