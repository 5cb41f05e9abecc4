"""Small fixtures for the engine's operators."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from citygrid.functions import exprs as X
from citygrid.functions import texts as TX
from citygrid.operators import activity as A
from citygrid.operators import change as C
from citygrid.operators import draws as D
from citygrid.operators import growth as G
from citygrid.operators import layers as L
from citygrid.operators import learning as M
from citygrid.operators import news as W
from citygrid.operators import order as O
from citygrid.operators import reduce as B
from citygrid.operators import scoring as K
from citygrid.operators import stencil as S
from citygrid.operators import tiles as Q
from citygrid.operators import trend as T
from citygrid.operators import zones as Z


def layer(spark, rows, cols, f, kind="double"):
    return spark.createDataFrame([(i, j, f(i, j)) for i in range(rows) for j in range(cols)], f"row long, col long, v {kind}")


def test_block_sum_keeps_total_and_ragged_edges(spark):
    out = B.block_reduce(layer(spark, 7, 8, lambda i, j: 1.0), 5, {"v": "sum"}).collect()
    assert len(out) == 4 and sum(r["v"] for r in out) == 56


def test_majority_and_priority(spark):
    x = layer(spark, 5, 5, lambda i, j: 4 if (i, j) == (2, 2) else 0, "int")
    got = B.block_reduce(x.withColumn("p", F.col("v")), 5, {"v": "majority", "p": "priority"}, {"p": [4, 5, 3, 2, 1, 0]}).first()
    assert (got["v"], got["p"]) == (0, 4)
    x = layer(spark, 5, 5, lambda i, j: {(0, 0): 2, (4, 4): 4}.get((i, j), 0), "int")
    assert B.block_reduce(x, 5, {"v": "priority"}, {"v": [4, 5, 3, 2, 1, 0]}).first()["v"] == 4
    tie = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (1, 0, 3), (1, 1, 2)], "row long, col long, v int")
    assert B.block_reduce(tie, 2, {"v": "majority"}).first()["v"] == 2


def test_factor_one_and_unknown_reducer(spark):
    x = layer(spark, 2, 2, lambda i, j: float(i))
    assert B.block_reduce(x, 1, {"v": "sum"}).count() == 4
    with pytest.raises(ValueError):
        B.block_reduce(x, 2, {"v": "median"})


def test_null_means(spark):
    x = layer(spark, 2, 2, lambda i, j: None if i else 4.0).withColumn("w", F.col("v"))
    got = B.block_reduce(x, 2, {"v": "mean", "w": "mean0"}).first()
    assert (got["v"], got["w"]) == (4.0, 2.0)


def test_built_change_needs_crossing_and_gain(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.5), (0, 1, 0.19, 0.205), (0, 2, 0.5, 0.6), (0, 3, None, 0.3)], "row long, col long, v0 double, v1 double")
    assert [r["new_urban"] for r in C.built_change(p, 0.2, 0.1).orderBy("col").collect()] == [True, False, False, True]


def test_expansion_form(spark):
    block = lambda i, j: 5 <= i <= 24 and 5 <= j <= 24
    new = {(25, 10), (26, 10), (50, 50)}
    x = spark.createDataFrame([(i, j, block(i, j), (i, j) in new) for i in range(60) for j in range(60)], "row long, col long, was_urban boolean, new_urban boolean")
    got = {(r["row"], r["col"]): r["form"] for r in C.expansion_form(x, 10, 60, 60).where("form > 0").collect()}
    assert got == {(25, 10): 2, (26, 10): 2, (50, 50): 3}


def test_trend_slope_perfect_fit_and_short_series(spark):
    x = spark.createDataFrame([(0, 0, y, 2.0 * (y - 2013) + 1) for y in range(2013, 2023)] + [(0, 1, 2013, 1.0), (0, 1, 2014, 2.0)] + [(0, 2, y, 3.0) for y in range(2013, 2023)], "row long, col long, year long, value double")
    a, b, c = T.trend(x).orderBy("col").collect()
    assert a["slope"] == pytest.approx(2) and a["intercept"] == pytest.approx(-4025) and a["p"] == 0
    assert b["slope"] is None and b["p"] is None
    assert c["slope"] == 0 and c["p"] == 1


def test_student_tail(spark):
    got = spark.range(1).select(X.student_p(F.lit(2.571), F.lit(5)).alias("a"), X.student_p(F.lit(2.228), F.lit(10)).alias("b"), X.student_p(F.lit(12.706), F.lit(1)).alias("c"), X.student_p(F.lit(1.9623), F.lit(1000)).alias("d")).first()
    assert all(abs(p - 0.05) < 2e-4 for p in got)


def test_relative_series_cancels_steps(spark):
    x = spark.createDataFrame([(0, j, y, (10.0 + j) * (1.3 if y >= 2022 else 1.0)) for j in range(30) for y in range(2015, 2025)], "row long, col long, year long, value double")
    r = T.trend(T.relative_series(x, x.select("row", "col").distinct()))
    assert r.agg(F.max(F.abs("slope"))).first()[0] < 0.005
    with pytest.raises(ValueError):
        T.relative_series(x, x.where("col < 3").select("row", "col").distinct())


def test_rank_ties_are_averaged(spark):
    x = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0), (5, None)], "id int, v double")
    got = {r["id"]: r["k"] for r in A.rank01(x, "v", "k").collect()}
    assert got == {5: 0.0, 3: 0.25, 1: 0.625, 2: 0.625, 4: 1.0}


def test_index_needs_a_stream(spark):
    with pytest.raises(ValueError):
        A.weighted_index(spark.range(1), {"lights": 1.0})


def test_stencil_boundaries(spark):
    x = layer(spark, 3, 3, lambda i, j: float(i == 0 and j == 0))
    at = lambda b: {(r["row"], r["col"]): r["total"] for r in S.stencil(x, "v", S.square(1), 3, 3, b).collect()}[(0, 0)]
    assert (at("constant"), at("nearest"), at("reflect")) == (1.0, 4.0, 4.0)
    with pytest.raises(ValueError):
        S.stencil(x, "v", S.square(1), 3, 3, "wrap")


def test_gaussian_keeps_constant(spark):
    got = S.gaussian(layer(spark, 6, 7, lambda i, j: 2.0), "v", 1.0, 6, 7)
    assert got.agg(F.max(F.abs(F.col("smooth") - 2))).first()[0] < 1e-9


def test_nearest_distance(spark):
    x = spark.createDataFrame([(i, j, (i, j) in {(1, 1), (4, 0)}) for i in range(6) for j in range(5)], "row long, col long, f boolean")
    for r in S.nearest_distance(x, "f").collect():
        assert r["km"] == pytest.approx(min(math.hypot(r["row"] - a, r["col"] - b) for a, b in ((1, 1), (4, 0))))
    assert S.nearest_distance(x.withColumn("f", F.lit(False)), "f").first()["km"] == 99


def test_zones_are_eight_connected(spark):
    cells = [(0, 0), (1, 1), (2, 2), (2, 3), (9, 9), (9, 8)]
    got = {(r["row"], r["col"]): r["label"] for r in Z.label_zones(spark.createDataFrame(cells, "row long, col long"), 10).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (2, 3): 0, (9, 9): 98, (9, 8): 98}


def test_spaced_sites(spark):
    x = layer(spark, 20, 20, lambda i, j: ((i * 7919 + j * 104729) % 1009) / 1009)
    got = Z.spaced(x, "v", 10, 3.0).orderBy("rank").collect()
    assert got[0]["score"] == x.agg(F.max("v")).first()[0]
    assert all(math.hypot(a["row"] - b["row"], a["col"] - b["col"]) >= 3 for i, a in enumerate(got) for b in got[:i])


def test_allocation_places_exactly_the_demand(spark):
    x = layer(spark, 20, 20, lambda i, j: ((i * 31 + j * 17) % 101) / 101).withColumnRenamed("v", "score").withColumn("urban", (F.col("row") < 5) & (F.col("col") < 5))
    got = G.allocate(x, 37, 20, 20)
    assert got.count() == 37 and got.where("row < 5 AND col < 5").count() == 0
    assert G.extrapolate_demand(100, 121, 2, 1) == 12


def test_confusion_quadrants(spark):
    rows = [(i, j, (i, j) in {(0, 0), (0, 1), (1, 0), (1, 1)}, i == 0 and j < 4) for i in range(5) for j in range(10)]
    got = K.confusion(spark.createDataFrame(rows, "row int, col int, p boolean, o boolean"), F.col("p"), F.col("o")).first()
    assert (got["hits"], got["misses"], got["false_alarms"], got["rejections"]) == (2, 2, 2, 44)


def test_auc_and_mann_whitney(spark):
    x = spark.createDataFrame([(0.1, False), (0.4, False), (0.4, True), (0.8, True), (0.9, True), (0.2, False)], "s double, o boolean")
    assert K.roc_auc(x, "s", F.col("o")).first()["auc"] == pytest.approx(8.5 / 9)
    assert K.mann_whitney(x, "s", F.col("o")).first()["u"] == pytest.approx(8.5)
    assert K.mann_whitney(x.limit(4), "s", F.col("o")).first()["u"] is None


def test_elasticity(spark):
    x = spark.createDataFrame([(float(i), 3.0 * i**0.7) for i in range(1, 200)] + [(0.0, 1.0), (None, 2.0)], "x double, y double")
    got = K.loglog(x, "x", "y").first()
    assert got["elasticity"] == pytest.approx(0.7) and got["n"] == 199


def test_evidence_and_recency(spark):
    rows = [("Work stalled", "negative", "stalled"), ("Work goes on", "negative", "approved"), ("Line inaugurated", "positive", "completed"), ("Walk in the park", "positive", "approved"), ("A walk in the park", "neutral", "delayed"), ("Road shut for two days", "negative", "approved"), (None, "positive", "approved")]
    x = spark.createDataFrame(rows, "t string, d string, s string")
    got = [tuple(r) for r in x.select(W.check_evidence(F.col("t"), F.col("d"), F.col("s")).alias("e")).select("e.is_event", "e.status", "e.direction").collect()]
    assert got[:6] == [(True, "stalled", "negative"), (True, "approved", "neutral"), (True, "completed", "positive"), (True, "approved", "neutral"), (True, "unclear", "neutral"), (False, "approved", "negative")]
    assert spark.range(1).select(W.recency(F.lit(12.0))).first()[0] == 0.5


def test_cues_are_looked_for_once_and_before_the_join(spark):
    """Each cue pattern stood in the plan once for every part of the result that reads it, above the join that moved whole texts."""
    import re

    from citygrid.plans import records

    plan = records.evidence_check(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    head, below = plan[: plan.index("Join")], plan[plan.index("Join") :]
    assert "RLIKE" not in head.upper() and below.upper().count("RLIKE") == 3
    x = spark.createDataFrame([("Road shut",)], "t string").select(W.check_evidence(F.col("t"), F.lit("negative"), F.lit("approved")).alias("e")).where("e.is_event")
    assert x.count() == 1
    for p in (W.NEGATIVE, W.POSITIVE):
        words = ["delay", "clos", "closing down", "CLOSED DOWN", "missed the deadline", "miss deadline", "pull out", "pulls ou", "set up", "sets up", "new", "new ", "xxban", "hire", "hirin", "hiring", "open", "o", "", "work on", "operationa", "é fall"]
        assert [bool(re.search(p, w, re.I)) for w in words] == [bool(re.search(W.by_first_letter(p), w, re.I)) for w in words]


def test_impact_of_setbacks_claims_and_age(spark):
    i = lambda d, s, b, m: W.impact(F.lit("purchase"), F.lit(d), F.lit(s), F.lit(W.BASIS[b]), F.lit(m))
    good, bad, setback, claim, old = spark.range(1).select(
        i("positive", "approved", "official_decision", 0.0), i("negative", "approved", "official_decision", 0.0), i("positive", "delayed", "reported_fact", 0.0), i("positive", "approved", "political_claim_or_promise", 0.0),
        i("positive", "approved", "official_decision", 12.0),
    ).first()
    assert good == -bad == pytest.approx(0.45) and setback < 0 and claim == 0 and old == pytest.approx(good / 2)


def test_more_sources_weigh_more(spark):
    x = spark.createDataFrame([(1, "a", "x", "s1", 0.5, 0), (2, "a", "x", "s2", 0.4, 0), (3, "b", "x", "s1", 0.5, 0), (4, "a", "x", "s1", -0.1, 1)], "id long, kind string, place string, source string, impact double, setback int")
    a, b, c = W.cluster_events(x).orderBy("setback", "kind").collect()
    assert (a["n_sources"], a["best_id"], a["n_articles"]) == (2, 1, 2) and a["impact"] > b["impact"] and c["impact"] == pytest.approx(-0.075)


def test_major_roads_are_chosen_before_they_are_cut(spark, tmp_path):
    """Pieces of all ways met the major ones in a join that sorted them: many times the vertices."""
    from citygrid.plans import records

    rows = [(i, w, c, f"1995-01-{i + 1:02d}") for i, (w, c) in enumerate([(1, "5-LOW"), (1, "1-URGENT"), (2, "2-HIGH"), (2, "3-MEDIUM"), (3, "1-URGENT"), (None, "1-URGENT"), (None, "1-URGENT"), (4, None), (4, "1-URGENT")])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = records.major_road_mask(spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    x = records.V.road_pieces(records.v.road(spark, str(tmp_path)).where(F.col("way_id").isin(1, 4)), 50, 100, records.ROAD_WEIGHTS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, x.select("row", "col").distinct().collect())) != []


def test_dedupe_keeps_the_newest(spark):
    rows = [(1, "metro line opens in city centre today", "2024-01-01"), (2, "Metro line opens in city centre today!", "2024-01-03"), (3, "metro line opens in city centre now today", "2024-01-02"), (4, "another story", "2024-01-01"), (5, "", "2024-01-01"), (6, None, "2024-01-01")]
    got = {r["id"]: r["kept"] for r in W.dedupe(spark.createDataFrame(rows, "id long, title string, published string")).collect()}
    assert got[1] is False and got[2] is True and got[3] is False and got[4] is True and got[5] is True


def test_dedupe_keeps_groups_and_not_their_pairs(spark, monkeypatch):
    """400 titles that differ in one word are 79,800 pairs; what is written stays in proportion to the titles."""
    import random

    from citygrid.operators import storage

    rng = random.Random(5)
    rows = [(i, f"metro line opens in centre of the town today x{i}", f"2024-01-{1 + i % 28:02d}") for i in range(400)]
    vocabulary = [f"w{i}" for i in range(9)] + ["metro", "line"]
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30) if i % 7 else 3)), f"2024-02-{1 + i % 28:02d}") for i in range(150)]
    long = [f"v{i}" for i in range(22)]
    rows += [(2000 + i, " ".join(rng.sample(long, rng.randint(11, 22))), "2024-03-01") for i in range(60)]
    most = []

    def counted(df):
        out = storage.cut(df)
        most.append(out.count())
        return out

    monkeypatch.setattr(W, "cut", counted)
    got = {r["id"]: r["kept"] for r in W.dedupe(spark.createDataFrame(rows, "id long, title string, published string")).collect()}
    assert max(most) < 60_000
    kept = []
    want = {}
    for i, title, _ in sorted(rows, key=lambda r: (r[2], -r[0]), reverse=True):
        t = set(title.split()) - set(W.STOPS)
        want[i] = not any(len(t & k) / len(t | k) >= 0.7 for k in kept)
        kept += [t] if want[i] else []
    assert got == want and 1 < sum(want.values()) < len(rows)


def test_zone_index_sums_over_all_cells(spark):
    zones = layer(spark, 12, 15, lambda i, j: 0.0)
    events = [(0.9, 3.0, 4, 5), (0.9, 3.0, 4, 5), (-0.5, 2.0, 0, 14), (0.3, 1.0, 11, 0), (2000.0, 1.0, 6, 6)]
    got = W.zone_index(zones, spark.createDataFrame(events, "impact double, radius double, row long, col long")).collect()
    assert len(got) == 12 * 15
    for r in got:
        total = sum(v * math.exp(-((r["row"] - a) ** 2 + (r["col"] - b) ** 2) / q**2) for v, q, a, b in events)
        assert r["index"] == pytest.approx(math.tanh(total / 1.5), abs=1e-12)


def test_dedupe_decides_long_chains(spark):
    # each title shares seven of eight words with the next: 7 / 9 alike; every other one is kept, as the one between is dropped
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 8)), f"2024-01-01 00:{59 - i:02d}:00") for i in range(54)]
    got = {r["id"]: r["kept"] for r in W.dedupe(spark.createDataFrame(rows, "id long, title string, published string")).collect()}
    assert got == {i: i % 2 == 0 for i in range(54)}


def test_robustness_under_random_weightings(spark):
    draws, names = 2000, list("abcde")
    w = [r["w"] for r in K.weightings(spark, draws, 5).orderBy("draw").collect()]
    assert len({tuple(x) for x in w}) == draws and all(sum(x) == pytest.approx(1) and min(x) > 0 for x in w)
    assert all(sum(x[j] for x in w) / draws == pytest.approx(0.2, abs=0.02) for j in range(5))
    assert sum(x[0] ** 2 for x in w) / draws == pytest.approx(2 / 30, abs=0.005)  # Dirichlet(1, ..., 1) has mean square 2 / (n (n + 1))
    cells = [(i // 5, i % 5, *[((i + 3) * (j + 2) * 7919 % 101) / 101 for j in range(5)]) for i in range(25)]
    rank, top = [0] * 25, [0] * 25
    for x in w:
        order = sorted(range(25), key=lambda i: (-sum(a * b for a, b in zip(x, cells[i][2:])), i))
        for n, i in enumerate(order, 1):
            rank[i] += n
            top[i] += n <= 10
    df = spark.createDataFrame(cells, "row long, col long, " + ", ".join(f"{c} double" for c in names))
    for r in K.robustness(df, names).collect():
        i = r["row"] * 5 + r["col"]
        assert r["mean_rank"] == pytest.approx(rank[i] / draws, abs=1e-3) and r["top_share"] == pytest.approx(top[i] / draws, abs=1e-3)


def test_percentiles_are_exact_by_ranges(spark):
    rnd = np.random.default_rng(1)
    v = np.concatenate((rnd.normal(size=3000), np.zeros(2000), rnd.integers(0, 5, 500)))
    rows = [(i % 3, float(x)) for i, x in enumerate(v)] + [(3, 7.0), (0, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r["q"] for r in O.percentiles(df, F.col("v"), [0, 0.05, 0.5, 0.99, 1], ["k"]).collect()}
    assert set(got) == {0, 1, 2, 3} and got[3] == [7.0] * 5
    for k in range(3):
        assert got[k] == pytest.approx(np.percentile([x for j, x in rows if j == k and x is not None], [0, 5, 50, 99, 100]), abs=1e-12)
    assert O.percentiles(df, F.col("v"), [0.5]).first()["q"][0] == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert O.median(df.limit(0), F.col("v"), "m").collect() in ([], [(None,)])


def test_numbers_sums_and_tiles_by_ranges(spark):
    rows = [(i, j, float((i * 7 + j) % 4)) for i in range(12) for j in range(11)]
    df = spark.createDataFrame(rows, "row long, col long, s double")
    got = {(r["row"], r["col"]): r["n"] for r in O.numbered(df, "s", ("row", "col"), "n", descending=True).collect()}
    assert got == {(i, j): n for n, (i, j, _) in enumerate(sorted(rows, key=lambda x: (-x[2], x[0], x[1])), 1)}
    sizes = [r["count"] for r in O.tiles(df, "s", ("row", "col"), 7, "t").groupBy("t").count().orderBy("t").collect()]
    assert sizes == [19] * 6 + [18]
    sums = {r["row"]: r["before_col"] for r in O.running(df.where("row < 5").groupBy("row").agg(F.sum("col").alias("col")), "row", ["col"]).collect()}
    assert sums == {i: 55 * i for i in range(5)}


def test_frames_and_pixels(spark):
    b = spark.createDataFrame([(1, 120.0, -30.0, 999.0, 510.0)], "id int, minx double, miny double, maxx double, maxy double")
    r = Q.frame_pair(b, 100.0, 500.0).first()
    assert (r["minx"], r["miny"], r["maxx"], r["maxy"], r["width"], r["height"], r["fine_width"], r["fine_height"]) == (0, -500, 1000, 1000, 2, 3, 10, 15)
    with pytest.raises(ValueError):
        Q.frame_pair(b, 90.0, 500.0)
    p = spark.createDataFrame([(i, j) for i in range(12) for j in range(10)], "i long, j long")
    row, col = Q.pixel_cell(25.0 + F.col("j") * 50, 600.0 - 25 - F.col("i") * 50, 0.0, 600.0, 100.0, 6, 5)
    got = Q.to_cells(p.withColumns({"row": row, "col": col}), F.col("i").cast("double")).collect()
    assert len(got) == 30 and all(r["n"] == 4 and r["mean"] == 2 * r["row"] + 0.5 for r in got)
    assert Q.nested(spark.createDataFrame([(1, 2)], "row long, col long"), 5).count() == 25


def test_tiles_cover_edges_and_keep_sides_apart(spark):
    o = {(r["row"], r["col"]) for r in Q.origins(spark, 50, 60, 16, 12).collect()}
    assert o == {(r, c) for r in (0, 12, 24, 34) for c in (0, 12, 24, 36, 44)}
    with pytest.raises(ValueError):
        Q.origins(spark, 10, 60, 16, 12)
    mask = [(i, j) for i in range(50) for j in range(60) if i < 32 and j < 30]
    sides = Q.select_tiles(Q.origins(spark, 50, 60, 16, 4), spark.createDataFrame(mask, "row long, col long"), 16).collect()
    inside = lambda r: sum((r["row"] + i, r["col"] + j) in set_ for i in range(16) for j in range(16))
    set_ = set(mask)
    assert {r["side"] for r in sides} == {"val", "train"} and all(inside(r) == (256 if r["side"] == "val" else 0) for r in sides)


def test_symmetries_and_overlaps(spark):
    a = np.arange(25).reshape(5, 5)
    cells = layer(spark, 5, 5, lambda i, j: float(a[i, j])).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(8)])))
    r, c = Q.symmetry(F.col("row"), F.col("col"), F.col("k"), 5)
    got = {(x["k"], x["r"], x["c"]): x["v"] for x in cells.select("k", "v", r.alias("r"), c.alias("c")).collect()}
    for k in range(8):
        want = np.rot90(a, k % 4)[:, :: -1 if k >= 4 else 1]
        assert all(got[k, i, j] == want[i, j] for i in range(5) for j in range(5))
    p = Q.overlap_average(spark.createDataFrame([(0, 0, 2.0), (0, 0, -2.0), (0, 1, 0.0)], "row long, col long, logit double")).collect()
    assert all(x["p"] == 0.5 for x in p)


def test_points_in_polygons(spark):
    square, notch = [(0, 0), (10, 0), (10, 10), (0, 10)], [(20, 0), (30, 0), (30, 10), (25, 4), (20, 10)]
    edges = [(k, *map(float, (*p[i], *p[(i + 1) % len(p)]))) for k, p in enumerate((square, notch)) for i in range(len(p))]
    pts = [(i * 40 + j, i + 0.5, j + 0.5) for i in range(40) for j in range(12)]
    got = {(r["poly"], r["id"]) for r in Q.in_polygons(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double"), 3.0).collect()}

    def inside(k, x, y):
        return sum((e[2] > y) != (e[4] > y) and x < (e[3] - e[1]) * (y - e[2]) / (e[4] - e[2]) + e[1] for e in edges if e[0] == k) % 2 == 1

    assert got == {(k, i) for i, x, y in pts for k in (0, 1) if inside(k, x, y)}


def test_draws(spark):
    rows = [(d, i, j, float((i * 5 + j * 3 + d) % 7)) for d in range(4) for i in range(6) for j in range(6)]
    got = D.top_by_draw(spark.createDataFrame(rows, "draw long, row long, col long, score double"), 9).collect()
    want = {(d, *x[1:3]) for d in range(4) for x in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], r[1], r[2]))[:9]}
    assert {tuple(r) for r in got} == want and len(got) == 36
    cells = spark.createDataFrame([(i, j, i < 2) for i in range(12) for j in range(12)], "row long, col long, urban boolean")
    flat = lambda state: state.select("row", "col", (1.0 / (1 + F.col("row"))).alias("score"))
    placed = D.project(cells, {2005: 10, 2010: 25}, flat, 12, 12, rounds=2).groupBy("year").count().orderBy("year").collect()
    assert [tuple(r) for r in placed] == [(2005, 10), (2010, 15)]


def test_layers(spark):
    one = spark.range(1)
    assert one.select(L.celsius(F.lit(44000))).first()[0] == pytest.approx(44000 * 0.00341802 + 149 - 273.15)
    assert one.select(L.clear(F.lit(0b100001), "qa_pixel"), L.clear(F.lit(0b1000), "qa_pixel"), L.clear(F.lit(1 << 10), "qa60")).first()[:] == (True, False, False)
    x = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-01", 2)], "d string, k int").withColumn("d", F.col("d").cast("timestamp"))
    assert L.required_depth(x.where("k = 1"), ["k"], "d", 2).first()["days"] == 2
    with pytest.raises(ValueError):
        L.required_depth(x, ["k"], "d", 2)
    b, t = F.lit(True), F.lit(False)
    assert [one.select(L.outcome(*c)).first()[0] for c in ((t, t, t), (b, t, t), (t, b, b), (t, t, b), (t, b, t))] == [0, 1, 2, 3, 4]
    got = one.select(*[TX.utc(F.lit(s)) for s in ("20240131T120000Z", "Wed, 31 Jan 2024 17:30:00 +0530", "yesterday")]).first()
    assert got[:] == ("2024-01-31 12:00:00", "2024-01-31 12:00:00", None)
    s = "BJP and AAP both welcome the Delhi metro; Congress Party too"
    assert one.select(TX.redact(F.lit(s))).first()[0] == "[party] and [party] both welcome the Delhi metro; [party] Party too"


def test_learning(spark):
    rows = [(i, j, float(i >= 8), float(i), float(j % 3)) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(rows, "row long, col long, label double, a double, b double")
    with pytest.raises(ValueError):
        M.balanced(df, least=60)
    w = M.balanced(df, least=30).groupBy("label").agg(F.sum("w").alias("w")).collect()
    assert w[0]["w"] == pytest.approx(w[1]["w"])
    p = M.permuted(df, ["a", "b"])
    assert p.count() == 3 * 144 and p.where("driver = 'a'").agg(F.sum("a")).first()[0] == df.agg(F.sum("a")).first()[0]
    assert p.where("driver = 'a'").join(df.select("row", "col", F.col("a").alias("old")), ["row", "col"]).where("a <> old").count() > 80
    got = M.validation(df.withColumn("p", F.col("a") / 12), df.select("row", "col", F.lit(False).alias("urban")), 12, 12, rounds=2).first()
    assert got["auc"] == 1.0 and (got["demand"], got["hits"], got["fom"]) == (48, 48, 1.0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize("name", ["growth_logit", "growth_forest", "light_growth_gbt", "opportunity_sites"])
def test_trained_models_on_held_out_periods(spark, name):
    from citygrid import plans

    got = plans.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    if name == "opportunity_sites":
        assert len(got) == 10 and all(math.hypot(a["row"] - b["row"], a["col"] - b["col"]) >= 5 for i, a in enumerate(got) for b in got[:i])
    elif name == "light_growth_gbt":
        rho = {r["model"]: r["rho"] for r in got}
        assert rho["boosted"] > rho["past trend"] and rho["ridge"] > rho["past trend"]
    else:
        assert all(r["auc"] > 0.7 for r in got)
