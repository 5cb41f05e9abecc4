"""Queries of trained models and of the streaming extension; SQL can't express the models."""

from __future__ import annotations

import functools

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import texts as TX
from ..operators import draws as D
from ..operators import learning as M
from ..operators import news as W
from ..operators import scoring as K
from ..operators import stencil as S
from ..operators import vector as V
from ..operators.order import percentiles
from ..operators.storage import cut
from ..operators.zones import block_id
from ..sources import views as v
from ..streaming.windows import event_windows
from .grid import chg, pair
from .layers import HOLDERS
from .records import road_density
from .registry import R, query
from .trends import lag_features, types

N = v.ROWS
DRIVERS = ["f0", "near", "around", "edge_km", "centre_km", "roads", "people", "terrain"]
EXTENDED = [*DRIVERS, "light", "pois", "kinds", "footfall", "entropy", "momentum", "access"]
KINDS = ("click", "error", "purchase", "signup", "view")
#: With the points of each kind here and around, and light around: 31.
ALL = [*EXTENDED, *[f"{k}{end}" for k in KINDS for end in ("", "_1", "_3")], "light_1"]


def _growth(spark, d, y0: int, y1: int, extended: bool = False):
    """Cells not urban at y0 with their drivers then, and whether they are at y1; written, as many passes follow."""
    p = pair(spark, d, y0, y1).select("row", "col", F.col("v0").alias("f0"), (F.col("v0") >= 0.3).alias("urban"), (F.col("v1") >= 0.3).cast("double").alias("label"))
    x = p
    for name, radius in (("near", 1), ("around", 3)):
        x = x.join(S.circular_mean(p.select("row", "col", "f0"), "f0", radius, N, N).withColumnRenamed("mean", name), ["row", "col"])
    x = x.join(S.nearest_distance(p.select("row", "col", "urban"), "urban").withColumnRenamed("km", "edge_km"), ["row", "col"])
    x = x.withColumn("centre_km", F.hypot(F.col("row") - 24.5, F.col("col") - 24.5))
    x = x.join(road_density(spark, d), ["row", "col"], "left").withColumn("roads", X.nan0(F.col("metres"))).drop("metres")
    x = x.join(v.population(spark, d).where(F.col("year") == y0).drop("year"), ["row", "col"]).join(v.surface(spark, d).withColumnRenamed("score", "terrain"), ["row", "col"])
    if extended:
        light = v.lights(spark, d).where(F.col("year").isin(y0, y0 - 1)).groupBy("row", "col")
        light = light.agg(F.max(F.when(F.col("year") == y0, F.col("value"))).alias("light"), F.max(F.when(F.col("year") == y0 - 1, F.col("value"))).alias("before"))
        x = x.join(light.select("row", "col", "light", (F.col("light") - F.col("before")).alias("momentum")), ["row", "col"])
        mix = V.mix(v.poi(spark, d), {"purchase": 3.0, "signup": 2.0, "click": 1.0}).withColumnRenamed("n", "pois")
        x = x.join(mix, ["row", "col"], "left")
        x = x.join(S.stencil(x.select("row", "col", "pois"), "pois", S.gravity(3), N, N).select("row", "col", F.col("total").alias("access")), ["row", "col"])
        counts = v.poi(spark, d).groupBy("row", "col").agg(*[F.count_if(F.col("group") == k).cast("double").alias(k) for k in KINDS])
        here = cut(x.select("row", "col", "light").join(counts, ["row", "col"], "left").na.fill(0.0))
        wide = S.box_means(here, [*KINDS, "light"], [1, 3], N, N).groupBy("row", "col")
        wide = wide.agg(*[F.max(F.when(F.col("radius") == r, F.col(c))).alias(f"{c}_{r}") for c in (*KINDS, "light") for r in (1, 3)])
        x = x.join(here.drop("light"), ["row", "col"]).join(wide.drop("light_3"), ["row", "col"])
    return cut(x.na.fill(0.0))


def few_labels_as_null(columns: str):
    """A query of a model: one row of nulls where its table has too few labels to fit it."""

    def wrap(f):
        @functools.wraps(f)
        def run(spark, d):
            try:
                return f(spark, d)
            except M.TooFewLabels:
                return spark.createDataFrame([(None,) * len(columns.split(","))], columns)

        return run

    return wrap


JUDGED = "n long, auc double, demand long, hits long, fom double"


def _assemble(columns):
    return VectorAssembler(inputCols=list(columns), outputCol="x").transform


def _periods(spark, d, extended: bool = False):
    """(cells of the test period, eligible rows of 1997 to 1999, eligible rows of 1999 to 2001)"""
    a, b = _growth(spark, d, 1997, 1999, extended), _growth(spark, d, 1999, 2001, extended)
    return b, a.where("NOT urban"), b.where("NOT urban")


def _logit(train, columns=DRIVERS):
    return LogisticRegression(featuresCol="x", weightCol="w", maxIter=50, regParam=1e-3).fit(M.balanced(_assemble(columns)(train)))


def _forest(train, columns=DRIVERS, trees=60):
    return RandomForestClassifier(featuresCol="x", weightCol="w", numTrees=trees, minInstancesPerNode=20, seed=7).fit(M.balanced(_assemble(columns)(train)))


def _judged(model, cells, test, columns=DRIVERS):
    return M.validation(M.chance(model, _assemble(columns)(test)).select("row", "col", "p", "label"), cells.select("row", "col", "urban"), N, N)


@query()
@few_labels_as_null(JUDGED)
def growth_logit(spark, d):
    """Balanced logistic regression of new urban land on its drivers: trained on 1997 to 1999, judged on 1999 to 2001."""
    cells, train, test = _periods(spark, d)
    return _judged(_logit(train), cells, test)


@query()
@few_labels_as_null(JUDGED + ", oob_n long, oob_auc double")
def growth_forest(spark, d):
    """The same by 300 trees in ten bags, with the AUC of the training period's rows by the trees that did not see them."""
    cells, train, test = _periods(spark, d)
    x = cut(M.balanced(train.select("row", "col", "label", *DRIVERS)))
    forest = M.Bagged(_assemble(DRIVERS)(x), "x")
    unseen = forest.chances(_assemble(DRIVERS)(x), unseen=True).where("p IS NOT NULL").select("p", "label")
    oob = K.roc_auc(unseen, "p", F.col("label") == 1).select((F.col("n1") + F.col("n0")).alias("oob_n"), F.col("auc").alias("oob_auc"))
    scored = cut(forest.chances(_assemble(DRIVERS)(test)).select("row", "col", "p", "label"))
    return M.validation(scored, cells.select("row", "col", "urban"), N, N).join(F.broadcast(oob))


@query()
@few_labels_as_null(JUDGED)
def growth_boosted(spark, d):
    """The same by boosted trees on 31 drivers, which stop by the rows of every fourth block."""
    cells, train, test = _periods(spark, d, True)
    x = M.balanced(_assemble(ALL)(train)).withColumn("held", block_id(10, 5) % 4 == 0)
    m = GBTClassifier(featuresCol="x", weightCol="w", validationIndicatorCol="held", maxIter=30, maxDepth=4, seed=7).fit(x)
    return _judged(m, cells, test, ALL)


@query()
@few_labels_as_null("negatives long, n1 long, n0 long, auc double")
def negative_samples(spark, d):
    """AUC over the test period of regressions on all negatives, on 500 and on 100 of them; each negative kept weighs as many as it stands for."""
    _, train, test = _periods(spark, d)
    out = None
    for most in (1 << 40, 500, 100):
        some = M.fewer_negatives(train, most)
        x = M.balanced(_assemble(DRIVERS)(some), weight="weight")
        m = LogisticRegression(featuresCol="x", weightCol="w", maxIter=50, regParam=1e-3).fit(x)
        a = K.roc_auc(M.chance(m, _assemble(DRIVERS)(test)), "p", F.col("label") == 1).withColumn("negatives", F.lit(some.where("label <> 1").count()))
        out = a if out is None else out.unionByName(a)
    return out.select("negatives", "n1", "n0", "auc")


RADII = (1, 3, 7, 15)


@query(f"""WITH x AS (SELECT b.row, b.col, b.frac, l.value AS light FROM built b JOIN lights l USING (row, col, year) WHERE year = 2001)
SELECT a.row, a.col, r.r AS radius, {R('avg(b.frac)')} AS frac, {R('avg(b.light)')} AS light FROM x a CROSS JOIN (SELECT unnest([{', '.join(map(str, RADII))}])::BIGINT AS r) r JOIN x b ON abs(a.row - b.row) <= r.r AND abs(a.col - b.col) <= r.r GROUP BY 1, 2, 3""")
def box_means(spark, d):
    """Means over squares of four radii, by summed areas."""
    x = v.built(spark, d).join(v.lights(spark, d), ["row", "col", "year"]).where("year = 2001").select("row", "col", "frac", F.col("value").alias("light"))
    return S.box_means(cut(x), ["frac", "light"], list(RADII), N, N)


@query()
@few_labels_as_null("driver string, auc double, drop double")
def permutation_importance(spark, d):
    """What the forest's AUC over the test period loses without each driver."""
    _, train, test = _periods(spark, d)
    return M.importance(_forest(train), test.select("row", "col", "label", *DRIVERS), DRIVERS, _assemble(DRIVERS), F.col("label") == 1)


@query()
@few_labels_as_null("model string, n1 long, n0 long, auc double")
def stacked_models(spark, d):
    """A logistic regression on the logits of two models, taught on blocks that those did not see; AUC of each over the test period."""
    _, train, test = _periods(spark, d)
    held = block_id(10, 5) % 3 == 0
    models = {"logit": _logit(train.where(~held)), "forest": _forest(train.where(~held))}

    def base(df):
        for name, m in models.items():
            df = M.chance(m, _assemble(DRIVERS)(df), f"p_{name}").drop("x").withColumn(f"z_{name}", X.logit(F.col(f"p_{name}")))
        return _assemble([f"z_{n}" for n in models])(df)

    stack = LogisticRegression(featuresCol="x", maxIter=50, regParam=1e-4).fit(base(train.where(held)))
    out = M.chance(stack, base(test), "p_stack")
    long = out.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p")) for n in (*models, "stack")])).alias("m")).select("label", "m.*")
    return K.roc_auc(long, "p", F.col("label") == 1, ("model",))


@query()
@few_labels_as_null("drivers string, n1 long, n0 long, auc double")
def driver_ablation(spark, d):
    """AUC over the test period of regressions on sets of drivers."""
    _, train, test = _periods(spark, d, True)
    sets = {"all": ALL, "fifteen": EXTENDED, "eight": DRIVERS, "no neighbours": [c for c in DRIVERS if c not in ("near", "around", "edge_km")], "place only": ["centre_km", "terrain"]}
    out = None
    for name, columns in sets.items():
        a = K.roc_auc(M.chance(_logit(train, columns), _assemble(columns)(test)), "p", F.col("label") == 1).withColumn("drivers", F.lit(name))
        out = a if out is None else out.unionByName(a)
    return out.select("drivers", "n1", "n0", "auc")


@query()
def growth_projection(spark, d):
    """Cells placed by 2003 and 2005, each step's growth feeding the next through the neighbourhood."""
    cells = chg(spark, d).select("row", "col", F.col("is_urban").alias("urban"))

    def suitability(state):
        near = S.circular_mean(state.select("row", "col", F.col("urban").cast("double").alias("u")), "u", 3, N, N)
        return near.join(v.surface(spark, d), ["row", "col"]).select("row", "col", (0.5 * F.col("mean") + 0.5 * F.col("score")).alias("score"))

    return D.project(cells, {2003: 40, 2005: 90}, suitability, N, N, rounds=3)


@query()
def neighbourhood_sweep(spark, d):
    """Figure of merit by how much the allocation leans on the neighbourhood."""
    c = chg(spark, d)
    seen = cut(c.where("new_urban").select("row", "col"))
    cells = c.join(v.surface(spark, d), ["row", "col"]).select("row", "col", "score", F.col("was_urban").alias("urban"))
    return D.weight_sweep(cells, seen, seen.count(), (0.0, 0.1, 0.2, 0.35, 0.5), N, N, rounds=2)


def _features(spark, d):
    """Standardised features of all cells."""
    x = v.lights(spark, d).where("year = 2001").select("row", "col", X.log_radiance(F.col("value")).alias("light"))
    x = x.join(v.population(spark, d).where("year = 2001").select("row", "col", "people"), ["row", "col"]).join(pair(spark, d), ["row", "col"]).join(V.density(v.poi(spark, d), v.grid(spark)), ["row", "col"])
    x = cut(_assemble(["light", "people", "v0", "v1", "n"])(x).select("row", "col", F.col("x").alias("raw")))
    return StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(x).transform(x).select("row", "col", "x")


@query()
def principal_components(spark, d):
    """Two components of the centred features, of every cell."""
    x = _features(spark, d)
    m = PCA(k=2, inputCol="x", outputCol="c").fit(x)
    c = vector_to_array("c")
    return m.transform(x).select("row", "col", c[0].alias("c1"), c[1].alias("c2"))


@query()
def anomalies(spark, d):
    """Cells that two components describe worst (the upper 5 %), and how many of them the typology calls low."""
    x = _features(spark, d)
    m = PCA(k=2, inputCol="x", outputCol="c").fit(x)
    load = m.pc.toArray().tolist()
    z, c = vector_to_array("x"), vector_to_array("c")
    lost = sum(((z[i] - sum(c[j] * load[i][j] for j in range(2))) * (z[i] - sum(c[j] * load[i][j] for j in range(2))) for i in range(len(load))), F.lit(0.0))
    e = cut(m.transform(x).select("row", "col", lost.alias("error")))
    limit = percentiles(e, F.col("error"), [0.95]).select(F.col("q")[0].alias("limit"))
    flagged = e.join(F.broadcast(limit)).select("row", "col", "error", (F.col("error") >= F.col("limit")).alias("anomaly"))
    return flagged.join(types(spark, d).select("row", "col", F.col("type").isin(4, 5).alias("low")), ["row", "col"]).groupBy("anomaly").agg(F.count("*").alias("n"), F.count_if("low").alias("low"), F.avg("error").alias("error"))


@query()
@few_labels_as_null("row long, col long, p double")
def positive_unlabelled(spark, d):
    """Chances that a cell is of a kind of which only some cells are labelled."""
    x = _features(spark, d).join(types(spark, d).select("row", "col", (F.col("low") & (F.col("row") % 3 > 0)).alias("known")), ["row", "col"])
    x = cut(x.withColumn("held", F.col("known") & (F.col("col") % 3 == 0)).withColumn("label", (F.col("known") & ~F.col("held")).cast("double")))
    m = RandomForestClassifier(featuresCol="x", weightCol="w", numTrees=40, minInstancesPerNode=5, seed=7).fit(M.balanced(x.where("NOT held"), least=20))
    return M.positive_unlabelled(M.chance(m, x), F.col("held"))


@query()
def light_growth_gbt(spark, d):
    """The next two years' growth of light relative to the core: trained on 1998, judged on 1999. Boosted trees, ridge, and two baselines."""
    x = lag_features(spark, d).where("target IS NOT NULL AND growth3 IS NOT NULL AND slope4 IS NOT NULL")
    x = cut(_assemble(["growth3", "level2", "slope4"])(x))
    train, test = x.where("year = 1998"), x.where("year = 1999")
    models = {
        "boosted": GBTRegressor(featuresCol="x", labelCol="target", maxIter=20, maxDepth=3, seed=7).fit(train),
        "ridge": LinearRegression(featuresCol="x", labelCol="target", regParam=1e-3, standardization=True).fit(train),
    }
    predicted = {n: m.transform(test).withColumnRenamed("prediction", "p") for n, m in models.items()} | {"past trend": test.withColumn("p", 2 * F.col("slope4")), "no change": test.withColumn("p", F.lit(0.0))}
    out = None
    for name, t in predicted.items():
        g = K.regression(t.select("row", "col", "p", "target"), "p", "target").withColumn("model", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out.select("model", "n", "rho", "r2", "mae", "top_precision")


@query(f"""WITH a AS (SELECT id, kind, value > 50 AS up, title || ' ' || body AS t FROM article), n AS (SELECT *, regexp_replace(regexp_replace(t, '(^|[^A-Za-z])({TX.alternatives(HOLDERS)})($|[^A-Za-z])', '\\1[party]\\3', 'g'), '\\b({TX.ROLES})\\b', 'an official', 'gi') AS u FROM a),
c AS (SELECT kind, up, regexp_matches(t, '{W.TEMPORARY}', 'i') AS t0, regexp_matches(t, '{W.NEGATIVE}', 'i') AS n0, regexp_matches(t, '{W.POSITIVE}', 'i') AS p0, regexp_matches(u, '{W.TEMPORARY}', 'i') AS t1, regexp_matches(u, '{W.NEGATIVE}', 'i') AS n1, regexp_matches(u, '{W.POSITIVE}', 'i') AS p1 FROM n WHERE t <> u),
s AS (SELECT {', '.join(f"CASE WHEN t{i} THEN 0 WHEN up AND p{i} THEN 1 WHEN NOT up AND n{i} THEN -1 ELSE 0 END * CASE kind " + ' '.join(f"WHEN '{k}' THEN {m}" for k, (m, _) in W.EFFECTS.items()) + f" ELSE 0 END * {W.STATUS['approved']} AS {x}" for i, x in ((0, 'x'), (1, 'y')))} FROM c)
SELECT count(*) AS tested, count(*) FILTER (WHERE x = y) AS identical, {R('avg((x = y)::INT)')} AS invariance, {R('avg(((x = 0 AND y = 0) OR (sign(x) = sign(y) AND abs(x - y) <= 0.25 * greatest(abs(x), abs(y))))::INT)')} AS score_invariance FROM s""")
def counterfactual_audit(spark, d):
    """Articles whose text names a party, a holder or a role, read as they are and with the names taken out: shares read and scored the same."""
    a = v.article(spark, d).select("kind", F.concat_ws(" ", "title", "body").alias("t"), (F.col("value") > 50).alias("up"))
    plain = TX.without_roles(TX.redact(F.col("t"), HOLDERS))
    a = a.withColumn("plain", plain).where(F.col("t") != F.col("plain"))
    direction = F.when(F.col("up"), "positive").otherwise("negative")

    def score(e):
        return F.when(e["is_event"], W.impact(F.col("kind"), e["direction"], e["status"], F.lit(1.0), F.lit(0.0))).otherwise(0.0)

    read = lambda text: F.transform(F.array(W.check_evidence(F.col(text), direction, F.lit("approved"))), score)[0]
    return TX.audit(a.select(read("t").alias("x"), read("plain").alias("y")))


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, {R('sum(value)')} AS value FROM events GROUP BY 1, 2", with_views=False)
def event_windows_stream(spark, d):
    """Streaming extension: daily windows closed by the watermark, and those that the end of the stream leaves open."""
    return event_windows(spark, d)
