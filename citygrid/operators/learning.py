"""Training and judging of growth models on held-out periods and blocks."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring as K
from .growth import allocate
from .order import numbered


class TooFewLabels(ValueError):
    """A model can't be fitted: its table has too few rows of a class."""


def balanced(train: DataFrame, label: str = "label", least: int = 30, weight: str | None = None) -> DataFrame:
    """Adds w: both classes weigh the same, their rows by `weight` or alike. TooFewLabels below `least` positives, or without negatives."""
    own = F.lit(1.0) if weight is None else F.col(weight)
    n = train.agg(F.count("*").alias("n"), F.sum(label).alias("k"), F.sum(own).alias("all"), F.sum(F.when(F.col(label) == 1, own)).alias("pos")).first()
    if (n["k"] or 0) < least or n["k"] == n["n"]:
        raise TooFewLabels(f"{n['k']} positives of {n['n']}; {least} are needed, and negatives")
    share = n["pos"] / n["all"]
    return train.withColumn("w", own * F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def fewer_negatives(train: DataFrame, most: int = 200_000, label: str = "label", seed: int = 7) -> DataFrame:
    """All positives and at most `most` negatives, those with the smallest hashes of (row, col); adds weight: how many negatives of the table one of them stands for.

    `most` bounds the labelled rows of a fit, and what one task merges.
    """
    n = train.where(F.col(label) != 1).count()
    if n <= most:
        return train.withColumn("weight", F.lit(1.0))
    some = train.where(F.col(label) != 1).orderBy(F.xxhash64(F.lit(seed), "row", "col"), "row", "col").limit(most)
    return train.where(F.col(label) == 1).withColumn("weight", F.lit(1.0)).unionByName(some.withColumn("weight", F.lit(n / most)))


def poisson_bag(bag: int, seed: int = 7) -> Column:
    """How often a row (row, col) is drawn into a bag: Poisson(1) by its hash, the same in every run, wherever the row is."""
    u = (F.pmod(F.xxhash64(F.lit(f"bag {bag} {seed}"), "row", "col"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    chance, upto = math.exp(-1), 0.0
    out = F.lit(0)
    for k in range(8):
        upto += chance
        out = out + (u > upto).cast("int")
        chance /= k + 1
    return out


class Bagged:
    """Bags of trees, each bag fitted to its own draw of the rows; a row's out-of-bag chance comes from the bags that did not draw it."""

    def __init__(self, train: DataFrame, features: str, trees: int = 300, bags: int = 10, least: int = 20, seed: int = 7):
        """train: written rows with the features, a label and a weight w. A bag's trees take a root of the features at each node."""
        self.models = []
        for bag in range(bags):
            drawn = train.withColumn("w", F.col("w") * poisson_bag(bag, seed)).where("w > 0")
            forest = RandomForestClassifier(featuresCol=features, weightCol="w", numTrees=trees // bags, bootstrap=False, featureSubsetStrategy="sqrt", minInstancesPerNode=least, seed=seed + bag)
            self.models.append(forest.fit(drawn))
        self.seed = seed

    def chances(self, df: DataFrame, unseen: bool = False) -> DataFrame:
        """df with p, the mean chance of all bags; unseen: of those that did not draw the row, null if all did."""
        out, names = df, []
        for bag, m in enumerate(self.models):
            out = chance(m, out, f"_p{bag}")
            names.append(F.when(poisson_bag(bag, self.seed) == 0, F.col(f"_p{bag}")) if unseen else F.col(f"_p{bag}"))
        there = F.filter(F.array(*names), lambda x: x.isNotNull())
        p = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
        return out.withColumn("p", p).drop(*[f"_p{b}" for b in range(len(self.models))])


def chance(model, df: DataFrame, name: str = "p") -> DataFrame:
    """df with the model's chance of class 1."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def validation(scored: DataFrame, cells: DataFrame, rows: int, cols: int, rounds: int = 8) -> DataFrame:
    """(n, auc, demand, hits, fom) of scored(row, col, p, label) over a period that the model never saw.

    As many cells as really changed are allocated by p, so the figure is of where, not of how many. cells(row, col, urban).
    """
    auc = K.roc_auc(scored, "p", F.col("label") == 1)
    demand = int(scored.agg(F.sum("label")).first()[0] or 0)
    state = cells.join(scored.select("row", "col", F.col("p").alias("score")), ["row", "col"], "left").select("row", "col", F.coalesce("score", F.lit(0.0)).alias("score"), "urban")
    new = allocate(state, demand, rows, cols, rounds=rounds)
    hits = new.join(scored.where("label = 1").select("row", "col"), ["row", "col"], "left_semi").agg(F.count("*").alias("hits"))
    fom = F.try_divide(F.col("hits"), 2 * F.lit(demand) - F.col("hits"))
    return auc.join(F.broadcast(hits)).select((F.col("n1") + F.col("n0")).alias("n"), "auc", F.lit(demand).cast("long").alias("demand"), "hits", fom.alias("fom"))


def permuted(df: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """df once as it is (driver: none) and once for each column with that column's values dealt anew by hashes of (row, col)."""
    order = lambda c, k: F.xxhash64(F.lit(f"{c}/{k}/{seed}"), "row", "col")
    out = df.withColumn("driver", F.lit("none"))
    for c in columns:
        to = numbered(df.withColumn("_h", order(c, 0)), "_h", ("row", "col"), "_i").drop("_h")
        of = numbered(df.select("row", "col", F.col(c).alias("_v")).withColumn("_h", order(c, 1)), "_h", ("row", "col"), "_i").select("_i", "_v")
        out = out.unionByName(to.join(of, "_i").withColumn(c, F.col("_v")).drop("_i", "_v").withColumn("driver", F.lit(c)).select(*out.columns))
    return out


def importance(model, df: DataFrame, columns: list[str], assemble, observed: Column) -> DataFrame:
    """(driver, auc, drop): how much of the AUC is lost when a driver's values are dealt anew."""
    a = K.roc_auc(chance(model, assemble(permuted(df, columns))), "p", observed, ("driver",))
    whole = a.where("driver = 'none'").select(F.col("auc").alias("whole"))
    return a.where("driver <> 'none'").join(F.broadcast(whole)).select("driver", "auc", (F.col("whole") - F.col("auc")).alias("drop"))


def positive_unlabelled(chances: DataFrame, held_out: Column) -> DataFrame:
    """(row, col, p): chances of being labelled, divided by how often a true case is labelled; that is their mean over held-out labelled cells."""
    c = chances.where(held_out).agg(F.greatest(F.avg("p"), F.lit(1e-6)).alias("c"))
    return chances.join(F.broadcast(c)).select("row", "col", F.least(F.col("p") / F.col("c"), F.lit(1.0)).alias("p"))
