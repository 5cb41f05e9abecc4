"""Names of places in whole texts, by an index of aliases that meets the texts' n-grams in one join."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import normal_place
from .storage import cut

LISTED = 500_000  #: names up to which an index goes to every task
SHORT = 6  #: words of the names that are looked for in one pass


def alias_index(aliases: DataFrame, share: float, least: int) -> DataFrame:
    """(gram, words, place, whole) of aliases(name, place): normalised names with their smallest place; written.

    A name of at least `least` places and that share of all of them stands for the whole city.
    """
    named = aliases.select(normal_place(F.col("name")).alias("gram"), "place").where("gram <> ''").distinct()
    per = named.groupBy("gram").agg(F.min("place").alias("place"), F.count("*").alias("n")).join(F.broadcast(named.agg(F.countDistinct("place").alias("all"))))
    whole = (F.col("n") >= least) & (F.col("n") >= share * F.col("all"))
    return cut(per.select("gram", F.size(F.split("gram", " ")).cast("long").alias("words"), "place", whole.alias("whole")))


def _grams(words: Column, n: int) -> Column:
    """Structs (pos, gram) of a text's n-grams."""
    last = F.size(words) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("pos"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram")))


def _listed(words: DataFrame, index: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, pos, words, gram, place, whole) of names of these sizes in words(id, w): a row for each word, with those after it, asks the names of each size in turn, which are in every task."""
    after = [f"w{i}" for i in range(max(sizes))]
    rows = words.select("id", *[F.slice("w", i + 1, F.size("w")).alias(c) for i, c in enumerate(after)])
    rows = rows.select("id", F.posexplode(F.arrays_zip(*after)).alias("pos", "at")).select("id", F.col("pos").cast("long").alias("pos"), *[F.col("at")[c].alias(c) for c in after])
    for n in sizes:
        each = F.split("gram", " ")
        names = index.where(F.col("words") == n).select(*[each[i].alias(after[i]) for i in range(n)], F.struct("words", "gram", "place", "whole").alias(f"of{n}"))
        rows = rows.join(F.broadcast(names), after[:n], "left")
    found = [f"of{n}" for n in sizes]
    return rows.where(F.coalesce(*found).isNotNull()).select("id", "pos", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "pos", "x.*")


def names_in(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(id, pos, words, gram, place, whole): names in texts(id, text), from the left, the longest first; one that begins inside an earlier one doesn't count.

    Each n-gram of the whole text asks the index once. An index of at most LISTED names goes to every task, where names of up to SHORT
    words are met in one pass over the words; a longer one meets the grams by shuffles.
    """
    sizes = sorted(r["words"] for r in index.select("words").distinct().collect())  # a handful: how many words names have
    words = texts.select("id", F.split(normal_place(F.col("text")), " ").alias("w"))
    if not sizes:
        return texts.sparkSession.createDataFrame([], f"id {texts.schema['id'].dataType.simpleString()}, pos long, words long, gram string, place {index.schema['place'].dataType.simpleString()}, whole boolean")
    few = index.limit(LISTED + 1).count() <= LISTED
    short = [n for n in sizes if few and n <= SHORT]
    met = [_listed(words, index, short)] if short else []
    for n in sizes[len(short) :]:
        g = words.select("id", F.lit(n).cast("long").alias("words"), F.explode(_grams(F.col("w"), n)).alias("g")).select("id", "words", "g.*")
        met.append(g.join(F.broadcast(index) if few else index, ["gram", "words"]))
    met = functools.reduce(DataFrame.unionByName, met)
    order = Window.partitionBy("id").orderBy("pos", F.desc("words")).rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("pos") >= F.coalesce(F.max(F.col("pos") + F.col("words")).over(order), F.lit(0))
    return met.withColumn("_free", free).where("_free").select("id", "pos", "words", "gram", "place", "whole")


def locations(texts: DataFrame, index: DataFrame, most: int = 3) -> DataFrame:
    """(id, names, local, citywide, places, place) of each text: how many names, how many of them local, whether only the whole city is named, the first local names joined by |, and the place of the first."""
    found = names_in(texts, index)
    named = found.groupBy("id", "gram").agg(F.count("*").alias("k"), F.min("pos").alias("pos"), F.first("place").alias("place"), F.first("whole").alias("whole"))
    local = F.when(~F.col("whole"), F.struct("pos", "gram", "place"))
    g = named.groupBy("id").agg(F.sum("k").alias("names"), F.sum(F.when(~F.col("whole"), F.col("k")).otherwise(0)).alias("local"), F.slice(F.sort_array(F.collect_list(local)), 1, most).alias("l"))
    x = texts.select("id").join(g, "id", "left")
    n, here = F.coalesce("names", F.lit(0)), F.coalesce("local", F.lit(0))
    return x.select("id", n.alias("names"), here.alias("local"), ((n > 0) & (here == 0)).alias("citywide"), F.array_join(F.transform("l", lambda s: s["gram"]), "|").alias("places"), F.get("l", F.lit(0))["place"].alias("place"))
