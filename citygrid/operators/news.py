"""News: cleaning, evidence, impact, events, places and near-equal titles."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

STOPS = ("the", "of", "and", "to", "in", "is", "a", "on", "for", "at", "with", "by", "as", "be", "it", "that", "this")

# Cue patterns, weights of status and basis, half-life, squashing scales.
NEGATIVE = (
    "delay|stall|halt|scrap|cancel|postpon|stuck|shelv|closure|clos(e|es|ed|ing) down|"
    "shut|layoff|lay off|job cut|flood|waterlog|collaps|ban|shortage|crisis|damag|"
    "fire|accident|protest|dispute|slow|behind schedule|miss(ed|es) (the )?deadline|"
    "exit|pull(s|ed)? out|withdraw|loss|decline|fall|drop"
)
POSITIVE = (
    "open|launch|inaugurat|complet|approv|sanction|clear|start|begin|began|build|"
    "construct|invest|expan|plan|propos|tender|award|commission|foundation|operational|"
    "new |set up|sets up|upgrad|add|introduc|unveil|allot|fund|develop|work on|"
    "progress|connect|link|extend|acquir|hire|hiring|jobs"
)
TEMPORARY = r"\btemporar|\b(?:till|until) (?:tomorrow|today|tonight)\b|\bfor (?:the|a|one|two|three|\d+) (?:day|days|hours?|night|weekend)\b"
STATUS = {"proposed": 0.25, "approved": 0.5, "funded": 0.6, "under_construction": 0.8, "completed": 1.0, "operational": 1.0, "delayed": 0.5, "stalled": 0.6, "cancelled": 0.8, "unclear": 0.3}
BASIS = {"reported_fact": 1.0, "official_decision": 1.0, "announcement_or_plan": 0.6, "opinion": 0.2, "political_claim_or_promise": 0.0}
SETBACKS = ("delayed", "stalled", "cancelled")

#: Magnitude and radius in km by kind of event (the stand-ins that the tables have).
EFFECTS = {"purchase": (0.9, 3.0), "signup": (0.6, 2.0), "click": (0.3, 1.0), "view": (0.2, 1.0), "error": (0.5, 2.0)}


def chosen(key: Column, table: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for k, x in table.items():
        out = F.when(key == k, x).otherwise(out)
    return out


def tokens(title: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), F.lit(1))), F.array(*[F.lit(s) for s in STOPS]))


def age_months(published: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.datediff(now, F.try_to_timestamp(published))) / 30.44, F.lit(24.0))


def recency(months: Column, half: float = 12.0) -> Column:
    return F.pow(F.lit(0.5), months / half)


def is_setback(status: Column) -> Column:
    return status.isin(*SETBACKS)


def impact(kind: Column, direction: Column, status: Column, basis: Column, months: Column) -> Column:
    """Sign times magnitude, status, basis and recency; a setback counts against, whatever its direction."""
    sign = F.when(is_setback(status), -1.0).otherwise(chosen(direction, {"positive": 1.0, "negative": -1.0}))
    return sign * chosen(kind, {k: m for k, (m, _) in EFFECTS.items()}) * chosen(status, STATUS) * basis * recency(months)


def radius(kind: Column) -> Column:
    """The kind's radius in km; kinds not listed have that of a view."""
    return chosen(kind, {k: r for k, (_, r) in EFFECTS.items()}, EFFECTS["view"][1])


def by_first_letter(pattern: str) -> str:
    """The pattern with its alternatives grouped by their first letter, and positions with another letter passed over: the same matches in a part of the time."""
    heads: dict[str, list[str]] = {}
    depth, start = 0, 0
    for i, c in enumerate(pattern + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            heads.setdefault(pattern[start], []).append(pattern[start + 1 : i])
            start = i + 1
    return f"(?=[{''.join(heads)}])(?:{'|'.join(f'{c}(?:{"|".join(tails)})' for c, tails in heads.items())})"


def cues(text: Column) -> Column:
    """(negative, positive, brief): whether the text has cues of either kind, and of a change that is temporary."""
    has = lambda p: F.rlike(text, F.lit(f"(?i)(?:{p})"))
    return F.struct(has(by_first_letter(NEGATIVE)).alias("negative"), has(by_first_letter(POSITIVE)).alias("positive"), has(TEMPORARY).alias("brief"))


def judge(found: Column, direction: Column, status: Column) -> Column:
    """(is_event, status, direction, reason) by cues(): temporary changes are no events; a label without a cue in the text is set to neutral."""
    neg, pos, brief = found["negative"], found["positive"], found["brief"]
    reason = (
        F.when(brief, "temporary").when(is_setback(status) & ~neg, "setback without a cue").when((direction == "negative") & ~neg, "negative without a cue")
        .when((direction == "positive") & ~pos, "positive without a cue")
    )
    kept = reason.isNull() | (reason == "temporary")
    return F.struct(
        F.coalesce(reason != "temporary", F.lit(True)).alias("is_event"), F.when(reason == "setback without a cue", "unclear").otherwise(status).alias("status"),
        F.when(kept, direction).otherwise("neutral").alias("direction"), reason.alias("reason"),
    )


def check_evidence(text: Column, direction: Column, status: Column) -> Column:
    """judge() by the text's cues, which are looked for once, whatever is read of the result."""
    return F.transform(F.array(cues(text)), lambda found: judge(found, direction, status))[0]


def cluster_events(rows: DataFrame) -> DataFrame:
    """(kind, place, setback, n_articles, n_sources, best_id, impact): the strongest article stands for the event, more sources weigh more."""
    key = ["kind", "place", "setback"]
    strongest = F.max_by("id", F.struct(F.abs("impact"), -F.col("id"))).alias("best_id")
    g = rows.groupBy(*key).agg(
        F.count("*").alias("n_articles"), F.countDistinct("source").alias("n_sources"), strongest, F.max_by("impact", F.struct(F.abs("impact"), -F.col("id"))).alias("best")
    )
    sure = F.least(F.lit(1.0), 0.5 + 0.25 * F.col("n_sources"))
    return g.select(*key, "n_articles", "n_sources", "best_id", (F.col("best") * sure).alias("impact"))


def zone_index(zones: DataFrame, events: DataFrame) -> DataFrame:
    """(row, col, index): events' impacts fading as exp(-(d / radius)^2), summed over all cells and squashed.

    The fade is a product of one along rows and one along columns, so impacts, summed by cell and radius, spread in two passes of a
    line each; the lines are as long as the frame is high and wide.
    """
    fade = lambda x, y: F.exp(-(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) / (F.col("radius") * F.col("radius")))
    by_cell = events.groupBy("row", "col", "radius").agg(F.sum("impact").alias("v"))
    lines = [F.broadcast(zones.select(F.col(x).alias(f"to_{x}")).distinct()) for x in ("row", "col")]
    down = by_cell.crossJoin(lines[0]).groupBy("to_row", "col", "radius").agg(F.sum(F.col("v") * fade("to_row", "row")).alias("v"))
    across = down.crossJoin(lines[1]).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum(F.col("v") * fade("to_col", "col")).alias("v"))
    return zones.select("row", "col").join(across, ["row", "col"], "left").select("row", "col", F.tanh(F.coalesce("v", F.lit(0.0)) / 1.5).alias("index"))


def overlap(n: int, m: int, share: float) -> int:
    """The fewest common tokens that make titles of n and m tokens `share` alike; min(n, m) + 1 if none do."""
    return next((o for o in range(1, min(n, m) + 1) if o / (n + m - o) >= share), min(n, m) + 1)


def _sizes(share: float, most: int = 300) -> tuple[int, dict[int, list[tuple[str, int]]]]:
    """The size up to which titles are compared by common subsets, and for each size the (class, subset's size) of the pairs of sizes that it can be alike in.

    It ends where a title would have over `most` subsets in a class.
    """
    of: dict[int, list[tuple[str, int]]] = {}
    n = 1
    while n <= 64:
        more = [(m, overlap(m, n, share)) for m in range(1, n + 1)]
        more = [(m, o) for m, o in more if o <= m]
        if any(math.comb(n, o) > most for _, o in more):
            break
        of[n] = []
        for m, o in more:
            if (m, n) != (1, 1):
                of[n].append((f"{m} {n}", o))
                if m < n:
                    of[m].append((f"{m} {n}", o))
        n += 1
    return n - 1, of


def _subsets(nodes: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """nodes(t, n, ...) with each of their (n, ..., at) of rows, and key, the tokens at those places of t."""
    table = F.broadcast(nodes.sparkSession.createDataFrame(rows, names))  # fixed by the share
    key = F.array_join(F.transform("at", lambda i: F.col("t")[i]), " ")
    return nodes.join(table, "n").withColumn("key", key).drop("at")


def alike_groups(nodes: DataFrame, share: float) -> tuple[int, DataFrame]:
    """(long, members): titles of up to `long` tokens of nodes(node, t, age) are alike if and only if they stand on opposite sides of a key.

    members(key, side, other, node, age), written: two sets of n and m tokens are alike if they have a common subset of overlap(n, m)
    tokens, so a key is such a subset with both sizes; its smaller titles stand on side 0 and the larger ones on 1, those of one size on
    both. Groups stand for their pairs, which grow with the square of a group. Only titles that share with another one the
    first tokens (the longest, as these are rare) that alike ones must share get subsets.
    """
    long, of = _sizes(share)
    first = lambda x: F.struct(-F.length(x), x.alias("x"))
    short = nodes.where(F.size("t") <= long).select("node", "age", F.transform(F.array_sort(F.transform("t", first)), lambda x: x["x"]).alias("t"), F.size("t").alias("n"))
    depth = 1  # titles of fewer tokens are like no other, the others have that many in common
    while depth < 3 and depth / (depth + 1) < share:
        depth += 1
    heads = [(n, list(c)) for n, x in of.items() if x and n >= depth for c in itertools.combinations(range(n - max(min(o for _, o in x), depth) + depth), depth)]
    head = _subsets(short, heads, "n int, at array<int>").select("key", "node")
    shared = head.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    some = short.join(head.join(shared, "key").select("node").distinct(), "node")
    rows = [(n, kind, *((0, 0) if kind == f"{n} {n}" else (0, 1) if kind.startswith(f"{n} ") else (1, 0)), list(c)) for n, x in of.items() for kind, o in x for c in itertools.combinations(range(n), o)]
    every = _subsets(some, rows, "n int, kind string, side int, other int, at array<int>")
    every = cut(every.select(F.concat_ws(" ", "kind", "key").alias("key"), "side", "other", "node", "age"))
    open_ = every.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min(F.struct("side", "other")).alias("c"), F.max(F.struct("side", "other")).alias("d"))
    open_ = open_.where("a <> b AND (c <> d OR c.side = c.other)").select("key")
    return long, cut(every.join(open_, "key", "left_semi"))


def dedupe(articles: DataFrame, share: float = 0.7) -> DataFrame:
    """(id, kept): newest first, an article is dropped if its title is `share` alike (Jaccard, tokens) to one kept before it.

    Titles with the same tokens are one node, of which the newest stands for all. Nodes are neighbours in alike_groups(); long titles
    and those like them by pairs, from the token index by prefix filtering: two such titles share one of their rarest tokens.
    Rounds: undecided nodes without kept or undecided newer neighbours are kept, nodes with a kept newer neighbour are dropped.
    Of a group each round needs its newest kept and its newest undecided node. The newest undecided node is decided in each round, so all are in the end.
    """
    t = articles.select("id", "published", F.array_sort(tokens(F.col("title"))).alias("t"))
    order = F.struct("published", -F.col("id"))
    nodes = t.where(F.size("t") > 0).groupBy("t").agg(F.max_by("id", order).alias("node"), F.max(order).alias("age"))
    nodes = cut(nodes)
    long, members = alike_groups(nodes, share)
    words = nodes.where(F.size("t") >= share * (long + 1)).select("node", F.size("t").alias("n"), F.explode("t").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("df"))
    rare = words.join(often, "w").withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("df", "w"))).where(F.col("rn") <= F.col("n") - F.ceil(F.lit(share) * F.col("n")) + 1)
    a, b = rare.where(F.col("n") > long).select("w", F.col("node").alias("a")), rare.select("w", F.col("node").alias("b"), F.col("n").alias("m"))
    pairs = a.join(b, "w").where((F.col("a") < F.col("b")) | (F.col("a") != F.col("b")) & (F.col("m") <= long)).select("a", "b").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("t").alias(f"t{x}"), F.col("age").alias(f"g{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    alike = full.where(both / (F.size("ta") + F.size("tb") - both) >= share)
    newer = F.col("ga") > F.col("gb")
    edges = cut(alike.select(F.when(newer, F.col("a")).otherwise(F.col("b")).alias("new"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("old")))
    state = cut(nodes.select("node", F.lit(None).cast("boolean").alias("kept")))
    while True:
        now = members.join(state, "node").where(F.coalesce("kept", F.lit(True)))
        newest = now.groupBy("key", F.col("side").alias("other")).agg(F.max(F.when(F.col("kept"), F.col("age"))).alias("kept_age"), F.max(F.when(F.col("kept").isNull(), F.col("age"))).alias("open_age"))
        over = lambda x: F.max(F.coalesce(F.col(x) > F.col("age"), F.lit(False)))
        met = now.where("kept IS NULL").join(newest, ["key", "other"]).groupBy(F.col("node").alias("old")).agg(over("kept_age").alias("kept_newer"), over("open_age").alias("open_newer"))
        seen = edges.join(state.select(F.col("node").alias("new"), F.col("kept").alias("k")), "new").groupBy("old").agg(
            F.max(F.coalesce("k", F.lit(False))).alias("kept_newer"), F.max(F.col("k").isNull()).alias("open_newer")
        )
        seen = seen.unionByName(met).groupBy("old").agg(F.max("kept_newer").alias("kept_newer"), F.max("open_newer").alias("open_newer"))
        nxt = state.join(seen.withColumnRenamed("old", "node"), "node", "left")
        now = F.when(F.coalesce("kept_newer", F.lit(False)), False).when(~F.coalesce("open_newer", F.lit(False)), True)
        state = cut(nxt.select("node", F.coalesce("kept", now).alias("kept")))
        if not state.where("kept IS NULL").limit(1).count():
            break
    stands = nodes.select("t", "node").join(state, "node")
    out = t.join(stands, "t", "left")
    return out.select("id", F.when(F.size("t") == 0, True).otherwise((F.col("id") == F.col("node")) & F.col("kept")).alias("kept"))
