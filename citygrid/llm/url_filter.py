"""URL verdicts by host and path rules, else by the ratio of two character language models.

Rules are `host/path-prefix` strings; a rule fits its host and all subdomains, if the path starts with its prefix; the longest wins.
The models are variable-order Markov models (contexts of 0 to ORDER characters), one for accepted and one for rejected URLs. The corpus
itself teaches them, by a small seed: URLs whose host has a SEEDS word are rejected, all others accepted, but for those of block rules
(rules speak of places and not of characters) and those with a seed that a rule allows, which teach nothing. All URLs of the table are counted. That a URL without a seed is fine is only
assumed, so its score comes from models that have not seen its host: hosts are dealt to FOLDS folds by a hash, and the models of a fold
count the others. What it shares with rejected hosts, and not the seed words, decides of it. Rejected ones are scored by all. URLs that
come out above the limit teach the rejected model in the next of ROUNDS rounds, as their like would else hide in the accepted one.
- Counts are exact and stay in Spark: a window of ORDER + 1 bytes is a number, windows are counted in a grouped table, and the lower
  orders' counts are sums over it. Each window's share of a score is worked out once and joined to the URLs' windows; the few windows
  that make up over 1 / HOT of all go to every task, so no key of the shuffled join holds more.
- Each order's estimate is smoothed by the one below with Witten and Bell's weights: how many different characters followed the context.
- A URL's score is its log-likelihood difference per character, rejected minus accepted. The held-out scores of URLs that an allow rule
  fits (without any, of all accepted ones) are counted on a grid; the verdict is block above the score that all but RATE of them stay
  under, and above 0.

Nulls: a null url, or one without ://, has an empty host and path; no rule fits it, and as it has no characters it is allowed.
Repeated rows get the same verdict. With no URL of one kind to learn from all such URLs are allowed. An empty table stays empty.
A very long url is scored whole, window by window. Columns of the result win over columns of the same names, which are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

ORDER = 4
HOT = 2000
FOLDS = 4
ROUNDS = 2
RATE = 0.005
GRID = 4000
SEEDS = ("casino", "pills", "bets", "spam", "porn", "viagra", "xxx", "ads-", "poker", "loan", "cheap-")
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z), and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r), r)):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, r) if out is None else out.when(fits, r)
    return out if out is not None else F.lit(None).cast("string")


def _bytes(s: str) -> np.ndarray:
    return np.frombuffer(("\x02" * ORDER + s + "\x03").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)


def windows(s: str) -> np.ndarray:
    """For each byte of s and its end, it and the ORDER bytes before as a number; the byte itself is lowest."""
    b = _bytes(s)
    n = b.size - ORDER
    out = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | b[k : k + n].astype(np.int64)
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a batch's URLs by (bad, fold, w)."""
    for pdf in batches:
        for (bad, fold), part in pdf.groupby(["bad", "fold"])["s"]:
            w, n = np.unique(np.concatenate([windows(x) for x in part]), return_counts=True)
            yield pd.DataFrame({"bad": np.full(w.size, bad, np.int32), "fold": np.full(w.size, fold, np.int32), "w": w, "n": n})


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, pick, w) for each window of the URLs."""
    for pdf in batches:
        each = [windows(x) for x in pdf["s"]]
        size = [x.size for x in each]
        yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), size), "pick": np.repeat(pdf["pick"].to_numpy(), size), "w": np.concatenate(each) if each else np.empty(0, np.int64)})


def window_scores(taught: DataFrame) -> DataFrame:
    """(w, n, d) of each window of taught(bad, fold, s): how often it is there, and the logs of its likelihood, rejected minus accepted, by models that leave out each fold and, last, by all."""
    cells = [(bad, f) for bad in (0, 1) for f in range(FOLDS)]
    counts = taught.mapInPandas(lean(_count), "bad int, fold int, w long, n long")
    counts = counts.groupBy("w").agg(*[F.sum(F.when((F.col("bad") == bad) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"c{bad}{f}") for bad, f in cells])
    counts = cut(counts, "windows")

    def left(prefix: str, bad: int, v: int) -> Column:
        """The count of a class without fold v; with all for v = FOLDS."""
        parts = [F.col(f"{prefix}{bad}{f}") for f in range(FOLDS) if f != v]
        return sum(parts[1:], parts[0])

    models = [(bad, v) for bad in (0, 1) for v in range(FOLDS + 1)]
    table = counts.select("w", sum((F.col(f"c{b}{f}") for b, f in cells[1:]), F.col("c00")).alias("n"))
    p = {m: F.lit(1 / 256) for m in models}
    for k in range(ORDER + 1):
        key = F.col("w").bitwiseAND((1 << 8 * (k + 1)) - 1)
        joint = counts.groupBy(key.alias("key")).agg(*[F.sum(f"c{b}{f}").alias(f"j{b}{f}") for b, f in cells])
        followed = [F.count_if(left("j", bad, v) > 0).alias(f"t{bad}{v}") for bad, v in models]
        context = joint.groupBy(F.shiftright("key", 8).alias("over")).agg(*[F.sum(f"j{b}{f}").alias(f"n{b}{f}") for b, f in cells], *followed)
        if k == 0:  # one row, and 256
            context, joint = F.broadcast(context), F.broadcast(joint)
        table = table.join(joint, key == F.col("key")).join(context, F.shiftright(key, 8) == F.col("over"))
        for bad, v in models:
            n, t = left("n", bad, v), F.col(f"t{bad}{v}")
            p[bad, v] = F.when(t > 0, (left("j", bad, v) + t * p[bad, v]) / (n + t)).otherwise(p[bad, v])
        table = table.select("w", "n", *[x.alias(f"p{bad}{v}") for (bad, v), x in p.items()])
        p = {(bad, v): F.col(f"p{bad}{v}") for bad, v in models}
    return cut(table.select("w", "n", F.array(*[F.log(p[1, v]) - F.log(p[0, v]) for v in range(FOLDS + 1)]).alias("d")), "scores")


def url_scores(urls: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, score) of urls(id, pick, s) with s not blank: the mean over its windows by the pick's models. Sums are of whole numbers, so they don't hang on the order.

    A window that was never counted, as only URLs that teach nothing have it, says nothing.
    """
    total = scores.agg(F.sum("n").alias("total"))
    whole = F.transform("d", lambda x: F.round(x * 2.0**40).cast("long"))
    marked = scores.join(F.broadcast(total)).select("w", whole.alias("d"), (F.col("n") * HOT > F.col("total")).alias("hot"))
    spread = urls.where("s <> ''").select("id", "pick", "s").mapInPandas(lean(_spread), "id long, pick int, w long")
    hot = spread.join(F.broadcast(marked.where("hot").select("w", F.col("d").alias("known"))), "w", "left")  # under HOT rows
    cold = hot.where("known IS NULL").join(marked.where("NOT hot").select("w", "d"), "w", "left").select("id", F.coalesce(F.get("d", F.col("pick")), F.lit(0)).alias("d"))
    both = hot.where("known IS NOT NULL").select("id", F.get("known", F.col("pick")).alias("d")).union(cold)
    return both.groupBy("id").agg((F.sum("d") / F.count("*") / 2.0**40).alias("score"))


def _limit(scored: DataFrame, rate: float) -> float:
    """The score that all but a share of `rate` of the accepted URLs stay under: of those that an allow rule fits, or of all where there are none."""
    at = F.least(F.greatest(F.floor((F.col("score") + 10) * (GRID / 20)), F.lit(0)), F.lit(GRID - 1))
    sure = F.coalesce(F.col("ruled") == "allow", F.lit(False)).alias("sure")
    good = scored.where("bad = 0 AND (host <> '' OR path <> '')").groupBy(at.cast("int").alias("at"), sure).agg(F.count("*").alias("n")).toPandas()  # at most 2 GRID rows
    if not len(good):
        return np.inf
    hist = (good[good["sure"]] if good["sure"].any() else good).groupby("at", as_index=False)["n"].sum().sort_values("at")
    over = hist["n"][::-1].cumsum()[::-1].to_numpy() / int(hist["n"].sum())
    fits = hist["at"].to_numpy()[over <= rate]
    return (float(fits[0]) if fits.size else float(hist["at"].max()) + 1) * 20 / GRID - 10


def judge(pages: DataFrame, rules: dict[str, str] = RULES, seeds: tuple[str, ...] = SEEDS, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages(page_id, url)."""
    url = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    url = url.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("url"))
    url = url.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else None
    by_rule = F.element_at(said, F.col("rule")) if rules else F.lit(None).cast("string")
    seeded = F.lit(False)
    for w in seeds:
        seeded = seeded | F.contains("host", F.lit(w))
    bad = F.when(by_rule == "allow", F.when(~seeded, 0)).when(seeded, 1).when(by_rule == "block", None).otherwise(0)
    rows = url.select(
        F.monotonically_increasing_id().alias("id"), "page_id", "host", "path", "rule", by_rule.alias("ruled"), F.concat("host", "path").alias("s"), bad.cast("int").alias("bad"),
        F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
    )
    rows = cut(rows.withColumn("pick", F.when(F.col("bad") == 1, FOLDS).otherwise(F.col("fold"))), "urls")
    scored, limit = rows.withColumn("score", F.lit(-1.0)), np.inf
    for i in range(rounds):
        taught = rows.where("s <> '' AND bad IS NOT NULL").select("bad", "fold", "s")
        if taught.select("bad").distinct().count() < 2:
            break
        scored = cut(rows.join(url_scores(rows, window_scores(taught)), "id", "left").withColumn("score", F.coalesce("score", F.lit(-1.0))), "scored")
        limit = max(0.0, _limit(scored, rate))
        moved = F.coalesce((F.col("bad") == 0) & F.col("ruled").isNull() & (F.col("score") > limit), F.lit(False))
        if i + 1 < rounds:
            if not scored.where(moved).limit(1).count():
                break
            rows = scored.withColumn("bad", F.when(moved, 1).otherwise(F.col("bad"))).drop("score")
    verdict = F.coalesce("ruled", F.when((F.col("score") > limit) & ((F.col("host") != "") | (F.col("path") != "")), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
