"""MinHash near-duplicates: banded candidates, checked on odd sketches, confirmed on full shingle sets.

A node is a distinct shingle set, named by its 128-bit digest; rows with the same set fall together in it. A bucket is a band's key with
two nodes or more. Within a bucket not all pairs are compared:
1. each node meets the best hub of its buckets, the node that shares buckets with most others (an original before its variants);
2. while a bucket holds several components, its nodes meet a member of its largest one, another one each round, so that the rounds
   spread over the component. Rounds go on while each takes a tenth off the pairs across components;
3. what few nodes are outside their bucket's largest component are compared with all of the bucket's other components, so that no link
   between components is lost. This grows with such nodes times their bucket, not with the square of the bucket.
A pair goes to the exact check if its odd sketches (parity bitmaps of the MinHash samples) put its similarity at FLOOR or above. Only nodes
that are in a bucket get a sketch; bands take BANDS * ROWS samples.
Chances at a similarity of exactly 0.8: no shared band (1 - 0.8^4)^20 = 3e-5; sketch under the floor, about 2e-5. The samples are
h * odd + add mod 2^32 of the upper half of a shingle's hash, which is not min-wise independent; FLOOR leaves room for that.

Nulls: a null or blank text has an empty set and is linked with nothing; a row without doc_id is in its set's component and never kept.
Repeated rows give repeated rows. Rows of one doc_id and different texts are judged each by its text. Other columns are not read; one_of_each()
returns them as they are, whatever their names. A very long text is one set of hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, lean, mix, only, slices
from .components import components
from .shingles import shingle_set

BANDS, ROWS = 20, 4
SAMPLES = 2048  #: of which bands use the first
BITS = 4096  #: of an odd sketch
FLOOR = 0.755
FEW = 16  #: pairs across components, by rows of buckets, up to which all are compared at once

_rng = np.random.Generator(np.random.PCG64(20_240_607))
_MUL = (_rng.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, SAMPLES, np.uint32)
_PLACE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def samples(hashes: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """The first n MinHash samples of a set of 64-bit hashes."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 2**32 - 1, np.uint32)
    step = 192 * 512 // n
    for i in range(0, h.size, step):
        np.minimum(least, (h[i : i + step, None] * _MUL[:n] + _ADD[:n]).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key + least[i : BANDS * ROWS : ROWS].astype(np.uint64))
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity of the number of samples that fall on each of BITS bits, as 64-bit words."""
    at = mix(least.astype(np.uint64) + _PLACE) % np.uint64(BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_bits(similarity: float) -> int:
    """Population count of the sketches' XOR at a similarity: it is expected at BITS (1 - exp(-4 k (1 - s) / BITS)) / 2."""
    return int(np.ceil(BITS * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITS)) / 2))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signed(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # a partition's sets: bands come with the first row of each
        for pdf in slices(batches):
            out = []
            for text in pdf["text"]:
                s = shingle_set(text, words)
                node = digest(s) if s.size else None
                if node is None or node in seen:
                    out.append((s.size, node, None))
                else:
                    seen.add(node)
                    out.append((s.size, node, band_keys(samples(s, BANDS * ROWS))))
            frame = pd.DataFrame(out, columns=["n_shingles", "node", "bands"])
            yield frame.assign(doc_id=pdf["doc_id"].astype("Int64").array, row_key=pdf["row_key"].to_numpy())

    return lean(run)


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            out = []
            for text in pdf["text"]:
                s = shingle_set(text, words)
                least = samples(s)
                out.append((digest(s), s.tobytes(), s.size, band_keys(least), odd_sketch(least)))
            yield pd.DataFrame(out, columns=["node", "hashes", "n_shingles", "bands", "odd"])

    return lean(run)


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["xs"], pdf["ys"]):
                both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (both.size - shared))
            yield pdf.loc[keep, ["a", "b"]]

    return lean(run)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_key) of docs; row_key is a hash of the other two."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return doc.withColumn("row_key", F.xxhash64("doc_id", "text"))


class _Links:
    """Pairs of nodes, screened by sketches and confirmed on full sets."""

    def __init__(self, doc: DataFrame, wanted: DataFrame, words: int, percent: int):
        """doc: keyed(); wanted: row_key of a row of each node that is in a bucket. Only these get sketches."""
        self.percent = percent
        some = only(doc.where("text IS NOT NULL"), wanted, "row_key").select("text")
        whole = some.mapInPandas(_sets(words), "node binary, hashes binary, n_shingles long, bands array<long>, odd array<long>")
        self.sets = cut(whole.dropDuplicates(["node"]), "sets")
        self.sketch = self.sets.select("node", F.struct("odd", "n_shingles", "bands").alias("s"))

    def alike(self, x: str, y: str):
        """Sketches and set sizes allow a link."""
        apart = " + ".join(f"bit_count({x}.odd[{i}] ^ {y}.odd[{i}])" for i in range(BITS // 64))
        p = self.percent
        return F.expr(f"({apart}) <= {most_bits(FLOOR)} AND 100 * {x}.n_shingles >= {p} * {y}.n_shingles AND 100 * {y}.n_shingles >= {p} * {x}.n_shingles")

    def screened(self, pairs: DataFrame) -> DataFrame:
        both = pairs.join(self.sketch.selectExpr("node AS a", "s AS x"), "a").join(self.sketch.selectExpr("node AS b", "s AS y"), "b")
        return both.where(self.alike("x", "y")).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the screened pairs that are links, written."""
        pairs = cut(pairs, "pairs")
        used = cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), "used")
        sets = only(self.sets.select("node", "hashes"), used, "node")
        both = pairs.join(sets.selectExpr("node AS a", "hashes AS xs"), "a").join(sets.selectExpr("node AS b", "hashes AS ys"), "b")
        return cut(both.mapInPandas(_confirm(self.percent), "a binary, b binary"), "links")


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def classes(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, lead, links) of each row of docs(doc_id, text), written.

    lead: the row_key of the component's row of smallest doc_id (rows without one last), null for a blank text.
    """
    doc = keyed(docs)
    signed = cut(doc.mapInPandas(_signed(words), "n_shingles long, node binary, bands array<long>, doc_id long, row_key long"), "signed")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("at"), "row_key"))
    nodes = cut(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), first.alias("lead")), "nodes")
    each = signed.where("bands IS NOT NULL").select(F.explode("bands").alias("key"), "node")
    h = F.xxhash64("node")
    shared = each.groupBy("key").agg(F.min(h).alias("h0"), F.max(h).alias("h1")).where("h0 <> h1").select("key")
    members = cut(each.join(shared, "key", "left_semi").distinct(), "members")
    size = members.groupBy("key").agg(F.count("*").alias("n"))
    company = members.join(size, "key").groupBy("node").agg(F.sum("n").alias("company"))
    ranked = cut(members.join(company, "node"), "ranked")
    wanted = cut(company.select("node").join(nodes, "node").select("lead.row_key").distinct(), "wanted")
    check = _Links(doc, wanted, words, percent)

    hubs = ranked.groupBy("key").agg(F.max(F.struct("company", "node")).alias("hub"))
    best = ranked.join(hubs, "key").groupBy("node").agg(F.max("hub").alias("hub")).selectExpr("node", "hub.node AS hub")
    links = check.confirmed(check.screened(_in_order(best.where("node <> hub"))))
    labels = components(links)
    before, round_ = None, 0
    while True:
        round_ += 1
        rest = cut(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "rest")
        by = rest.groupBy("key", "label").agg(F.count("*").alias("c"), F.max_by("node", F.xxhash64(F.lit(round_), "key", "node")).alias("one"))
        open_ = by.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by(F.struct("one", "label"), F.struct("c", "label")).alias("hub"), F.count("*").alias("m"))
        open_ = cut(open_.where("m > 1").selectExpr("key", "n", "(n * n - squares) / 2 AS across", "hub.one AS hub", "hub.label AS hub_label"), "open")
        found = open_.agg(F.sum("n").alias("rows"), F.sum("across").alias("across")).first()
        if not found["rows"]:
            break
        rest = cut(rest.join(open_.select("key", "hub", "hub_label"), "key"), "rest")
        outside = rest.where("label <> hub_label")
        if found["across"] <= FEW * found["rows"] or before is not None and found["across"] > 0.9 * before:
            sketch = check.sketch
            minor = outside.join(sketch, "node").selectExpr("key", "node AS a", "label AS la", "s AS x")
            whole = only(rest, cut(outside.select("key").distinct(), "keys"), "key").join(sketch, "node").selectExpr("key", "node AS b", "label AS lb", "hub_label", "s AS y")
            # a pair comes once: in the first band that they share, and from its smaller node if both are outside
            first = F.expr("key = element_at(filter(zip_with(x.bands, y.bands, (p, q) -> IF(p = q, p, NULL)), k -> k IS NOT NULL), 1)")
            once = F.expr("la <> lb AND (lb = hub_label OR a < b)") & first
            links = links.union(check.confirmed(minor.join(whole, "key").where(once).where(check.alike("x", "y")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
            labels = components(links, labels)
            break
        before = found["across"]
        links = links.union(check.confirmed(check.screened(_in_order(outside.select("node", "hub")))))
        labels = components(links, labels)
    links = links.distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    joined = labels.join(nodes, "node").groupBy("label").agg(F.min("doc").alias("component_id"), F.min("lead").alias("lead"))
    joined = labels.join(joined, "label").join(degree, "node").select("node", "component_id", "lead", "links")
    lone = nodes.join(labels, "node", "left_anti").select("node", F.col("doc").alias("component_id"), "lead", F.lit(0).cast("long").alias("links"))
    known = cut(joined.union(lone), "known")
    out = signed.where("node IS NOT NULL").select("doc_id", "row_key", "n_shingles", "node").join(known, "node").select("doc_id", "row_key", "n_shingles", "component_id", F.col("lead.row_key").alias("lead"), "links")
    blank = signed.where("node IS NULL").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("lead"), F.lit(0).cast("long").alias("links"))
    return cut(out.union(blank), "classes")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, links): a row for each row of docs(doc_id, text).

    Links: 100 * intersection >= percent * union of the sets of words-word shingles. component_id: the smallest doc_id reachable.
    links: confirmed links of the row's set with other sets on the way (not all there are).
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return classes(docs, words, percent).select("doc_id", "n_shingles", "component_id", kept, "links")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without one last. Equal rows fall together, blank texts stay."""
    at, row = free("_doc", docs), free("_row", docs)
    found = classes(docs, words, percent).select(F.coalesce("doc_id", F.lit(-(2**63))).alias(at), F.col("row_key").alias(row), "lead")
    gone = cut(found.where(F.col("lead") != F.col(row)).select(at, row).distinct(), "gone")
    again = cut(only(found, gone, [at, row], "left_anti").groupBy(at, row).count().where("count > 1").select(at, row), "again")
    doc = F.col("doc_id").cast("long")
    marked = docs.withColumns({at: F.coalesce(doc, F.lit(-(2**63))), row: F.xxhash64(doc, F.col("text").cast("string"))})
    left = only(marked, gone, [at, row], "left_anti")
    if again.limit(1).count():
        left = only(left, again, [at, row], "left_anti").union(only(left, again, [at, row]).dropDuplicates([at, row]))
    return left.select(*docs.columns)
