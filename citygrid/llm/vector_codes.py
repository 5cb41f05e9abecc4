"""Vector codes: a codebook for each part of the vectors, trained on the distinct parts.

Components become whole numbers, vectors are cut into equal parts, and a part with its position is packed into one or a few 64-bit words:
that key stands for the part exactly.
1. Equal keys are counted: the distinct parts, each with its weight, are written once.
2. Each round of Lloyd's method runs over the distinct parts alone: nearest entry, then sums weighted by the counts. Tasks
   give at most a row per entry; sums are added up by Spark, and the driver holds the codebooks (parts x entries x a part's width).
3. Distinct parts get their final code and error, which are joined back to the vectors' parts by key and gathered by vector.
   Keys that hold over a thousandth of all parts go to every task, the others are shuffled.

Vectors that are null or have null or non-finite components are dropped. All others have a row, repeated ids and null ids too; ids that
are null come last, and equal ids are ordered by their vectors, when the first codebooks are chosen. With fewer vectors than entries the
codebooks have fewer. Missing trailing components count as 0, and so do those that fill the last part up. Components are cut off at
plus and minus 2^26. Ties go to the lower index. Other columns are not looked at; without a column label all labels are null. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, finite, lean, matched, whole_numbers

SCHEMA = "vec_id long, label int, code string, error long, label_error long, codebooks_sha256 string"


class _Packing:
    """How a part, its position first, is written as 64-bit words."""

    def __init__(self, parts: int, width: int, low: int, high: int):
        self.parts, self.width, self.low = parts, width, low
        self.bits = max(1, (high - low).bit_length())
        per = max(1, (63 - max(1, (parts - 1).bit_length())) // self.bits)
        self.runs = [range(i, min(i + per, width)) for i in range(0, width, per)]
        self.names = [f"key{j}" for j in range(len(self.runs))]

    def pack(self, run: range):
        """An array with a word for each part of the column v."""
        one = lambda p: F.aggregate(F.slice("v", p * self.width + run.start + 1, len(run)), F.lit(p).cast("long"), lambda a, x: F.shiftleft(a, self.bits).bitwiseOR(x - self.low))
        return F.array(*map(one, range(self.parts)))

    def unpack(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(position, components) of each row."""
        x = np.empty((len(pdf), self.width), np.int64)
        for name, run in zip(self.names, self.runs, strict=True):
            word = pdf[name].to_numpy(np.int64)
            for i in reversed(run):
                x[:, i] = (word & ((1 << self.bits) - 1)) + self.low
                word = word >> self.bits
        return word, x


def _nearest(part: np.ndarray, x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry in its part's codebook."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        d = (books[p] ** 2).sum(axis=1)[None, :] - 2 * (x[at] @ books[p].T)
        code[at] = d.argmin(axis=1)
        error[at] = d[np.arange(at.size), code[at]] + (x[at] ** 2).sum(axis=1)
    return code, error


def _sums(packing: _Packing, books: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, entries, width = books.shape
        total = np.zeros((parts * entries, width + 1), np.int64)
        for pdf in batches:
            part, x = packing.unpack(pdf)
            code, _ = _nearest(part, x, books)
            n = pdf["n"].to_numpy(np.int64)
            np.add.at(total, part * entries + code, np.column_stack((x, np.ones(len(x), np.int64))) * n[:, None])
        used = np.flatnonzero(total[:, -1])
        yield pd.DataFrame({"slot": used.astype(np.int32), "sums": list(total[used])})

    return lean(run)


def _coded(packing: _Packing, books: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part, x = packing.unpack(pdf)
            code, error = _nearest(part, x, books)
            yield pdf.assign(part=part.astype(np.int32), code=code.astype(np.int32), error=error)

    return lean(run)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of vectors(vec_id, embedding[, label]); at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    rows = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), whole_numbers(F.col("embedding"), scale).alias("v"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if not facts["n"]:
        return spark.createDataFrame([], SCHEMA)
    width = max(1, -(-facts["d"] // parts))
    packing = _Packing(parts, width, min(0, facts["low"] or 0), max(0, facts["high"] or 0))
    full = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v"))))
    first = [r["v"] for r in full.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]  # as many vectors as a codebook has entries
    books = np.array(first, np.int64).reshape(len(first), parts, width).swapaxes(0, 1).copy()

    keyed = cut(full.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", *[packing.pack(r).alias(k) for k, r in zip(packing.names, packing.runs, strict=True)]), "keyed")
    each = keyed.select("row", F.explode(F.arrays_zip(*packing.names)).alias("k")).select("row", "k.*")
    distinct = cut(each.groupBy(*packing.names).agg(F.count("*").alias("n")), "distinct")
    for _ in range(rounds):
        sums = distinct.mapInPandas(_sums(packing, books), "slot int, sums array<long>").select("slot", F.posexplode("sums").alias("i", "s"))
        total = np.zeros((parts * len(first), width + 1), object)
        for slot, i, s in sums.groupBy("slot", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # a row per component of an entry
            total[slot, i] = int(s)
        used = np.flatnonzero(total[:, -1])
        books.reshape(-1, width)[used] = (total[used, :-1] // total[used, -1:]).astype(np.int64)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    fields = ", ".join(f"{k} long" for k in packing.names)
    codes = cut(distinct.mapInPandas(_coded(packing, books), f"{fields}, n long, part int, code int, error long"), "codes")
    # eight parts' codes make a word, the first part's in its highest byte
    word = lambda j: F.bit_or(F.when(F.floor(F.col("part") / 8) == j, F.expr("shiftleft(bigint(code), 56 - 8 * (part % 8))")).otherwise(F.lit(0).cast("long")))
    words = range(-(-parts // 8))
    coded = matched(each, codes, packing.names).groupBy("row").agg(*[word(j).alias(f"w{j}") for j in words], F.sum("error").alias("error"))
    text = F.substring(F.concat(*[F.lpad(F.lower(F.hex(f"w{j}")), 16, "0") for j in words]), 1, 2 * parts)
    by = [F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("of")]
    coded = cut(keyed.select("row", "vec_id", "label").join(coded, "row").select("vec_id", "label", *by, text.alias("code"), "error"), "coded")
    labels = cut(coded.groupBy("no_label", "of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return matched(coded, labels, ["no_label", "of"]).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dimensions: int = 64) -> str:
    """The same rows in SQL, for vectors of so many dimensions."""
    w = dimensions // parts
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, p, list_slice(v, p * {w} + 1, p * {w} + {w}) AS x FROM v, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM p WHERE r < {entries})",
    ]
    near = lambda i: f"SELECT p.r, p.p, p.x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS m FROM p JOIN b{i} USING (p) GROUP BY ALL"
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near(i)})",
            f"s{i} AS (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS f FROM a{i}, range(1, {w + 1}) t(i) GROUP BY ALL) GROUP BY ALL)",
            f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s ON s.p = b.p AND s.e = b.e)",
        ]
    steps += [
        f"z AS MATERIALIZED (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM ({near(rounds)}) GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN z USING (r), h"
