"""Packing of token sequences by length patterns that non-negative least squares fits to the length histogram.

The histogram of piece lengths (at most `size` entries, whatever the corpus) is all the driver sees:
1. lengths are put in bins of size / BINS tokens, rounded up; all patterns of up to PARTS bins that fill a sequence are listed;
2. non-negative least squares (active sets) fits repeat counts of the patterns to the bins' counts; counts are rounded down, and
   further where a bin would run short;
3. each pattern takes the longest lengths left in its bins and, for its last place, the longest that still fits, which gives
   patterns of exact lengths;
4. what is left goes, longest first, to the fullest sequence that still has room (best fit), those of the patterns included, else to
   new sequences. Pieces of one length are alike, so this works on counts too.
The result, slots (length, ranks from-to -> sequence and offset), has a bounded number of rows. Pieces get their rank among those of
their length from counts by (length, hash bucket) and a window inside a bucket, and look their slot up. A length has as many buckets as
its count asks for, BUCKET pieces in each, about. Repeated rows are packed each. A null text is empty: the end token alone.
Other columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, slices
from .tokens import encoder

BINS, PARTS = 96, 4
BUCKET = 20_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(np.abs(b).max(initial=0), 1) * 1e-7
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= scale:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if y.min() > 0:
                x[:] = 0
                x[at] = y
                break
            bad = y <= 0
            step = min(1.0, float((x[at][bad] / np.maximum(x[at][bad] - y[bad], 1e-300)).min()))
            x[at] += step * (y - x[at])
            active &= x > 1e-9
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(bins: list[int]) -> list[tuple[int, ...]]:
    """All falling tuples of two to PARTS of these bins (1 to BINS) that sum to BINS."""
    out, have = [], set(bins)

    def more(so_far: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(so_far)
        elif len(so_far) == PARTS - 1:
            if left in have and left <= so_far[-1]:
                out.append((*so_far, left))
        else:
            for b in bins:
                if b <= min(left, so_far[-1] if so_far else left):
                    more((*so_far, b), left - b)

    more((), BINS)
    return [p for p in out if len(p) > 1]


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many): all of the histogram's pieces, none beyond size."""
    left = Counter({n: k for n, k in histogram.items() if k > 0})
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), left.pop(size)))
    there = sorted(n for n in left if left[n] > 0)
    in_bin: dict[int, list[int]] = defaultdict(list)
    for n in there:
        in_bin[-(-n * BINS // size)].append(n)
    bins = sorted(in_bin)

    def longest(most: int, use: Counter) -> int | None:
        """The longest length up to `most` of which there is one that `use` doesn't take."""
        i = bisect_right(there, most) - 1
        while i >= 0 and left[there[i]] <= use[there[i]]:
            i -= 1
        return there[i] if i >= 0 else None

    listed = patterns(bins)
    open_: dict[int, list[list]] = defaultdict(list)  # by room: [lengths, how many]
    if listed:
        row = {b: i for i, b in enumerate(bins)}
        a = np.zeros((len(bins), len(listed)))
        for j, p in enumerate(listed):
            for b in p:
                a[row[b], j] += 1
        have = np.array([sum(left[n] for n in in_bin[b]) for b in bins], float)
        weight = 1 / np.sqrt(np.maximum(have, 1))  # bins count by their relative error
        x = nnls(a * weight[:, None], have * weight)
        room = have.astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1 - 1e-9:
                break
            need = a[:, j].astype(np.int64)
            times = min(int(x[j] + 1e-9), int((room[need > 0] // need[need > 0]).min()))
            room -= need * times
            while times > 0:
                parts, use = [], Counter()
                for i, b in enumerate(listed[j]):  # the longest left in the bin; for the last place, the longest that fits
                    most = size - sum(parts) if i == len(listed[j]) - 1 else b * size // BINS
                    n = longest(most, use)
                    if n is None:
                        break
                    use[n] += 1
                    parts.append(n)
                if len(parts) < 2:
                    break
                k = min(times, *(left[n] // c for n, c in use.items()))
                for n, c in use.items():
                    left[n] -= c * k
                    if left[n] == 0:
                        del there[bisect_right(there, n) - 1]
                open_[size - sum(parts)].append([tuple(parts), k])
                times -= k
    for n in sorted((n for n in left if left[n] > 0), reverse=True):
        while left[n] > 0:
            room = min((r for r, groups in open_.items() if r >= n and groups), default=None)
            if room is None:
                each = min(size // n, left[n])
                k = left[n] // each
                open_[size - each * n].append([(n,) * each, k])
                left[n] -= k * each
                continue
            group = open_[room][-1]
            each = min(room // n, left[n])
            k = min(group[1], left[n] // each)
            open_[room - each * n].append([(*group[0], *(n,) * each), k])
            group[1] -= k
            if not group[1]:
                open_[room].pop()
            left[n] -= k * each
    return out + [(tuple(p), k) for groups in open_.values() for p, k in groups if k]


def slots(made: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """(length, rank, sequence, offset): from this rank on, pieces of the length go to this sequence and those after it, at the offset."""
    rows, first, rank = [], 0, Counter()
    for lengths, k in made:
        at = 0
        for n in lengths:
            rows.append((n, rank[n], first, at))
            rank[n] += k
            at += n
        first += k
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], kind="stable")


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = np.array([end_id], "<u4").tobytes()
        for pdf in slices(batches):
            rows = []
            for doc, raw in zip(pdf["doc_id"], encoder(path).encode(list(pdf["text"]))):
                raw += last
                for i, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return lean(run)


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut into pieces of `size` where longer. Null texts are empty."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return doc.mapInPandas(_pieces(tokenizer, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset: every row once, gapless from 0, no sequence over size. An empty table stays empty."""
    names = pieces.columns
    spread = cut(pieces, "pieces")
    spark = spread.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in spread.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    buckets = spark.createDataFrame([(n, -(-k // BUCKET)) for n, k in histogram.items()] or [(0, 1)], "_length long, _buckets long")
    spread = spread.join(F.broadcast(buckets), F.col("length") == F.col("_length"))
    spread = spread.select(*names, F.pmod(F.xxhash64(*[F.col(c) for c in names]), "_buckets").alias("_bucket"))
    counts = spread.groupBy("length", "_bucket").agg(F.count("*").alias("n")).toPandas()  # at most size rows, and one more for each BUCKET pieces
    counts = counts.sort_values(["length", "_bucket"])
    table = slots(plan(histogram, size))
    step = np.int64(2) ** 40  # ranks and buckets of a length lie below
    before = (counts.groupby("length")["n"].cumsum() - counts["n"]).to_numpy(np.int64)
    key = counts["length"].to_numpy(np.int64) * step + counts["_bucket"].to_numpy(np.int64)
    model = (key, before, *(table[c].to_numpy(np.int64) for c in table))
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, before, length, rank, sequence, offset = shared.value
        starts = np.searchsorted(length, np.arange(size + 2))
        code = length * step + rank
        for pdf in batches:
            n = pdf["length"].to_numpy(np.int64)
            r = before[np.searchsorted(key, n * step + pdf["_bucket"].to_numpy(np.int64))] + pdf["_n"].to_numpy(np.int64) - 1
            at = np.searchsorted(code, n * step + r, side="right") - 1
            assert (at >= starts[n]).all()
            yield pdf[names].assign(sequence_id=sequence[at] + r - rank[at], offset=offset[at])

    w = Window.partitionBy("length", "_bucket").orderBy(*[F.col(c) for c in names])
    ranked = spread.withColumn("_n", F.row_number().over(w))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(lean(place), f"{fields}, sequence_id long, offset long")
