"""Exact-substring removal: bytes under a `length`-byte string that starts anywhere else in the corpus as well.

1. Anchors. In each window of `length` bytes the 50-byte gram with the smallest hash (the last one on ties) is its anchor, so equal
   windows have the same anchor at the same place. An anchor's context is all that such windows can reach: the document from
   length - 50 bytes before the anchor to `length` bytes from its start.
2. Equal contexts fall together by (anchor, context hash): a count, combined before the shuffle. Anchors that occur once are done.
3. Column-wise construction. The different contexts of the anchors left, aligned at the anchor, are a collection of strings to which
   each round adds one symbol per string. The round's symbols in the current order are the next column of the collection's
   Burrows-Wheeler transform; a stable sort by symbol gives the next order, and the common-suffix starts of neighbours follow by
   range maxima. A window is repeated if it agrees with a neighbour in the order over `length` bytes or more. As the strings are
   aligned, only one column of the transform is open at a time; a collection is of whole anchors and has less than BLOCK + HOT
   strings, so a column is at most that many bytes and files on disk are not needed.
4. No task may hold an unbounded group: an anchor with more than HOT different contexts is cut up to single windows, which are
   compared by hash in shuffles, the columns of one window at a time being all that is left to compare.
5. Repeated intervals go back to all occurrences of their context, and per document their union is taken out. Contexts that make up
   over 1 / SPLIT of all occurrences (fewer than SPLIT) go to every task, so no key of the shuffled join holds more.

Nulls: a null text is empty. Rows are told apart by 128 bits of hash of doc_id and text; equal rows are copies of each other and so lose all their windows.
A very long text is one row and its windows are spread like all others. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, matched, mix

GRAM = 50
BLOCK = 4096  #: strings from which on a collection ends with its anchor
HOT = 30_000  #: different contexts of an anchor beyond which its windows are counted instead
CHUNK = 1 << 19  #: bytes of a document looked at at a time
SPLIT = 1000
ROW = ["r1", "r2"]  #: a row's two hashes

_rng = np.random.Generator(np.random.PCG64(77))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.cumprod(np.full(CHUNK + 4096, _M, np.uint64)) * np.uint64(pow(int(_M), -1, 2**64))
_INV = np.cumprod(np.full(CHUNK + 4096, np.uint64(pow(int(_M), -1, 2**64)), np.uint64)) * _M


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-byte grams, by a polynomial of the byte values."""
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POW[: raw.size], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _INV[: raw.size - n + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: x.size - (w - have)], x[w - have :]) if have < w else x


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows' anchors, and the grams' hashes there."""
    at, values = [], []
    for i in range(0, max(raw.size - length + 1, 0), CHUNK - length):
        part = raw[i : i + CHUNK]
        if part.size < length:
            break
        h = gram_hashes(part, GRAM)
        low = np.uint64(2**20 - 1)
        key = (h & ~low) | (low - np.arange(h.size, dtype=np.uint64))
        found = low - (np.unique(sliding_min(key, length - GRAM + 1)) & low)
        at.append(found.astype(np.int64) + i)
        values.append(h[found.astype(np.int64)])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pos, first = np.unique(np.concatenate(at), return_index=True)
    return pos, np.concatenate(values)[first]


def _encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _occurrences(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r1, r2, text in zip(pdf["r1"], pdf["r2"], pdf["text"]):
                raw = _encoded(text)
                if len(raw) < length:
                    continue
                pos, h = anchors(np.frombuffer(raw, np.uint8), length)
                lo, hi = np.maximum(pos - (length - GRAM), 0), np.minimum(pos + length, len(raw))
                same = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], p - a) for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist())), np.uint64, pos.size)
                rows.append(pd.DataFrame({"r1": r1, "r2": r2, "pos": pos.astype(np.int32), "anchor": h.view(np.int64), "same": same.view(np.int64)}))
            if rows:
                yield pd.concat(rows)

    return lean(run)


def _contexts(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, wanted in zip(pdf["text"], pdf["wanted"]):
                raw = _encoded(text)
                for x in wanted:
                    p = x["pos"]
                    a = max(p - (length - GRAM), 0)
                    rows.append((x["anchor"], x["same"], x["kinds"], p - a, raw[a : p + length]))
            yield pd.DataFrame(rows, columns=["anchor", "same", "kinds", "before", "bytes"])

    return lean(run)


def repeated_windows(strings: list[tuple[int, bytes]], length: int) -> np.ndarray:
    """Which windows of aligned strings (bytes before the anchor, bytes) occur in another one at the same place.

    Empties the list. A row for each string; column s is the window from s - (length - GRAM) bytes before the anchor.
    """
    m, left = len(strings), length - GRAM
    width = left + length
    table = np.full((width, m), 255, np.uint8)  # a column of the collection is a row here; 255 isn't in UTF-8
    for i, (before, raw) in enumerate(strings):
        table[left - before : left - before + len(raw), i] = np.frombuffer(raw, np.uint8)
    strings.clear()  # the table has them
    found = np.zeros((left + 1, m), bool)
    order = np.arange(m)
    start = np.zeros(m, np.int32)  # where the common part of a string and the one before it in the order starts
    for j in range(width):
        symbols = table[j, order]  # this column of the transform
        to = np.argsort(symbols, kind="stable")
        sorted_ = symbols[to]
        # the common part of two strings that come together is the shortest of those in between
        levels = [start]
        while 2 ** len(levels) <= m:
            h = 2 ** (len(levels) - 1)
            levels.append(np.maximum(levels[-1][:-h], levels[-1][h:]))
        a, b = to[:-1] + 1, to[1:]
        with_prev = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != 255)
        new = np.full(m, j + 1, np.int32)
        k = np.flatnonzero(with_prev)
        if k.size:
            a, b = a[k], b[k]
            level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            values = np.empty(k.size, np.int32)
            for v in np.unique(level):
                at = level == v
                values[at] = np.maximum(levels[v][a[at]], levels[v][b[at] + 1 - 2**v])
            new[k + 1] = values
        order, start = order[to], new
        if j + 1 >= length:
            long = j + 1 - start >= length
            long[:-1] |= long[1:].copy()
            found[j + 1 - length, order] |= long
    return found.T


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _spans(keys: list, flags: np.ndarray, length: int) -> pd.DataFrame:
    rows = []
    for (anchor, same), row in zip(keys, flags):
        for a, b in zip(*_runs(row)):
            rows.append((anchor, same, int(a) - (length - GRAM), int(b) - 1 + length - (length - GRAM)))
    return pd.DataFrame(rows, columns=["anchor", "same", "lo", "hi"])


def _column_wise(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by anchor; a block ends where an anchor ends."""
        keys, strings, mark = [], [], 0
        for pdf in batches:
            for anchor, same, before, raw in zip(pdf["anchor"], pdf["same"], pdf["before"], pdf["bytes"]):
                if keys and keys[-1][0] != anchor:
                    mark = len(keys)
                if len(keys) >= BLOCK and mark == len(keys):
                    yield _spans(keys, repeated_windows(strings, length), length)
                    keys, strings, mark = [], [], 0
                keys.append((anchor, same))
                strings.append((before, raw))
        if keys:
            yield _spans(keys, repeated_windows(strings, length), length)

    return lean(run)


def _windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for anchor, same, before, raw in zip(pdf["anchor"], pdf["same"], pdf["before"], pdf["bytes"]):
                if len(raw) >= length:
                    h = gram_hashes(np.frombuffer(raw, np.uint8), length)
                    at = np.arange(h.size, dtype=np.int32) - np.int32(before)
                    yield pd.DataFrame({"anchor": anchor, "same": same, "at": at, "window": mix(h + at.astype(np.uint64)).view(np.int64)})

    return lean(run)


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
            raw = _encoded(text)
            gone = union([] if spans is None else [(x["a"], min(x["b"], len(raw))) for x in spans])
            parts, at = [], 0
            for a, b in gone:
                parts.append(raw[at:a])
                at = b
            kept = b"".join(parts) + raw[at:]
            rows.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [x for y in gone for x in y], kept.decode("utf-8", "ignore") if gone else text))
        frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "text"])
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(r1, r2, a, b): stretches of docs(r1, r2, text) that repeated windows cover; they may overlap."""
    met = cut(docs.mapInPandas(_occurrences(length), "r1 long, r2 long, pos int, anchor long, same long"), "met")
    kinds = met.groupBy("anchor", "same").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "pos")).alias("first"))
    kinds = cut(kinds, "kinds")
    per = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    per = cut(per.select("anchor", "kinds", F.col("kinds").alias("n")), "per")
    kinds = cut(matched(kinds, per, ["anchor"]).select("anchor", "same", "n", "kinds", "first"), "repeated")
    # contexts that occur more than once are covered whole; what else an anchor has is compared
    wanted = kinds.where("kinds > 1").groupBy("first.r1", "first.r2").agg(F.collect_list(F.struct("anchor", "same", F.col("first.pos").alias("pos"), "kinds")).alias("wanted"))
    contexts = docs.join(wanted, ROW).select("text", "wanted").mapInPandas(_contexts(length), "anchor long, same long, kinds long, before int, bytes binary")
    contexts = cut(contexts, "contexts")
    few = contexts.where(f"kinds <= {HOT}").select("anchor", "same", "before", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    spans = few.mapInPandas(_column_wise(length), "anchor long, same long, lo int, hi int")
    windows = cut(contexts.where(f"kinds > {HOT}").mapInPandas(_windows(length), "anchor long, same long, at int, window long"), "windows")
    twice = cut(windows.groupBy("window", "anchor", "at").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    hot = matched(windows, twice, ["window", "anchor", "at"]).select("anchor", "same", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    hot = hot.groupBy("anchor", "same").agg(F.sort_array(F.collect_set("lo")).alias("at"))
    step = "aggregate(at, CAST(array() AS array<struct<lo:int,hi:int>>), (s, x) -> IF(size(s) > 0 AND s[size(s) - 1].hi >= x, concat(slice(s, 1, size(s) - 1), array(named_struct('lo', s[size(s) - 1].lo, 'hi', x + {0}))), concat(s, array(named_struct('lo', x, 'hi', x + {0})))))"
    hot = hot.selectExpr("anchor", "same", f"inline({step.format(length)})")
    found = spans.union(hot).groupBy("anchor", "same").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    whole = F.array(F.struct(F.lit(-(2**30)).alias("lo"), F.lit(2**30).alias("hi")))
    on = ["anchor", "same"]
    marked = kinds.join(found, on, "left").select(*on, "n", F.when(F.col("n") > 1, whole).otherwise(F.col("parts")).alias("parts")).where("parts IS NOT NULL")
    marked = cut(marked, "marked")
    total = met.agg(F.count("*").alias("total"))
    often = marked.join(F.broadcast(total)).where(f"n * {SPLIT} > total").select(*on, "parts")
    rest = marked.join(F.broadcast(total)).where(f"n * {SPLIT} <= total").select(*on, "parts")
    every = met.join(F.broadcast(often), on).unionByName(met.join(F.broadcast(often.select(*on)), on, "left_anti").join(rest, on))
    every = every.select(*ROW, "pos", F.explode("parts").alias("p"))
    lo = F.greatest(F.col("p.lo"), F.lit(-(length - GRAM))) + F.col("pos")
    hi = F.least(F.col("p.hi"), F.lit(length)) + F.col("pos")
    return every.select(*ROW, F.greatest(lo, F.lit(0)).alias("a"), hi.alias("b"))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, text) for each row of docs(doc_id, text).

    removed: starts and ends of the removed runs in turn, in bytes; text: what is left, without the halves of characters that a run cut.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), "doc_id", "text")})
    spans = repeated_spans(rows.select(*ROW, "text"), length)
    per = spans.groupBy(*ROW).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = rows.join(per, ROW, "left").select("doc_id", "text", "spans")
    return out.mapInPandas(lean(_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>, text string")
