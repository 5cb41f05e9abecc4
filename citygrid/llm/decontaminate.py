"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

Texts are compared with A-Z in lower case and white space collapsed. A passage is any PASSAGE bytes of an item, at every offset, and is
found where a stretch of a document is within k = 0.08 PASSAGE edits of it. An item of under 2 PASSAGE bytes is also looked for whole,
within 0.08 of its length; under Q bytes it is found only without edits and as whole words.
The q-gram lemma: such a stretch shares at least w + 1 - q (k + 1) q-grams with its w bytes, on at most k + 1 neighbouring diagonals.
So q-grams that are in the benchmark are counted in bands of 2 (k + 1) diagonals that overlap by half, for passages within each run of
w bytes of the item, and what has enough is aligned, over the stretch that the band spans.

The benchmark is taken in blocks of at most BLOCK bytes of text (by a hash of the item), each of which goes to all tasks: a stated
query set against all rows, in blocks. Documents are neither shuffled nor gathered.
Nulls: a null text has no passages; an item without text gives none. Repeated rows give repeated results. A row without doc_id reports it as null.
A very long text is searched whole, in linear time. Other columns are not read; without documents or without a benchmark nothing is found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

Q = 8
PASSAGE = 50
BLOCK = 4_000_000
_FILTER = 22  #: bits of the filter's address


def normal(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def grams(raw: bytes) -> np.ndarray:
    """The Q-grams as numbers, without a copy of the bytes."""
    return np.ndarray((max(len(raw) - Q + 1, 0),), "<u8", raw, strides=(1,)).copy() if len(raw) >= Q else np.empty(0, "<u8")


def budget(w: int) -> int:
    return max(0, min(w * 8 // 100, (w + 1 - 4) // Q - 1))


def edits(pattern: bytes, stretch: bytes) -> tuple[int, int]:
    """Least edits that make the pattern a part of the stretch, and the end of that part (bit-parallel columns)."""
    m, ones = len(pattern), (1 << len(pattern)) - 1
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    up, down, score, best, end = ones, 0, m, m, 0
    high = 1 << (m - 1)
    for j, c in enumerate(stretch):
        eq = at[c]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(xh | up) & ones), up & xh
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & ones, (minus << 1) & ones
        up, down = minus | (~(xv | plus) & ones), plus & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def window_edits(windows: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edits() of each row of windows (at most 64 bytes) and the same row of stretches, all rows at once; a byte of -1 equals none."""
    m, one = windows.shape[1], np.uint64(1)
    bits = one << np.arange(m, dtype=np.uint64)
    ones, high = np.uint64((1 << m) - 1), bits[-1]
    up, down = np.full(len(windows), ones), np.zeros(len(windows), np.uint64)
    score, best, end = np.full(len(windows), m), np.full(len(windows), m), np.zeros(len(windows), np.int64)
    for j in range(stretches.shape[1]):
        eq = np.where(windows == stretches[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(xh | up) & ones), up & xh
        score = score + ((plus & high) > 0) - ((minus & high) > 0)
        plus, minus = (plus << one) & ones, (minus << one) & ones
        up, down = minus | (~(xv | plus) & ones), plus & xv
        less = score < best
        best, end = np.where(less, score, best), np.where(less, j + 1, end)
    return best, end


class Benchmark:
    """Whole short items and the passages of all others, of a block of items (id, text), and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = [(item, normal(text)) for item, text in items]
        self.words: dict[bytes, list[int]] = defaultdict(list)
        for item, raw in texts:
            if 0 < len(raw) < Q:
                self.words[raw].append(item)
        both = sorted(self.words, key=len, reverse=True)
        # a look-ahead, so that items that overlap are all found: one scan per length
        self.scans = [re.compile(rb"(?<![0-9a-z_\x80-\xff])(?=(" + b"|".join(re.escape(x) for x in both if len(x) == n) + rb")(?![0-9a-z_\x80-\xff]))") for n in sorted({*map(len, both)})]
        whole = [x for x in texts if Q <= len(x[1]) < 2 * PASSAGE]
        parts = [x for x in texts if len(x[1]) >= PASSAGE]
        self.items, self.patterns = [x[0] for x in whole + parts], [x[1] for x in whole + parts]
        self.whole, table = len(whole), []
        for i, p in enumerate(self.patterns):
            g = grams(p)
            table.append(np.rec.fromarrays([g, np.full(g.size, i), np.arange(g.size)], names="g,p,o"))
        flat = np.concatenate(table) if table else np.empty(0, [("g", "<u8"), ("p", "<i8"), ("o", "<i8")])
        flat = flat[np.argsort(flat["g"], kind="stable")]
        self.g, self.first, self.n = np.unique(flat["g"], return_index=True, return_counts=True)
        self.p, self.o = flat["p"].astype(np.int64), flat["o"].astype(np.int64)
        self.seen = np.zeros(1 << _FILTER, bool)
        self.seen[self._address(self.g)] = True
        short = self.patterns[: self.whole]
        self.k = np.array([budget(len(p)) for p in short], np.int64)
        self.need = np.array([len(p) + 1 - Q * (budget(len(p)) + 1) for p in short], np.int64)
        # the passages' items on one line; two items' q-grams are PASSAGE apart at least
        size = np.array([len(p) for p in self.patterns], np.int64)
        self.at = np.cumsum(size + PASSAGE) - size
        self.last = self.at + size - PASSAGE
        self.line = np.frombuffer(b"".join(b"\0" * PASSAGE + p for p in self.patterns), np.uint8)

    @staticmethod
    def _address(g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) by item, in bytes of the normal text: the hull of its passages' places, and the edits of the best."""
        raw = normal(text)
        out: dict[int, tuple[int, int, int]] = {}

        def add(item: int, a: int, z: int, d: int) -> None:
            had = out.get(item)
            out[item] = (a, z, d) if had is None else (min(a, had[0]), max(z, had[1]), min(d, had[2]))

        for scan in self.scans:
            for m in scan.finditer(raw):
                for item in self.words[m[1]]:
                    add(item, m.start(1), m.end(1), 0)
        p, pos, o = self._hits(raw)
        short = p < self.whole
        self._find_whole(raw, p[short], pos[short], o[short], add)
        self._find_passages(raw, p[~short], pos[~short], o[~short], add)
        return [(item, *x) for item, x in sorted(out.items())]

    def _hits(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, place in the text, place in the pattern) of each q-gram of the text and equal one of a pattern."""
        none = np.empty(0, np.int64)
        g = grams(raw)
        if not g.size or not self.g.size:
            return none, none, none
        pos = np.flatnonzero(self.seen[self._address(g)])
        g = g[pos]
        i = np.minimum(np.searchsorted(self.g, g), self.g.size - 1)
        same = self.g[i] == g
        i, pos = i[same], pos[same]
        n = self.n[i]
        if not n.size:
            return none, none, none
        each = np.repeat(self.first[i] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return self.p[each], np.repeat(pos, n), self.o[each]

    def _find_whole(self, raw: bytes, p: np.ndarray, pos: np.ndarray, o: np.ndarray, add) -> None:
        if not p.size:
            return
        shift = 2 * PASSAGE
        band = (pos - o + shift) // (self.k[p] + 1)
        # a band takes in two halves: count by half, then add neighbours
        key = p * (1 << 40) + band
        keys, counts = np.unique(key, return_counts=True)
        nxt = np.searchsorted(keys, keys + 1)
        follows = (nxt < keys.size) & (keys[np.minimum(nxt, keys.size - 1)] == keys + 1)
        total = counts + np.where(follows, counts[np.minimum(nxt, keys.size - 1)], 0)
        before = np.searchsorted(keys, keys - 1)
        lone = ~((before < keys.size) & (keys[np.minimum(before, keys.size - 1)] == keys - 1))
        for kept, back, count in ((np.ones(keys.size, bool), 0, total), (lone, -1, counts)):
            for j in np.flatnonzero(kept & (count >= self.need[keys >> 40])):
                pattern, b = int(keys[j] >> 40), int(keys[j] & ((1 << 40) - 1)) + back
                k = int(self.k[pattern])
                lo = max(b * (k + 1) - shift - k, 0)
                hi = (b + 2) * (k + 1) - shift + len(self.patterns[pattern]) + k
                d, end = edits(self.patterns[pattern], raw[lo : max(hi, 0)])
                if d <= k:
                    add(self.items[pattern], max(lo + end - len(self.patterns[pattern]), 0), lo + end, d)

    def _find_passages(self, raw: bytes, p: np.ndarray, pos: np.ndarray, o: np.ndarray, add) -> None:
        k = budget(PASSAGE)
        need, span = PASSAGE + 1 - Q * (k + 1), PASSAGE - Q
        if p.size < need:
            return
        # diagonals on the line of all items: they tell items apart, as each has its own places there
        place = self.at[p] + o
        shift = int(self.line.size)
        half = (pos - place + shift) // (k + 1)
        key = np.unique(np.concatenate((half, half - 1)) * (1 << 32) + np.concatenate((place, place)))
        i = np.arange(key.size - need + 1)
        i = i[key[i + need - 1] - key[i] <= span]
        if not i.size:
            return
        band, first, last = key[i] >> 32, key[i] & ((1 << 32) - 1), key[i + need - 1] & ((1 << 32) - 1)
        item = np.searchsorted(self.at, first, "right") - 1
        lo, hi = np.maximum(last - span, self.at[item]), np.minimum(first, self.last[item])
        n = np.maximum(hi - lo + 1, 0)
        start = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.unique(np.repeat(band, n) * (1 << 32) + start)
        length = 2 * (k + 1) + PASSAGE + 2 * k
        pad = length + PASSAGE
        doc = np.concatenate((np.full(pad, -1, np.int16), np.frombuffer(raw, np.uint8).astype(np.int16), np.full(pad, -1, np.int16)))
        for c in range(0, both.size, 4096):
            band, start = both[c : c + 4096] >> 32, both[c : c + 4096] & ((1 << 32) - 1)
            lo = np.clip(band * (k + 1) - shift + start - k, -pad, len(raw) + PASSAGE)
            d, end = window_edits(self.line[start[:, None] + np.arange(PASSAGE)].astype(np.int16), doc[(lo + pad)[:, None] + np.arange(length)])
            ok = np.flatnonzero(d <= k)
            which = np.searchsorted(self.at, start[ok], "right") - 1
            for w in np.unique(which):
                j = ok[which == w]
                z = np.minimum(lo[j] + end[j], len(raw))
                add(self.items[w], max(int(z.min()) - PASSAGE, 0), int(z.max()), int(d[j].min()))


def blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark (item_id, text), at most about BLOCK bytes at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield Benchmark([tuple(x) for x in part.orderBy("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): a row for each row of docs(doc_id, text) and item of which it has a passage."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, edits int"
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for b in blocks(benchmark):
        shared = spark.sparkContext.broadcast(b)

        def found(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in slices(batches):
                rows = [(i, *x) for i, text in enumerate(pdf["text"]) for x in shared.value.find(text)]
                frame = pd.DataFrame([x[1:] for x in rows], columns=["item_id", "start", "end", "edits"])
                frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array[[x[0] for x in rows]])
                yield frame

        out = out.union(doc.mapInPandas(lean(found), schema))
    return out


def has_leak(text: Column, benchmark: DataFrame) -> Column:
    """True where the text has a passage of the benchmark."""
    spark, any_ = benchmark.sparkSession, F.lit(False)
    for b in blocks(benchmark):
        shared = spark.sparkContext.broadcast(b)

        @F.pandas_udf("boolean")
        def one(s: pd.Series) -> pd.Series:
            return pd.Series([bool(shared.value.find(t)) for t in s], dtype=bool)

        any_ = any_ | one(text)
    return any_
