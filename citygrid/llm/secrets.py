"""Secrets in texts: patterns, and a randomness test battery with false-discovery control by encoding and length.

Patterns (kinds assign, access, hex) find their spans outright; what they find is put through the battery too, and the p-values are told.
Besides, each run of LEAST or more of [A-Za-z0-9+/_=-] that touches no pattern's span is a candidate. Its encoding (decimal, hex, one case
of letters, base32, base62, base64) gives its alphabet, in an order that puts letters frequent in prose together. Under the hypothesis of
independent, uniform symbols three tests give p-values, Fisher's method joins them:
- chi-squared over an odd number of equal parts of the alphabet (an even number of degrees of freedom: the tail is a finite sum);
- Wald and Wolfowitz's runs above and below the alphabet's middle;
- serial correlation of neighbours.
Random strings' p are uniform, other strings' are near 0, the nearer the longer they are. How near is measured: each text gives one string
of its own words, joined as a long word or as an identifier, of a length and at a place that its hash says. In each stratum (encoding,
length class) all candidates and all such strings of the corpus are counted by p, in PARTS bins. Candidates above MIDDLE, less the share
of prose there, estimate the random ones (Storey); the smallest p is then found from which on no more than RATE of the candidates are not
random, by what prose would have there and by what the random ones leave unexplained. A stratum's counts are drawn towards those of its
encoding, with the weight of PULL strings. Candidates from that p on are added, as kind random.

Nulls: a null or empty text has no spans. Texts are looked at whole. Repeated rows count as they stand.
scan() reads no other columns; redacted() returns all of them as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, lean

KINDS = ("assign", "access", "hex", "random")
PARTS, MIDDLE, RATE, PULL, LEAST = 200, 0.3, 0.1, 50, 16

_WORDS = ("passw", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_RUN = re.compile("[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_LETTERS_ONLY = re.compile("[A-Za-z]+")

_LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
_ALPHABETS = {
    "decimal": "0123456789",
    "letters": _LETTERS,
    "hex": "0123456789abcdef",
    "base32": "234567" + _LETTERS.upper(),
    "base62": "0123456789" + _LETTERS.upper() + _LETTERS,
    "base64": "0123456789+/" + _LETTERS.upper() + _LETTERS,
}


def chi_tail(x: float, df: int) -> float:
    """P(chi-squared > x) for an even number of degrees of freedom."""
    h, term, total = x / 2, 1.0, 1.0
    for i in range(1, df // 2):
        term *= h / i
        total += term
    return min(1.0, math.exp(-h) * total) if h < 700 else 0.0


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


_CODES = (("decimal", "[0-9]+"), ("hex", "[0-9a-f]+|[0-9A-F]+"), ("letters", "[a-z]+|[A-Z]?[a-z]+|[A-Z]+"), ("base32", "[A-Z2-7]+"), ("base62", "[A-Za-z0-9]+"))
_CODES = tuple((k, re.compile(p)) for k, p in _CODES)


def encoding(s: str) -> str:
    body = s.rstrip("=")
    return next((k for k, p in _CODES if p.fullmatch(body)), "base64")


def battery(s: str) -> tuple[str, float]:
    """The encoding, and the joint p-value of uniform, independent symbols."""
    kind = encoding(s)
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    alphabet = _ALPHABETS[kind]
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in (body.lower() if kind in ("hex", "letters") else body) if c in place], float)
    n, a = x.size, len(alphabet)
    if n < 8:
        return kind, 0.0
    parts = min(9, max(3, (n // 5) | 1))
    edges = np.linspace(0, a, parts + 1)
    expected = np.diff(np.ceil(edges)) / a * n
    counts = np.histogram(x, np.ceil(edges) - 0.5)[0]
    p1 = chi_tail(float(((counts - expected) ** 2 / expected).sum()), parts - 1)
    high = x >= a / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 == 0 or n1 == 0:
        return kind, 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n0 * n1 / n
    var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p2 = _two_sided((runs - mean) / math.sqrt(var))
    y = x - x.mean()
    p3 = _two_sided((float((y[1:] * y[:-1]).sum() / max((y * y).sum(), 1e-9)) + 1 / n) * math.sqrt(n))
    return kind, chi_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3)), 6)


def length_class(n: int) -> int:
    return min(n // 8, 10)


Span = tuple[int, int, int]  #: start, kind, end


def pattern_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _stratum(kind: str, n: int) -> str:
    return f"{kind}/{length_class(n)}"


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, str, float]]:
    """(start, end, stratum, p)"""
    out = []
    for m in _RUN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, _, b in base):
            kind, p = battery(m[0])
            out.append((m.start(), m.end(), _stratum(kind, len(m[0])), p))
    return out


def prose_string(text: str) -> str | None:
    """A string of the text's own words that nobody made at random: a long word of one case, or an identifier. None if the text is too short."""
    text = _RUN.sub(" ", text)  # long runs may be keys themselves
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    style, n, at = h % 4, LEAST + (h >> 2) % 72, (h >> 10) % max(len(text), 1)
    words = [w for w in _LETTERS_ONLY.findall(text[at : at + 4 * n + 40] + " " + text[: min(at, 4 * n)]) if len(w) > 1]
    if style < 2:
        s = "".join(words)[:n]
        s = s.lower() if style == 0 else s.upper()
    else:
        end = str(h % 97)
        s = ("".join(w.capitalize() for w in words) if style == 2 else "_".join(w.lower() for w in words))[: n - len(end)] + end
    return s if len(s) == n else None


def base_values(text: str, base: list[Span]) -> Iterator[tuple[Span, float]]:
    """The p-value of each pattern's secret: of an assignment, what is assigned."""
    for a, k, b in base:
        m = _ASSIGN.match(text, a, b) if k == 0 else None
        yield (a, k, b), battery(m[2] if m else text[a:b])[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _part(p: float) -> int:
    return min(int(p * PARTS), PARTS - 1)


def look(text: str | None) -> tuple[list[Span], list[tuple[int, int, str, float]], str | None, float]:
    """Pattern spans, candidates, and the stratum and p of the text's own string."""
    if not text:
        return [], [], None, 0.0
    base = pattern_spans(text)
    own = prose_string(text)
    if own is None:
        return base, candidates(text, base), None, 0.0
    kind, p = battery(own)
    return base, candidates(text, base), _stratum(kind, len(own)), p


_FOUND = "array<struct<start:int,end:int,stratum:string,part:int>>"


def _found(found: list[tuple[int, int, str, float]]) -> list[dict]:
    return [{"start": a, "end": b, "stratum": s, "part": _part(p)} for a, b, s, p in found]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            base, found, own, p = look(text)
            tested = ",".join(f"{KINDS[k]}:{a}:{b}:{q:.3f}" for (a, k, b), q in base_values(text, base)) if base else ""
            rows.append((
                doc, *(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base), tested, _found(found), own, _part(p),
            ))
        frame = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "base_p", "found", "own", "own_part"])
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def levels(counted: pd.DataFrame, prose: pd.DataFrame) -> dict[str, int]:
    """The part of [0, 1] from which on a stratum's candidates are taken (PARTS: none). Both (stratum, part, n): all candidates, all texts' own strings."""

    def histograms(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        h: dict[str, np.ndarray] = {}
        for s, part, n in rows.itertuples(index=False):
            for key in (s, s.split("/")[0]):
                h.setdefault(key, np.zeros(PARTS))[int(part)] += n
        return h

    seen, own = histograms(counted), histograms(prose)

    def drawn(h: dict[str, np.ndarray], s: str) -> np.ndarray:
        """A stratum's counts and PULL more of its encoding's shape."""
        whole = h.get(s.split("/")[0])
        return np.zeros(PARTS) if whole is None else h.get(s, 0) + PULL * whole / whole.sum()

    start, from_ = int(MIDDLE * PARTS), 1 - np.arange(PARTS) / PARTS

    def level(s: str) -> int:
        above = np.cumsum(drawn(seen, s)[::-1])[::-1]
        a = np.cumsum(drawn(own, s)[::-1])[::-1]
        a = a / a[0] if a[0] > 0 else a  # the share of prose from each part on
        n = above[0]
        random = float(np.clip((above[start] - n * a[start]) / max(1 - MIDDLE - a[start], 0.05), 0, n))
        if random <= 0:
            return PARTS
        false = np.maximum((n - random) * a, above - random * from_) / np.maximum(above, 1e-9)
        good = np.flatnonzero(false[: start + 1] <= RATE)
        return int(good[0]) if good.size else PARTS

    return {s: level(s) for s in seen if "/" in s}


def _levels_of(seen: DataFrame) -> dict[str, int]:
    """seen: (found, own, own_part) of all texts."""
    one = seen.select(F.explode("found").alias("x")).groupBy("x.stratum", "x.part").agg(F.count("*").alias("n"))
    own = seen.where("own IS NOT NULL").groupBy(F.col("own").alias("stratum"), F.col("own_part").alias("part")).agg(F.count("*").alias("n"))
    return levels(one.toPandas(), own.toPandas())  # at most 66 strata of PARTS parts each


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, base_p) for each row of docs(doc_id, text); offsets are code points.

    base_p: kind:start:end:p of each pattern's span.
    """
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, base_p string, found {_FOUND}, own string, own_part int"
    seen = cut(doc.mapInPandas(lean(_scan), schema), "secrets")
    level = _levels_of(seen)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for base, found in zip(pdf["base"], pdf["found"]):
                more = [(x["start"], 3, x["end"]) for x in found if x["part"] >= level[x["stratum"]]]
                have = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                spans.append(joined(have + more))
            yield pdf[["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]].assign(doc_id=pdf["doc_id"].astype("Int64"), spans=spans, base_p=pdf["base_p"])

    out = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, base_p string"
    return seen.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "base_p", "found").mapInPandas(lean(add), out)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of the text replaced by a mark. Texts are scanned once: docs and what was found are written, and read again for the replacement."""

    @F.pandas_udf(f"struct<base:array<int>,found:{_FOUND},own:string,own_part:int>")
    def seen(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, found, own, p = look(t)
            rows.append(([x for a, _, b in base for x in (a, b)], _found(found), own, _part(p)))
        return pd.DataFrame(rows, columns=["base", "found", "own", "own_part"])

    name = free("_seen", docs)
    both = cut(docs.withColumn(name, seen(F.col("text").cast("string"))), "secrets")
    level = _levels_of(both.select(f"{name}.found", f"{name}.own", f"{name}.own_part"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, base: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, x, y in zip(texts, base, found):
            spans = list(zip(x[::2], x[1::2])) + [(z["start"], z["end"]) for z in y if z["part"] >= level[z["stratum"]]]
            parts, at = [], 0
            for a, b in sorted(spans):
                if b > at:
                    parts += [t[at:a], mark] if a >= at else []
                    at = b
            out.append("".join(parts) + t[at:] if spans else t)
        return pd.Series(out, dtype=object)

    text = F.when(F.col("text").isNotNull(), clean(F.col("text").cast("string"), f"{name}.base", f"{name}.found"))
    return both.withColumn("text", text).select(*docs.columns)
