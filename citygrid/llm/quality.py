"""Quality classifier: a weak-label model over heuristic labellers, whose posterior labels train a hashed linear scorer.

Two questions are asked of a document: is it junk, is it abusive? For each:
1. labellers vote on every document (no, yes or nothing); a table of human labels, where there is one, is one labeller more;
2. votes are counted by pattern, over all documents; at most 3^labellers patterns, whatever the corpus;
3. expectation-maximisation on the pattern counts estimates each labeller's vote probabilities given the hidden class, and each
   pattern's posterior;
4. a linear scorer over hashed features (each distinct word, its first four to six and last three characters; for junk also the
   votes) is trained by FTRL with L1 on a bounded sample: at most SAMPLE documents by order of a hash of the id, those with human labels first, their
   labels the posteriors, both classes with half the weight where they can;
5. every document's whole text is scored. A document is rejected if either score is above zero.

Nulls: a null or blank text gets no votes but that it is blank, and is rejected as junk. Rows with a null doc_id are scored too.
Repeated rows are counted and scored each; of rows of one doc_id, one text at most is in the sample. Repeated labels of an id: the worst counts.
A very long text is scored whole. Other columns are not read. An empty table gives an empty result; without any vote of one class the scorer is constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, slices

BITS = 18
SAMPLE = 12_000
EPOCHS = 4
LONG, BLOCK = 5000, 500
SHARE = 20.0  #: weight of a text's words, all together, against that of its shape

#: Insults that a labeller looks for; what other words do is learned.
INSULTS = frozenset(b"idiot moron stupid pathetic loser worthless disgusting trash scum clown imbecile garbage".split())
#: Frequent words of four languages: prose has some.
FREQUENT = frozenset(
    "the of and to in is that it for as with was on be by this are from an at le la de et les des du un une est que pour dans qui "
    "par der die das und ist zu den von mit ein eine el los las y en del se por con una su para es".encode().split()
)

JUNK = ("symbols", "shouting", "stutter", "repeats", "prose")
ABUSE = ("insult", "insults")
QUESTIONS = {"junk": JUNK, "abuse": ABUSE}


def repeats(words: list[bytes], distinct: int) -> bool:
    """Whether under a quarter of the words are distinct. Long prose has that too, so from LONG words on its blocks of BLOCK words or its five-word runs must."""
    n = len(words)
    if n < LONG:
        return distinct < 0.25 * n
    if sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK)) < 0.25 * n:
        return True
    return len(set(zip(*[words[i:] for i in range(5)]))) < 0.25 * n


def votes(text: str | None) -> tuple[dict[str, list[int]], list[bytes]]:
    """Votes by question (1: bad, 0: fine, -1: none), and the text's distinct words in lower case."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return {"junk": [1, 1, 1, 1, -1], "abuse": [-1, -1]}, []
    distinct = set(words)
    symbols = sum(map(raw.count, (b"#", b"$", b"%", b"&", b"*", b"|"))) / len(raw)
    shout = raw.count(b"!!") / n
    stutter = sum(map(bytes.__eq__, words, words[1:])) / n
    low = {w.lower() for w in distinct}
    bare = {w.strip(b".,;:!?\"'()") for w in low}
    insults = len(bare & INSULTS)
    junk = [
        1 if symbols > 0.02 else -1,
        1 if shout > 0.2 else -1,
        1 if n >= 20 and stutter > 0.2 else -1,
        1 if n >= 40 and repeats(words, len(distinct)) else -1,
        0 if symbols < 0.005 and shout < 0.02 and stutter < 0.1 and (n < 40 or len(bare & FREQUENT) > 3) else -1,
    ]
    return {"junk": junk, "abuse": [1 if insults else -1, 1 if insults > 1 else -1]}, list(low)


def _hash(x: bytes, kind: int) -> int:
    return xxhash.xxh3_64_intdigest(x, kind) & ((1 << BITS) - 1)


def word_features(w: bytes) -> tuple[int, ...]:
    return (_hash(w, 0), _hash(w[:4], 1), _hash(w[:5], 2), _hash(w[:6], 3), _hash(w[-3:], 4))


def vote_features(given: dict[str, list[int]]) -> list[int]:
    """Of junk only: what the text's shape shows isn't in its words; insults are."""
    return [_hash(f"junk/{i}/{v}".encode(), 5) for i, v in enumerate(given["junk"])]


def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            v = votes(text)[0]
            rows.append((doc, "".join(".01"[x + 1] for x in v["junk"]), "".join(".01"[x + 1] for x in v["abuse"])))
        frame = pd.DataFrame(rows, columns=["doc_id", "junk", "abuse"])
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def expectation_maximisation(patterns: list[str], counts: np.ndarray, human: bool, rounds: int = 60) -> np.ndarray:
    """Posterior chance of the bad class for each pattern of votes ('.', '0' or '1' a labeller; the last is the human one)."""
    if not patterns:
        return np.empty(0)
    v = np.array([[".01".index(c) for c in p] for p in patterns])
    m = v.shape[1]
    n = counts / counts.sum()
    # a labeller is believed to be right more often than not, human labels more so; pseudo-counts are shares of the corpus
    prior = np.full((m, 2, 3), 1e-4)
    prior[:, 0, 1] = prior[:, 1, 2] = 1e-3
    chance = np.full((m, 2, 3), 0.0)
    chance[:, 0], chance[:, 1] = (0.6, 0.38, 0.02), (0.6, 0.02, 0.38)
    if human:  # that nobody looked at a document says nothing of it
        prior[-1] = [[0, 0.5, 0.5e-3], [0, 0.5e-3, 0.5]]
        chance[-1] = [[0, 0.999, 0.001], [0, 0.001, 0.999]]
    share = 0.1
    for _ in range(rounds):
        each = np.log(np.maximum(chance, 1e-12))
        if human:
            each[-1, :, 0] = 0
        logs = each[np.arange(m)[None, :], :, v].sum(axis=1) + np.log([1 - share, share])
        bad = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        weight = np.stack((n * (1 - bad), n * bad))
        share = float(np.clip(weight[1].sum(), 1e-6, 0.6))
        for j in range(m):
            for k in range(3):
                chance[j, :, k] = (weight * (v[:, j] == k)).sum(axis=1) + prior[j, :, k]
        if human:
            chance[-1, :, 0] = 0
        chance /= chance.sum(axis=2, keepdims=True)
    return bad


def ftrl(words: list[np.ndarray], shapes: list[np.ndarray], target: np.ndarray, weight: np.ndarray, alpha: float = 0.1, l1: float = 1.0, l2: float = 1.0) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias), by FTRL-proximal steps in the given order.

    With shapes (features of the votes): words count by their share, so that long texts are no different, and shapes by 1. Without:
    each word counts by 1 and only against the text, so that one word can tell and many plain ones don't outweigh it.
    """
    z, s = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(s[i])) / alpha + l2))
        return w if shapes else np.maximum(w, 0)

    rows = []
    for j, x in enumerate(words):
        i, k = np.unique(x, return_counts=True)
        k = SHARE * k / max(x.size, 1) if shapes else np.minimum(k, 3).astype(float)
        extra = shapes[j] if shapes else x[:0]
        rows.append((np.concatenate((i, extra, [1 << BITS])), np.concatenate((k, np.ones(extra.size + 1)))))
    bias = 1 << BITS
    for _ in range(min(40, max(EPOCHS, EPOCHS * SAMPLE // max(len(rows), 1)))):  # about as many steps for few rows
        for (i, k), y, g in zip(rows, target, weight):
            w = weights(i)
            if not shapes:
                w[-1] = -z[bias] / ((1.0 + np.sqrt(s[bias])) / alpha + l2)  # the bias may have either sign
            d = (1 / (1 + np.exp(-np.clip((w * k).sum(), -30, 30))) - y) * g * k
            t = (np.sqrt(s[i] + d * d) - np.sqrt(s[i])) / alpha
            z[i] += d - t * w
            s[i] += d * d
    out = weights(slice(None))
    if not shapes:
        out[-1] = -z[bias] / ((1.0 + np.sqrt(s[bias])) / alpha + l2)
    return out.astype(np.float32)


def _sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        x, shape = [], []
        for text in pdf["text"]:
            v, words = votes(text)
            x.append(np.array([f for w in words for f in word_features(w)], np.int32).tobytes())
            shape.append(np.array(vote_features(v), np.int32).tobytes())
        yield pdf[["place", *QUESTIONS]].assign(x=x, shape=shape)


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(batches)).sort_values("place")  # at most SAMPLE rows
    words, shapes = ([np.frombuffer(x, np.int32) for x in pdf[c]] for c in ("x", "shape"))
    for q in QUESTIONS:
        y = pdf[q].to_numpy(float)
        bad = max(float(y.sum()), 1.0)
        weight = np.where(y > 0.5, np.clip(0.5 * len(y) / bad, 1, 6), 1.0)
        yield pd.DataFrame({"question": [q], "weights": [ftrl(words, shapes if q == "junk" else [], y, weight).tobytes()]})


class Scorer:
    """Scores of texts by question: log-odds of being bad. Words' sums are remembered."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = np.stack([weights[q] for q in QUESTIONS], axis=1).astype(np.float64) if weights else np.zeros(((1 << BITS) + 1, len(QUESTIONS)))
        self.both = (self.w[:, 0] + 1j * self.w[:, 1]).tolist()  # both questions at once, as one number's parts
        self.known: dict[bytes, complex] = {}

    def _word(self, w: bytes) -> complex:
        s = self.known.get(w)
        if s is None:
            if len(self.known) > 100_000:
                self.known.clear()
            a, b, c, d, e = word_features(w)
            both = self.both
            s = self.known[w] = both[a] + both[b] + both[c] + both[d] + both[e]
        return s

    def score(self, text: str | None) -> tuple[float, float]:
        v, words = votes(text)
        if not words:
            return 1.0, -1.0
        s = sum(map(self._word, words), 0j)
        junk = SHARE * s.real / (5 * len(words)) + self.w[vote_features(v), 0].sum() + self.w[-1, 0]
        return float(junk), float(s.imag + self.w[-1, 1])


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights by question, from docs(doc_id, text). labels: (doc_id, quality, toxic), 0 or 1 or null."""
    spark = docs.sparkSession
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voted = doc.mapInPandas(lean(_codes), "doc_id long, junk string, abuse string")
    if labels is not None:
        said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).alias("q"), F.max("toxic").alias("t"))
        voted = voted.join(said, "doc_id", "left")
        human = lambda c: F.when(F.col(c).isin(0, 1), F.col(c).cast("int").cast("string")).otherwise(".")
        voted = voted.select("doc_id", F.concat("junk", human("q")).alias("junk"), F.concat("abuse", human("t")).alias("abuse"))
    voted = cut(voted, "votes")
    posterior = {}
    for q in QUESTIONS:
        found = voted.groupBy(q).agg(F.count("*").alias("n")).toPandas().sort_values(q)  # at most 3^6 rows
        bad = expectation_maximisation(list(found[q]), found["n"].to_numpy(float), labels is not None)
        posterior[q] = spark.createDataFrame([(p, float(b)) for p, b in zip(found[q], bad)], f"{q} string, {q}_bad double")
    labelled = voted
    for q in QUESTIONS:
        labelled = labelled.join(F.broadcast(posterior[q]), q)
    place = F.xxhash64("doc_id")
    human_first = (F.col("junk").endswith(".") & F.col("abuse").endswith(".")).cast("int") if labels is not None else F.lit(0)
    chosen = labelled.where("doc_id IS NOT NULL").select("doc_id", place.alias("place"), human_first.alias("rank"), F.col("junk_bad").alias("junk"), F.col("abuse_bad").alias("abuse")).orderBy("rank", "place", "doc_id").limit(sample)
    chosen = cut(chosen, "chosen")
    texts = doc.join(F.broadcast(chosen.select("doc_id", "place", *QUESTIONS)), "doc_id").dropDuplicates(["doc_id"])  # chosen: at most `sample` short rows
    features = cut(texts.mapInPandas(lean(_sample_features), "place long, junk double, abuse double, x binary, shape binary"), "features")
    models = features.coalesce(1).mapInPandas(lean(_train), "question string, weights binary").collect() if features.limit(1).count() else []
    return {m["question"]: np.frombuffer(m["weights"], np.float32) for m in models}


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, junk_score, abuse_score, kept) for each row of docs(doc_id, text)."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))  # 2^BITS weights a question

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in slices(batches):
            s = np.array([scorer.score(t) for t in pdf["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "junk_score": s[:, 0], "abuse_score": s[:, 1], "kept": (s <= 0).all(axis=1)})

    return doc.mapInPandas(lean(scored), "doc_id long, junk_score double, abuse_score double, kept boolean")


def keeps(text: Column, weights: dict[str, np.ndarray], spark: SparkSession) -> Column:
    """True where the classifier keeps the text."""
    shared = spark.sparkContext.broadcast(weights)

    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in batches:
            yield pd.Series([max(scorer.score(t)) <= 0 for t in s], dtype=bool)

    return F.pandas_udf(lean(kept), "boolean")(text)
