"""Small document sets with what the operators must bear: nulls, blanks, ties, repeats, long texts, clashing columns."""

import random

WORDS = [a + b for a in "ka lo mi nu pe ra so ti vu".split() for b in "lan der mon sit gor wep".split()]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def documents(seed=1):
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(30, 160)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 40):
        w = base[i % 6].split()
        for _ in range(rnd.choice([0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w)))
    shared = prose(rnd, 90)
    rows += [(50 + i, prose(rnd, 20 + i) + " " + shared + " " + prose(rnd, 15)) for i in range(5)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "one two"), (64, "ONE  two"), (65, "one two three"), (66, prose(rnd, 4000)), (67, "a" * 1500), (68, "é" * 700), (69, "the " * 300)]
    rows += [(70, "x y z w v"), (70, "x y z w v"), (None, base[0]), (71, base[0].upper())]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("node", "label", "kept", "start", "score", "length", "same", "piece", "found", "key"):
            df = df.selectExpr("*", f"'clash' AS `{c}`")
    return df
