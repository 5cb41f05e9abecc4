"""Line dedup, vector codes and dual-tree clustering against plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citygrid.llm import dual_tree, line_dedup, vector_codes

from . import fixtures

BLANKS = " \t\n\x0b\x0c\r"


def lines_brute(rows, least=10, documents=2):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(BLANKS))
    at = lambda i: 2**63 - 1 if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            held[key(s)].add(at(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < least or len(held[key(s)]) < documents or min(held[key(s)]) == at(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("documents", [2, 3])
def test_lines(spark, documents):
    shared = ["All rights reserved.", "  ALL rights RESERVED.\t", "\x0b\x0call rights reserved.\r", "Ärger über alles", "ärger über alles", "short", "abcdefghij", "abcdefghi", "é" * 10, " " * 20, ""]
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice([*shared, fixtures.prose(rnd, 4)]) for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "All rights reserved.\nAll rights reserved."), (None, "only without id\nAll rights reserved."), (None, "only without id"), (5, "a line of doc five"), (5, "a line of doc five")]
    rows += [(104, "\n".join(["abcdefghij"] * 3000 + ["own line number %d" % i for i in range(3000)])), (105, "x" * 200_000 + "\n" + "x" * 200_000), (106, "x" * 200_000 + " ")]
    rows += [(200 + i, t) for i, t in enumerate(["All rights reserved."] * 50)] + fixtures.documents()
    df = fixtures.frame(spark, rows).selectExpr("*", "1 AS at", "2 AS pos", "3 AS k0", "4 AS gone", "5 AS first", "6 AS t0")
    got = line_dedup.drop_shared_lines(df, documents=documents).collect()
    assert sorted((tuple(r) for r in got), key=str) == lines_brute(rows, documents=documents)
    assert line_dedup.drop_shared_lines(df.limit(0)).count() == 0


def test_lines_of_no_keys(spark):
    got = line_dedup.drop_shared_lines(fixtures.frame(spark, [(1, "one"), (2, None), (3, "two\none")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0, "one"), (2, 1, 0, ""), (3, 2, 0, "two\none")]


def whole(v, scale):
    return [max(-(1 << 26), min(1 << 26, math.floor(scale * float(np.float32(x))))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def codes_brute(rows, parts, entries, rounds, scale=256):
    kept = [(i, g, whole(v, scale)) for i, v, g in rows if usable(v)]
    width = -(-max(len(v) for _, _, v in kept) // parts)
    kept = [(i, g, v + [0] * (parts * width - len(v))) for i, g, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            by = defaultdict(list)
            for _, _, v in kept:
                by[near(v, p)[1]].append(cut(v, p))
            for e, xs in by.items():
                new[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    rows, total = [], defaultdict(int)
    for i, g, v in kept:
        best = [near(v, p) for p in range(parts)]
        rows.append((i, g, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        total[g] += rows[-1][-1]
    return sorted(((i, g, c, e, total[g], digest) for i, g, c, e in rows), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS row", "'y' AS n", "'z' AS key0", "'w' AS code", "'c' AS cluster")


def some_vectors(n, d, seed=2):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rnd.normal(0, 0.2, d) + (i % 5))], int(i % 4) if i % 7 else None) for i in rnd.permutation(n)]
    rows += [(n, None, 1), (n + 1, [0.1] * (d - 1) + [None], 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] * d, 1)]
    rows += [(None, [0.25] * d, None), (2**60 + 1, [0.75] * d, 5), (3, [0.5] * d, 2), (3, [0.5] * d, 2)] + [(n + 10 + i, [1.5] * d, 9) for i in range(n // 2)]  # a third of all is one vector
    return rows


@pytest.mark.parametrize(("n", "d", "parts", "entries", "rounds"), [(90, 64, 16, 64, 2), (150, 8, 4, 10, 3), (40, 10, 4, 5, 1), (6, 12, 3, 64, 2), (30, 96, 2, 8, 2)])
def test_codes(spark, n, d, parts, entries, rounds):
    rows = some_vectors(n, d)
    got = vector_codes.compress(vectors(spark, rows), parts, entries, rounds).collect()
    assert sorted((tuple(r) for r in got), key=str) == codes_brute(rows, parts, entries, rounds)


def test_codes_of_odd_tables(spark):
    rows = [(1, [1e30, -1e30], 1), (2, [], None), (3, [0.5], None), (4, [-3.25, 2.0], 1)]
    got = vector_codes.compress(vectors(spark, rows), 2, 2, 2).collect()
    assert sorted((tuple(r) for r in got), key=str) == codes_brute(rows, 2, 2, 2)
    assert vector_codes.compress(vectors(spark, rows).limit(0)).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    assert [r["label_error"] for r in vector_codes.compress(vectors(spark, rows).select("vec_id", "embedding"), 2, 4).collect()] == [0] * 4


def lloyd_brute(rows, clusters, rounds, width, scale=1024, seed="3"):
    kept = [(i, whole(v, scale)) for i, v, _ in rows if usable(v) and len(v) == width]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[1]))[:clusters]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[near(v)[1]].append(v)
        for k, xs in by.items():
            cents[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    each = defaultdict(int)
    for _, k, dd in out:
        each[k] += dd
    return sorted(((i, k, dd, each[k], sum(each.values()), sha(",".join(map(str, cents[k])))) for i, k, dd in out), key=str)


@pytest.mark.parametrize(("n", "d", "clusters", "rounds"), [(300, 64, 8, 10), (400, 3, 20, 4), (5, 4, 8, 3), (250, 2, 1, 2)])
def test_clusters(spark, n, d, clusters, rounds):
    rows = some_vectors(n, d) + [(7000, [0.1] * (d + 1), 1)]
    got = dual_tree.cluster(vectors(spark, rows), clusters, rounds, width=d, block=100).collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd_brute(rows, clusters, rounds, d)
    assert dual_tree.cluster(vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["tight", "line", "grid", "equal", "random"])
def test_two_trees_prune_and_agree_with_all_pairs(kind):
    rnd = np.random.default_rng(5)
    x = {
        "tight": rnd.integers(0, 6, (900, 1)) * 1000 + rnd.integers(0, 20, (900, 4)),
        "line": np.arange(900)[:, None] * np.array([3, 0]),
        "grid": np.stack(np.meshgrid(np.arange(30), np.arange(30)), -1).reshape(-1, 2),  # many ties
        "equal": np.full((900, 3), 7),
        "random": rnd.integers(-1000, 1000, (900, 16)),
    }[kind].astype(np.int64)
    nodes, order = dual_tree.cover_tree(x, 8)
    assert sorted(order) == list(range(900))
    p = x[order].astype(float)
    for v in nodes:
        inside = p[v["start"] : v["end"]]
        assert np.sqrt(((inside - p[v["centre"]]) ** 2).sum(1)).max() <= v["radius"] * (1 + 1e-12)
        if v["children"]:
            under = nodes[v["child"] : v["child"] + v["children"]]
            assert under["start"][0] == v["start"] and under["end"][-1] == v["end"] and (under["start"][1:] == under["end"][:-1]).all()
            assert (under["radius"] <= v["radius"] / 2 * (1 + 1e-12)).all()
    for k in (1, 7, 60):
        c = x[rnd.integers(0, 900, k)] + (0 if kind in ("grid", "equal") else 1)
        tree, number = dual_tree.cover_tree(c, 1)
        near, gone = dual_tree.dual_assign(x[order], nodes, c[number], tree, number)
        d2 = ((x[order][:, None, :] - c[None]) ** 2).sum(-1)
        assert (near == d2.argmin(1)).all()
        if kind in ("tight", "line") and k == 7:  # most vectors were never looked at
            assert sum(int((nodes["end"][q] - nodes["start"][q]).sum()) for q, _ in gone) > 450


def test_queries_sum_up(spark):
    rows = some_vectors(60, 64)
    got = dual_tree.cluster(vectors(spark, rows)).agg(F.sum("distance"), F.max("inertia")).first()
    assert got[0] == got[1]
