"""Lloyd's method with two trees: cover trees over the vectors, and one over the centroids in each round.

Vectors are whole numbers. They are dealt into blocks of at most BLOCK, and each block gets a cover tree, built once and
written with its vectors in the tree's order: the blocks' trees are the branches of one tree whose root is all data. A node is a run of vectors with a
centre, which is one of them, and the distance of the farthest; the children's centres are more than half of that apart and cover their node within
half of it. A round builds the centroids' tree on the driver and sends it to every task, where the two trees are descended together:
* a pair of nodes is pruned if even the nearest centroid it could hold is farther than one that is known to be near enough for the
  whole node of vectors (bounds are kept SLACK apart, so that rounding and ties lose nothing);
* of a pair that stays, the node of larger radius is opened;
* a node left with one centroid goes to it whole, by sums of runs, without a look at its vectors;
* pairs of leaves are compared exactly, in whole numbers.
Tasks give a row per centroid (count and sums); Spark adds them up, and the driver holds centroids only.

Only vectors of exactly `width` components, none null or non-finite, take part and have a row; repeated ids are rows of their own, a null id is
drawn last as a first centroid. Components are cut off at plus and minus 2^26. Ties go to the smaller number; a centroid without
vectors stays. With fewer vectors than centroids there are as many centroids as vectors. Equal vectors are a node of radius 0 and cost no more than
one. Other columns are not looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, finite, lean, slices, whole_numbers

BLOCK = 1024  #: vectors of a block
LEAF = 16  #: vectors of a node that isn't opened further
SLACK = 1e-9
NODE = np.dtype([("centre", "<i4"), ("start", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, order): node 0 is the root, a node's children follow each other, and its points are order[start:end]."""
    x = points.astype(float)
    order, nodes = np.arange(len(x)), []
    todo = [(0, len(x), 0, _far(x, x[0]))]
    for lo, hi, centre, far in todo:
        radius, child, children = float(far.max()), 0, 0
        if hi - lo > leaf and radius > 0:
            here, groups, left = order[lo:hi].copy(), [], np.arange(hi - lo)
            pick, near = centre, far
            while True:
                inside = near <= radius / 2
                groups.append((pick, left[inside], near[inside]))
                left = left[~inside]
                if not left.size or len(groups) >= 32 and (hi - lo - left.size) < 2 * len(groups):
                    break
                pick = int(here[left[0]])
                near = _far(x[here[left]], x[pick])
            if not left.size:  # else hardly any two points are near each other: the node stays a leaf
                child, children, at = len(todo), len(groups), lo
                for pick, inside, near in groups:
                    order[at : at + inside.size] = here[inside]
                    todo.append((at, at + inside.size, pick, near))
                    at += inside.size
        nodes.append((centre, lo, hi, child, children, radius))
    place = np.empty(len(x), np.int32)
    place[order] = np.arange(len(x))
    out = np.array(nodes, NODE)
    out["centre"] = place[out["centre"]]
    return out, order


def _opened(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, node): for each place i of `at`, the children of node at[i]."""
    n = nodes["children"][at]
    i = np.repeat(np.arange(at.size), n)
    return i, nodes["child"][at][i] + np.arange(i.size) - np.repeat(np.cumsum(n) - n, n)


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place): the places of each run i."""
    n = end - start
    i = np.repeat(np.arange(n.size), n)
    return i, start[i] + np.arange(i.size) - np.repeat(np.cumsum(n) - n, n)


def dual_assign(x: np.ndarray, nodes: np.ndarray, centroids: np.ndarray, tree: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(nearest, whole): the number of each vector's nearest centroid, and the nodes that went to one centroid whole, as (node, number).

    x and centroids are in the order of their trees; number: the centroids' own numbers.
    """
    xf, cf = x.astype(float), centroids.astype(float)
    nearest, whole, leaves = np.full(len(x), -1, np.int64), [], []
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while q.size:
        d = _far(xf[nodes["centre"][q]], cf[tree["centre"][c]])
        best = np.full(len(nodes), np.inf)
        np.minimum.at(best, q, d + nodes["radius"][q])
        stay = d - nodes["radius"][q] - tree["radius"][c] <= best[q] * (1 + SLACK) + SLACK
        q, c = q[stay], c[stay]
        alone = (np.bincount(q, minlength=len(nodes))[q] == 1) & (tree["end"][c] - tree["start"][c] == 1)
        if alone.any():
            to = number[tree["start"][c[alone]]]
            i, at = _runs(nodes["start"][q[alone]], nodes["end"][q[alone]])
            nearest[at] = to[i]
            whole.append((q[alone], to))
            q, c = q[~alone], c[~alone]
        wide = np.full(len(nodes), -1.0)
        np.maximum.at(wide, q, np.where(tree["children"][c] > 0, tree["radius"][c], -1.0))
        split_c = (wide[q] >= 0) & ((wide[q] >= nodes["radius"][q]) | (nodes["children"][q] == 0))
        split_q = ~split_c & (nodes["children"][q] > 0)
        done = ~split_c & ~split_q
        leaves.append((q[done], c[done]))
        keep, open_ = split_c & (tree["children"][c] == 0), split_c & (tree["children"][c] > 0)
        i, under = _opened(tree, c[open_])
        j, below = _opened(nodes, q[split_q])
        q, c = np.concatenate((q[keep], q[open_][i], below)), np.concatenate((c[keep], under, c[split_q][j]))
    q, c = (np.concatenate(z) for z in zip(*leaves, strict=True))
    i, at = _runs(nodes["start"][q], nodes["end"][q])
    j, to = _runs(tree["start"][c[i]], tree["end"][c[i]])
    at = at[j]
    for lo in range(0, at.size, 1 << 16):  # in parts, so that differences stay small
        part, cent = at[lo : lo + (1 << 16)], to[lo : lo + (1 << 16)]
        d2 = ((x[part] - centroids[cent]) ** 2).sum(axis=1)
        if not lo:
            least = np.full((len(x), 2), np.iinfo(np.int64).max)
        rank = np.lexsort((number[cent], d2, part))
        ahead = np.concatenate(([True], part[rank][1:] != part[rank][:-1]))
        part, d2, own = part[rank][ahead], d2[rank][ahead], number[cent][rank][ahead]
        better = (d2 < least[part, 0]) | (d2 == least[part, 0]) & (own < least[part, 1])
        least[part[better], 0], least[part[better], 1] = d2[better], own[better]
    if at.size:
        nearest[at] = least[at, 1]
    return nearest, whole


def _blocks(size: int):
    """Blocks of vectors with their trees; a task's batches are cut into blocks as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, size):
            x = np.stack(list(pdf["v"])).astype("<i4")
            nodes, order = cover_tree(x, LEAF)
            yield pd.DataFrame({"ids": [pdf["id"].to_numpy("<i8")[order].tobytes()], "known": [pdf["known"].to_numpy(bool)[order].tobytes()], "x": [x[order].tobytes()], "nodes": [nodes.tobytes()]})

    return lean(run)


def _assigned(pdf: pd.DataFrame, centroids: np.ndarray):
    tree, order = cover_tree(centroids, 1)
    for i in range(len(pdf)):
        x = np.frombuffer(pdf["x"].iloc[i], "<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
        nodes = np.frombuffer(pdf["nodes"].iloc[i], NODE)
        yield i, x, nodes, *dual_assign(x, nodes, centroids[order], tree, order)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for pdf in batches:
            for _, x, nodes, nearest, whole in _assigned(pdf, centroids):
                x = np.column_stack((x, np.ones(len(x), np.int64)))
                upto = np.concatenate((np.zeros((1, x.shape[1]), np.int64), x.cumsum(axis=0)))
                single = np.ones(len(x), bool)
                for node, to in whole:
                    np.add.at(total, to, upto[nodes["end"][node]] - upto[nodes["start"][node]])
                    single[_runs(nodes["start"][node], nodes["end"][node])[1]] = False
                np.add.at(total, nearest[single], x[single])
        used = np.flatnonzero(total[:, -1])
        yield pd.DataFrame({"cluster": used.astype(np.int32), "sums": list(total[used])})

    return lean(run)


def _labelled(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, x, _, nearest, _ in _assigned(pdf, centroids):
                ids = pd.Series(np.frombuffer(pdf["ids"].iloc[i], "<i8"), dtype="Int64").where(np.frombuffer(pdf["known"].iloc[i], bool))
                yield pd.DataFrame({"vec_id": ids, "cluster": nearest.astype(np.int32), "distance": ((x - centroids[nearest]) ** 2).sum(axis=1)})

    return lean(run)


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: str = "3", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors(vec_id, embedding).

    The first centroids are the vectors with the smallest sha256 of "<seed>:<vec_id>", in that order.
    """
    spark = vectors.sparkSession
    rows = vectors.where((F.size("embedding") == width) & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v"))
    first = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)), "v").limit(clusters).collect()  # as many vectors as centroids
    if not first:
        return spark.createDataFrame([], SCHEMA)
    centroids = np.array([r["v"] for r in first], np.int64)
    # ids without nulls, as pandas would turn them into floats
    dealt = rows.select(F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNotNull().alias("known"), "v")
    blocks = cut(dealt.mapInPandas(_blocks(block), "ids binary, known binary, x binary, nodes binary"), "blocks")
    for _ in range(rounds):
        sums = blocks.select("x", "nodes").mapInPandas(_sums(centroids), "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "s"))
        total = np.zeros((len(centroids), width + 1), object)
        for c, i, s in sums.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # a row per component of a centroid
            total[c, i] = int(s)
        used = np.flatnonzero(total[:, -1])
        centroids = centroids.copy()
        centroids[used] = (total[used, :-1] // total[used, -1:]).astype(np.int64)
    out = cut(blocks.mapInPandas(_labelled(centroids), "vec_id long, cluster int, distance long"), "labelled")
    by = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, s, sum(by.values()), digest[c]) for c, s in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: str = "3") -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT k, v AS c FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v FROM v) WHERE k < {clusters})",
    ]
    near = lambda i: f"SELECT r, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': k}}) AS m FROM v, c{i} GROUP BY ALL"
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near(i)})",
            f"s{i} AS (SELECT k, list(f ORDER BY i) AS c FROM (SELECT m.k AS k, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS f FROM a{i}, range(1, {width + 1}) t(i) GROUP BY ALL) GROUP BY ALL)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.c, c.c) AS c FROM c{i} c LEFT JOIN s{i} s ON s.k = c.k)",
        ]
    steps.append(f"z AS MATERIALIZED ({near(rounds)})")
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT vec_id, m.k::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256"
        f"\nFROM z JOIN v USING (r) JOIN c{rounds} ON k = m.k"
    )
