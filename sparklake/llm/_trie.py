"""The self-join of a binary trie of 64-bit fingerprints within one task, and connected components over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklake.session import discard, materialise

BITS = 64
#: Node pairs held at once by a walk.
FRONTIER = 1 << 17


def _leaves(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j of a:b and c:d, 2 * FRONTIER pairs at a time, or the pairs of one i."""
    # a row for each i
    i = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    c, d = (np.repeat(v, b - a) for v in (c, d))
    c = np.maximum(c, i + 1)
    size = np.maximum(d - c, 0)
    total, at = np.cumsum(size), 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2 * FRONTIER, side="right")))
        n = size[at:to]
        yield np.repeat(i[at:to], n), np.repeat(c[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = to


def walk(x: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of fingerprints x within the budget, from pairs of trie nodes; i < j where a node is paired with itself.

    A node is a range lo:hi of x, sorted, whose members agree in their first ``depth`` bits; pairs holds lo, hi of both
    nodes (the same one, or the earlier range first) and the differing bits so far.
    """
    ones = {}
    stack = [(depth, pairs)]
    while stack:
        depth, (a, b, c, d, diff) = stack.pop()
        small = ((b - a) * (d - c) <= 32) | (depth == BITS)
        for i, j in _leaves(a[small], b[small], c[small], d[small]):
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            yield i[near], j[near]
        a, b, c, d, diff = (v[~small] for v in (a, b, c, d, diff))
        if not len(a):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - depth)) & np.uint64(1))]).astype(np.int64)
        one = ones[depth]
        m, n = b - (one[b] - one[a]), d - (one[d] - one[c])
        same = (a == c) & (b == d)
        children = [(a, m, c, n, diff), (m, b, n, d, diff), (a, m, n, d, diff + 1)]
        children.append(tuple(v[~same] for v in (m, b, c, n, diff + 1)))
        new = tuple(np.concatenate(v) for v in zip(*children, strict=True))
        live = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        new = tuple(v[live] for v in new)
        for at in range(0, len(new[0]), FRONTIER):
            stack.append((depth + 1, tuple(v[at : at + FRONTIER] for v in new)))


def roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after joining i and j: each member's smallest reachable member so far."""
    while len(i):
        p, q = label[i], label[j]
        ok = p != q
        i, j, p, q = i[ok], j[ok], p[ok], q[ok]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of (u, v), u <> v: root is the smallest node reachable.

    Alternates large-star and small-star rounds until neither changes the edges; each round is a table in the
    shared folder, and the one before goes.
    """

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        new = materialise(new, "edges")
        discard(old)
        return new

    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = replaced(edges, both.join(least, "u").where("v > u").select("v", "m").toDF("u", "v").where("u <> v").distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        pairs = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select("e.v", "e.m").toDF("u", "v")
        edges = replaced(edges, pairs.where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
