"""Connected components of an edge table, and groups of verified links between the members of shared buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Edges that one task contracts in memory, at 16 bytes each; more are dealt to more tasks.
EDGES = 1 << 20


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars: each node under the smallest that it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return united(np.concatenate(a), np.concatenate(b))

        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n > 2 * EDGES:  # a star has at most an edge a node, so what is held stays in proportion to the nodes
                nodes, roots = stars()
                a, b, n = [nodes], [roots], 0
        nodes, roots = stars()
        yield pa.record_batch([pa.array(nodes), pa.array(roots)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large-star) or smaller (small-star) neighbours to its smallest neighbour, itself included.

    Written with an aggregate and a join, so that a node with very many neighbours is split like any skewed join.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """node, component (its smallest node) for every node of edges(a, b), two longs. Nulls and loops are left out.

    Tasks contract their own edges first. Up to `most` edges that are left meet in one task; while there are more,
    large-star and small-star steps go on, whose rounds grow with the logarithm of the longest path. Each round's edges
    are written to the shared folder and the round before is removed.
    """
    now = written(contracted(edges.filter("a <> b")).filter("a <> b").distinct(), "edges")
    before = None
    while (n := now.count()) > most:
        dealt = stars(stars(now, True), False).repartition(ceil(n / most), "b")
        after = written(contracted(dealt).filter("a <> b").distinct(), "edges")
        mark = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(now)
        now = after
        if mark == before:  # stars only: each node hangs on its smallest
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = mark
    out = written(contracted(now.repartition(1)).select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    forget(now)
    return out


#: Members of one bucket that a task compares with as many others at once, pairs that it looks at at once, and pairs that
#: it asks to be judged at once.
BLOCK, PAIRS, ASKED = 512, 1 << 16, 1024


def in_rounds(rows: int, most: int, step: Callable[[Callable[[Column], Column]], DataFrame], name: str) -> DataFrame:
    """step(own) for some `most` of `rows` rows at once, where own(hash) tells which rows are a round's; all results.

    Each round's result is written, and what it shuffled is removed before the next.
    """
    rounds = max(1, ceil(rows / most))
    if rounds == 1:
        return step(lambda h: F.lit(True))
    parts = [written(step(lambda h, r=r: F.pmod(h, F.lit(rounds)) == r), name) for r in range(rounds)]
    out = written(reduce(DataFrame.unionByName, parts), name)
    forget(*parts)
    return out


def blocked(open_: DataFrame) -> DataFrame:
    """open_(key, node, ...) with the number of blocks of its key and the one that it is in itself (own)."""
    n = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return open_.join(n, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


class Judge(Protocol):
    """Compares members of buckets: built from a table of payload rows, asked for pairs of their numbers."""

    def __init__(self, rows: pa.Table): ...

    def may(self, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs, each of them in the bucket `key`, may be links: vectorised, and true for all that are."""

    def links(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of these pairs are links."""


def root(x: int, up: dict[int, int]) -> int:
    while (y := up.get(x, x)) != x:
        x = y
    return x


def settled(open_: DataFrame, payload: DataFrame, judge: Callable[[pa.Table], Judge], most: int | None = None) -> DataFrame:
    """Links (a, b) that join different groups g of open_(key, node, g); payload(node, ...) is what judge needs.

    A key's members are dealt out in blocks, and each two blocks meet in a task, so a task holds two blocks of a key at
    most; pairs are never rows. Pairs whose groups a task has joined by then are left out. A member goes to a task for
    each block of its key, which grows with the square of the key; with `most`, some so many rows are dealt out at once.
    """
    dealt = blocked(open_).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}

        def join(v: int, w: int, up: dict[int, int]) -> bool:
            """Whether the groups were apart in `up`; they aren't from then on."""
            p, q = root(v, up), root(w, up)
            up[max(p, q)] = min(p, q)
            return p != q

        def links(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            key, i, j, own, node, g = (rows.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "g"))
            asked, found = judge(rows), []
            for x, y in pairs_of(key, i, j, own):
                apart = g[x] != g[y]
                x, y = x[apart], y[apart]
                near = asked.may(key[x], x, y) if len(x) else apart[:0]
                x, y = x[near], y[near]
                hoped: dict[int, int] = {}  # pairs that would join all groups, if they were links, come first
                order = np.argsort([not join(root(v, joined), root(w, joined), hoped) for v, w in zip(g[x].tolist(), g[y].tolist(), strict=True)], kind="stable")
                x, y = x[order], y[order]
                for lo in range(0, len(x), ASKED):
                    p, q = x[lo : lo + ASKED], y[lo : lo + ASKED]
                    apart = np.array([root(v, joined) != root(w, joined) for v, w in zip(g[p].tolist(), g[q].tolist(), strict=True)])
                    p, q = p[apart], q[apart]
                    if len(p):
                        linked = asked.links(p, q)
                        found += [(v, w) for v, w in zip(p[linked].tolist(), q[linked].tolist(), strict=True) if join(int(g[v]), int(g[w]), joined)]
            v, w = np.array(found, np.int64).reshape(-1, 2).T
            return pa.record_batch([pa.array(np.minimum(node[v], node[w])), pa.array(np.maximum(node[v], node[w]))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            key, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(new):  # all but the last blocks are here whole
                yield links(pa.Table.from_batches([*held, batch.slice(0, new[-1])]))
                held, batch = [], batch.slice(new[-1])
            held.append(batch)
        if held:
            yield links(pa.Table.from_batches(held))

    def of_round(own: Callable[[Column], Column]) -> DataFrame:
        rows = dealt.filter(own(F.xxhash64("key", "i", "j"))).join(payload, "node").repartition("key", "i", "j")
        return rows.sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()

    if most is None:
        return of_round(lambda h: F.lit(True))
    n = F.count(F.lit(1))
    rows = open_.groupBy("key").agg((n * F.ceil(n / BLOCK)).alias("n")).agg(F.sum("n")).first()[0]
    return in_rounds(rows or 0, most, of_round, "settled")


def pairs_of(key: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each two blocks, or within one (i = j), of rows sorted by key, i and j: some PAIRS at once."""
    edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    x, y, n = [], [], 0
    for at, to in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
        if at == to:
            continue
        if i[at] == j[at]:
            v, w = np.triu_indices(to - at, 1)
        else:
            left = own[at:to] == i[at]
            v, w = (c.ravel() for c in np.meshgrid(np.flatnonzero(left), np.flatnonzero(~left)))
        for k in range(0, len(v), PAIRS):
            x.append(v[k : k + PAIRS] + at)
            y.append(w[k : k + PAIRS] + at)
            n += len(x[-1])
            if n >= PAIRS:
                yield np.concatenate(x), np.concatenate(y)
                x, y, n = [], [], 0
    if n:
        yield np.concatenate(x), np.concatenate(y)


def linked_groups(members: DataFrame, verify: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column, Column], Column] | None = None, more: DataFrame | None = None) -> DataFrame:
    """node, component of all nodes that verified links join; members(key, node) holds the buckets of candidates.

    First every member is compared with the hub of its bucket, the member that shares most places with others: what
    gathers around one text joins there, by verify(pairs(a, b, key)), which returns those that are links; key is the
    smallest of the keys that made the pair. Buckets whose
    members are in several groups after that stay open, and settle(open(key, node, g)) returns links between those
    groups, enough to join all that links join: see settled(). So two members are left uncompared only where they are in one group by then: no link between groups is lost, and the pairs
    within a group are never made. With near(key, mark, mark), members also have a mark, and near() is a cheap test that
    all links pass: pairs with a hub that fail it are no rows. more(a, b, key) are pairs (a < b) that are verified as well.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weights = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("w"))
    mark = [] if near is None else ["mark"]
    best = F.max_by(F.struct("node", *mark), F.struct(F.col("w"), -F.col("node")))
    met = members.join(members.join(weights, "node").groupBy("key").agg(best.alias("hub")), "key").filter("node <> hub.node")
    if near is not None:
        met = met.filter(near(F.col("key"), F.col("mark"), F.col("hub.mark")))
    met = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"), "key")
    pairs = (met if more is None else met.unionByName(more)).groupBy("a", "b").agg(F.min("key").alias("key"))
    links = written(verify(pairs).select("a", "b"), "links")
    groups = components(links)
    placed = members.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("g"))
    mixed = placed.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high").select("key")
    open_ = written(placed.join(mixed, "key"), "open")
    found = written(settle(open_).select("a", "b"), "links")
    forget(links, open_)
    if found.isEmpty():
        return groups
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
