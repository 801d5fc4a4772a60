"""Operator 1 against brute force, and the grouping of verified links."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm.components import components, linked_groups, settled
from reportmill.llm import components as module
from reportmill.llm.common import mix
from reportmill.llm.dartminhash import distinct_documents, elements, near_duplicates, throw

SCHEMA = "doc_id long, text string, ord string, bands string"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    bags = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    links = []
    for a, _ in rows:
        for b, _ in rows:
            if a < b and bags[a] and bags[b] and 10 * sum((bags[a] & bags[b]).values()) >= 8 * sum((bags[a] | bags[b]).values()):
                links.append((a, b))
    return roots([i for i, _ in rows], links)


def test_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(500))
    rows = []
    for base in range(12):
        text = [word() for _ in range(r.randint(8, 200))]
        if base == 3:
            text = text[:10] * 12
        for _ in range(r.choice([1, 1, 3, 25])):
            new = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                new[r.randrange(len(new))] = word()
            rows.append((len(rows), r.choice([" ", "  ", "\n"]).join(new)))
    rows += [(900, None), (901, ""), (902, " "), (903, "one"), (904, "one"), (905, "one two"), (906, "x " * 5000), (907, "x " * 5001)]
    df = spark.createDataFrame([(*x, "a", None) for x in rows], SCHEMA).repartition(3)
    got = near_duplicates(df).collect()
    want = brute(rows)
    assert {x.doc_id: x.group_id for x in got} == want
    sizes = Counter(want.values())
    assert all(x.group_size == sizes[x.group_id] for x in got)


def test_nulls_repeats_and_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, None), (None, None), (7, "other words entirely here now")]
    got = near_duplicates(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA)).collect()
    assert len(got) == 6
    assert sorted((x.doc_id or -1, x.group_id, x.group_size) for x in got if x.doc_id or x.group_id == 1) == [(-1, 1, 3), (1, 1, 3), (1, 1, 3), (7, 7, 1)]


def test_signatures_estimate_similarity():
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base).encode(), " ".join(base[:300] + [f"x{i}" for i in range(100)]).encode()]
    row, element, weight, _, _ = elements(np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]), 5)
    sets = [set(element[row == i].tolist()) for i in (0, 1)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    signature = throw(row, element, weight, 2, 4096, 5.0 * 4096)
    assert abs((signature[0] == signature[1]).mean() - true) < 0.03


def test_signatures_follow_real_weights():
    r = np.random.default_rng(4)
    x, y = r.uniform(0.2, 7, 60), r.uniform(0.2, 7, 60)
    row, element = np.repeat([0, 1], 60), np.tile(mix(np.arange(60, dtype=np.uint64)), 2)
    signature = throw(row, element, np.concatenate([x, y]), 2, 4096, 9.0 * 4096)
    assert abs((signature[0] == signature[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03
    twice = throw(row, element, np.concatenate([x, x]), 2, 256, 9.0 * 256)
    assert (twice[0] == twice[1]).all()


def test_weights_may_be_any_function_of_counts(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), "x y z x y z x y z x y z x y z x y z x y z"
    rows = [(1, f"{a} {b}"), (2, f"{a} {b} {b} {b} {b} {b}"), (3, f"{a} {b}")]
    df = spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA)
    assert {x.doc_id: x.group_id for x in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert {x.doc_id: x.group_id for x in near_duplicates(df, weigh=lambda n: 0.5 + 0.1 * np.log(n)).collect()} == {1: 1, 2: 1, 3: 1}


def test_shared_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in ("ord", "sha", "place", "row", "bands", "group_id", "_ord", "one")})
    got = near_duplicates(df).collect()
    groups = {}
    for x in got:
        groups.setdefault(x.group_id, []).append(x.doc_id)
    assert sorted(sorted(v) for v in groups.values()) == [[1, 2], [1, 3], [4, 4]]
    kept = distinct_documents(df).collect()
    assert sorted(x.text for x in kept) == sorted([a, b, c]) and kept[0].ord == "ord" and kept[0].row == "row"
    assert distinct_documents(df.limit(0)).count() == 0


def test_recall_by_similarity(spark):
    """Pairs at similarities of 0.8 to 0.95 by exact Jaccard: nearly all are found."""
    r = random.Random(11)
    rows, want = [], set()
    for k in range(300):
        text = [f"{k}.{i}" for i in range(150)]
        other = list(text)
        for _ in range(r.choice([1, 2, 3])):
            other[r.randrange(150)] = "new"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
        x, y = ({tuple(t[i : i + 5]) for i in range(146)} for t in (text, other))
        if len(x & y) >= 0.8 * len(x | y):
            want.add(2 * k)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {x.group_id for x in got if x.group_size == 2}
    assert len(want) > 200 and found <= want and len(found) >= 0.99 * len(want)


def test_components_of_paths_and_stars(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 80)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(1, 1)]
    want = roots({n for e in links for n in e}, links)
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    assert {x.node: x.component for x in components(df).collect()} == {n: c for n, c in want.items() if n != 1 and Counter(want.values())[c] > 1}
    assert components(df.limit(0)).count() == 0
    few = {x.node: x.component for x in components(df.repartition(7), 10).collect()}  # too many edges for one task
    assert few == {n: c for n, c in want.items() if n != 1 and Counter(want.values())[c] > 1}


@pytest.mark.parametrize("block", [512, 7])
def test_groups_lose_no_link(spark, monkeypatch, block):
    """All nodes in one bucket; links only between neighbours of a shuffled path, of which the hub sees few."""
    monkeypatch.setattr(module, "BLOCK", block)
    r = random.Random(7)
    nodes = list(range(40))
    r.shuffle(nodes)
    links = {tuple(sorted(x)) for part in (nodes[:15], nodes[15:33]) for x in zip(part, part[1:])}
    members = spark.createDataFrame([(k, n) for n in nodes for k in (1, 2)], "key long, node long")
    payload = members.select("node").distinct()
    wanted = spark.createDataFrame(sorted(links), "a long, b long")
    verify = lambda pairs: pairs.join(F.broadcast(wanted), ["a", "b"])

    class Linked:
        def __init__(self, rows):
            self.node = rows.column("node").to_pylist()

        def may(self, key, x, y):
            return np.ones(len(x), bool)

        def links(self, x, y):
            return np.array([tuple(sorted((self.node[i], self.node[j]))) in links for i, j in zip(x, y, strict=True)])

    got = linked_groups(members, verify, lambda open_: settled(open_, payload, Linked))
    want = roots(nodes, links)
    assert {x.node: x.component for x in got.collect()} == {n: c for n, c in want.items() if Counter(want.values())[c] > 1}
