"""Walks up and tree partitions against plain loops, and on long and wide trees."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from foldspark.operators import ontology, trees


def _down(kids: dict, n: int) -> int:
    """As far down as single children lead."""
    while len(kids.get(n, ())) == 1:
        n = kids[n][0]
    return n


def _split(edges: list[tuple[int, int]], most: int) -> dict[int, int]:
    kids, parent = defaultdict(list), {}
    for p, c in edges:
        kids[p].append(c)
        parent[c] = p
    order, todo = [], [n for n in kids if n not in parent]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += kids.get(n, [])
    left, cut = {}, set()
    for n in reversed(order):
        if n not in kids:
            left[n] = 1
            continue
        rest = sorted(kids[n], key=lambda c: (-left[c], _down(kids, c)))
        while sum(left[c] for c in rest) > most:
            cut.add(rest.pop(0))
        left[n] = sum(left[c] for c in rest)
    out = {}
    for n in order:
        if n not in kids:
            at = n
            while at not in cut and at in parent:
                at = parent[at]
            out[n] = at
    return out


def _sub_trees(spark, edges, most) -> dict[int, int]:
    rows = trees.split_tree(spark.createDataFrame(edges, "parent long, child long"), most).collect()
    assert len({r["leaf"] for r in rows}) == len(rows)
    return {r["leaf"]: r["root"] for r in rows}


def _sizes(found: dict[int, int]) -> list[int]:
    many = defaultdict(int)
    for root in found.values():
        many[root] += 1
    return sorted(many.values())


def _top(edges: list[tuple[int, int]], found: dict[int, int]) -> dict[int, int]:
    """Which of several nodes with single children a sub-tree is named by is the splitter's choice."""
    kids = defaultdict(list)
    for p, c in edges:
        kids[p].append(c)
    return {leaf: _down(kids, root) for leaf, root in found.items()}


def test_split_against_a_plain_loop(spark):
    rng = random.Random(5)
    edges = []
    for base in (0, 1000):  # two trees, with single children and wide nodes
        for c in range(1, 90):
            edges.append((base + (rng.randrange(max(0, c - 12), c) if rng.random() < 0.85 else c - 1), base + c))
    edges += [(2000, 2001 + i) for i in range(30)]
    for most in (1, 7):
        got, want = _sub_trees(spark, edges, most), _split(edges, most)
        assert max(_sizes(got)) <= most and _top(edges, got) == _top(edges, want)


def test_a_chain_and_a_star(spark):
    n = 100_000
    chain = spark.range(1, n).selectExpr("id - 1 as parent", "id as child")
    assert [tuple(r) for r in trees.split_tree(chain).collect()] == [(n - 1, 0)]
    star = spark.range(1, n + 1).selectExpr("0L as parent", "id as child")
    sizes = trees.split_tree(star).groupBy("root").count().collect()
    assert sum(r["count"] for r in sizes) == n and sorted(r["count"] for r in sizes)[-2:] == [1, 40]


def test_split_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "parent long, child long")
    assert trees.split_tree(frame([])).count() == 0
    assert [tuple(r) for r in trees.split_tree(frame([(1, 2), (1, 2), (None, 3), (4, None)])).collect()] == [(2, 1)]
    with pytest.raises(ValueError, match="two parents"):
        trees.split_tree(frame([(1, 3), (2, 3)]))
    for rows in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (2, 9)]):
        with pytest.raises(ValueError, match="cycle"):
            trees.split_tree(frame(rows))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 4096, []
    for module in (trees, ontology):
        monkeypatch.setattr(module, "settled", lambda df, f=module.settled: (rounds.append(1), f(df))[1])
    up = spark.range(1, n).selectExpr("id as node", "id - 1 as parent")
    got = ontology.climb(up.select("node"), up, [0, 7])
    assert {(r["stop"], r["count"]) for r in got.groupBy("stop").count().collect()} == {(0, 6), (7, n - 7)} and len(rounds) <= 15
    rounds.clear()
    closure = ontology.transitive_closure(spark.range(1, 300).selectExpr("id - 1 as parent", "id as child"))
    assert closure.count() == 300 * 301 // 2 and closure.where("distance <> descendant - ancestor").count() == 0 and len(rounds) <= 24
    with pytest.raises(ValueError, match="cycle"):
        ontology.climb(up.select("node"), spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"), [9])


def test_closure_keeps_the_least_distance(spark):
    rng = random.Random(3)
    edges = {(a, b) for a in range(40) for b in rng.sample(range(a + 1, 48), 3)}
    dist = {(n, n): 0 for e in edges for n in e}
    for _ in range(50):
        for a, b in edges:
            for (x, y), d in list(dist.items()):
                if y == a and d + 1 < dist.get((x, b), 99):
                    dist[x, b] = d + 1
    got = ontology.transitive_closure(spark.createDataFrame(list(edges), "parent long, child long")).collect()
    assert {(r["ancestor"], r["descendant"]): r["distance"] for r in got} == dist and len(got) == len(dist)
