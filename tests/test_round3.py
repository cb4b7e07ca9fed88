"""Ties of representative paths, predictions by groups, classes of several chains."""

import itertools
import math

from foldspark.operators import columns, ontology, pairs, structure


def test_path_ties_are_exact(spark):
    # 0.9 * 3 + 0.9 * 30 and 0.9 * 33 differ as doubles; any pair of chains with equal lengths is a tie.
    for a, b in itertools.product((3, 7, 11, 13), (19, 23, 26, 31)):
        rows = [(1, 1, 1, a, 0.9), (1, 2, a + 1, a + b, 0.9), (1, 3, a + b + 1, a + b + 9, 0.9), (1, 0, 1, a + b, 0.9)]
        got = structure.representative_path(spark.createDataFrame(rows, "domain int, key int, start int, stop int, ratio double")).collect()
        # In order of (start, stop): key 1, key 0, key 2, key 3. Before 3 both 0 and 1, 2 reach a + b; the first in order is 0.
        assert sorted(r["key"] for r in got) == [0, 3]


def test_predictions_by_groups(spark):
    seqs, terms = [(s, s % 3) for s in range(1, 8)], [(a, a % 3) for a in range(1, 10)]
    old = [(1, 1), (1, 4), (1, 7), (2, 5), (2, 3), (4, 1)]
    new = [(1, 1), (3, 6), (3, 4), (5, 8), (2, 2), (2, 2)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    s, t, o, n = frame(seqs, "sequence_key int, group int"), frame(terms, "acc int, group int"), frame(old, "sequence_key int, acc int"), frame(new, "sequence_key int, acc int")
    pred = frame([(p, a) for p, g in seqs for a, h in terms if g == h], "sequence_key int, acc int")
    got = ontology.confirmed_in_groups(s, t, o, n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ontology.confirmed_predictions(pred, o, n).collect())) == [(2, 2), (3, 6), (5, 8)]
    d = frame([(10 * g + a % 2, a, g) for a, g in terms] + [(99, None, 1)], "domain_key int, acc int, group int")
    flat = pred.join(d.select("domain_key", "acc"), "acc").unionByName(s.where("group = 1").selectExpr("sequence_key", "cast(null as int) acc", "99 domain_key"))
    rows = lambda df: sorted(map(tuple, df.select("domain_key", "sequence_key", "status").collect()))
    got = rows(ontology.novel_or_extended_in_groups(s, d, o))
    assert got == rows(ontology.novel_or_extended(flat, o)) and {x for *_, x in got} == {"novel", "extended", "known"}


def test_assign_scop_many_chains(spark):
    domains = spark.createDataFrame([(1, "x", "A", 1, 20), (1, "x", "B", 1, 30), (2, "x", "A", 1, 40), (2, "x", "A", 50, 70), (3, "y", "A", 1, 5)], "domain int, pdb string, chain string, start int, stop int")
    parts = [(7, "x", "A", 1, 20, 50, "a.1"), (7, "x", "B", 1, 30, 50, "a.1"), (8, "x", "A", 1, 70, 90, "b.1"), (9, "x", "A", 50, 71, 90, "b.1"), (5, "y", "A", None, None, 6, "c.1"), (6, "y", "A", 0, None, 9, "d.1")]
    got = structure.assign_scop(domains, spark.createDataFrame(parts, "scop int, pdb string, chain string, start int, stop int, chain_len int, sccs string"))
    assert sorted((r["domain"], r["sccs"], r["size"]) for r in got.collect()) == [(1, "a.1", 1), (2, "b.1", 2), (3, "c.1", 1)]
    # Of a class on one chain nothing but counts by domain and code leaves that chain.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN many" in plan


def test_site_clustering_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 3)
    xyz = {i: (i * 0.7, (i * i) % 5 + 0.1 * i, (i * 3) % 7) for i in range(12)}
    coords = spark.createDataFrame([(1, i, *map(float, v)) for i, v in xyz.items()] + [(2, 0, 0.0, 0.0, 0.0)], "structure int, residue int, x double, y double, z double")
    sites = [0, 2, 3, 7, 8, 11]
    got = columns.site_clustering(coords, spark.createDataFrame([(1, i) for i in [*sites, 2]] + [(2, 0)], "structure int, residue int"), 5)
    rows = got.collect()
    want = [1 / math.dist(xyz[a], xyz[b]) for a, b in itertools.combinations(sites, 2)]
    assert [r["structure"] for r in rows] == [1] and abs(rows[0]["target"] - sum(want) / len(want)) < 1e-12
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row holds a structure


def test_local_leaves_with_masks(spark):
    held = {(e, a) for e in range(-300, 300) for a in range(1, 32) if (e * 7 + a * a) % 11 < 2}
    up = lambda a: {a >> k for k in range(1, 6)} - {0}
    want = {(e, a) for e, a in held if not any(a in up(b) for b in range(1, 32) if (e, b) in held)}
    closure = [(x, a, 1) for a in range(1, 32) for x in up(a)] + [(a, a, 0) for a in range(1, 32)]
    got = ontology.local_leaves(spark.createDataFrame(sorted(held), "entity int, acc int"), spark.createDataFrame(closure, "ancestor int, descendant int, distance int"))
    assert {tuple(r) for r in got.select("entity", "acc").collect()} == want
    assert "bit_or" in got._jdf.queryExecution().optimizedPlan().toString()  # ancestors that an entity lacks are cut before they move
