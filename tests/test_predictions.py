"""Small operators around predictions, calls and columns, and operators whose keys or groups hold most rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldspark.operators import columns, evaluate, hits, metrics, ontology, pairs, predict, structure

LLR = ", ".join(f"{s} double" for s in predict.SCORES)


def _prediction(domain: int, parent: str, func: str, pls: float, base: float, other: float = 0.0) -> tuple:
    return (domain, parent, func, *[{"pls_llr": pls, "base_llr": base}.get(s, other) for s in predict.SCORES])


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [_prediction(1, "p", "f", 2.0, -3.0), _prediction(1, "p", "g", -1.0, -9.0, -5.0), _prediction(2, "q", "f", 5.0, -13.5, 1.0), _prediction(3, "r", "h", 0.5, 0.5)]
    return spark.createDataFrame(rows, f"domain int, parent string, func string, {LLR}")


def test_filter_predictions(predictions):
    kept = lambda **o: {(r["domain"], r["func"]) for r in predict.filter_predictions(predictions, **o).collect()}
    assert kept() == {(1, "f"), (1, "g"), (2, "f"), (3, "h")}
    assert kept(least={"pls_llr": 0.5, "p_llr": 0.0}) == {(1, "f"), (2, "f"), (3, "h")}
    assert kept(least={"ls_llr": 1.0}, most_base=-10) == {(2, "f")}


def test_prediction_report_export_and_specificity(spark, predictions):
    proteins = spark.createDataFrame([("p",), ("p",), ("q",)], "parent string")
    names = spark.createDataFrame([("f", "a function")], "func string, name string")
    report = predict.prediction_report(predictions, proteins, names, base_max=0, pls_min=-2).collect()
    assert [(r["domain"], r["func"], r["name"]) for r in report] == [(2, "f", "a function"), (1, "f", "a function"), (1, "g", None)]
    assert {tuple(r) for r in predict.export_rows(predictions.withColumn("type", F.lit("msa")), "bayes_pls_x").collect()} == {(p, f, "msa_bayes_pls_x") for p, f in (("p", "f"), ("q", "f"), ("r", "h"))}
    assert [r["s"] for r in predictions.orderBy("domain", "func").select(predict.specificity().alias("s")).collect()] == [1, 3, None, None]


def test_structure_sets_and_scale(spark):
    df = spark.createDataFrame([(1, "a.1.1", 0.5, 0.5), (1, "a.1.1", 0.5, 1.0), (1, "b.2.1", 0.9, 1.0), (2, "c.1.1", 0.2, 2.0)], "domain int, sccs string, p double, scale double")
    assert {(r["domain"], r["set_id"], r["sccs"]): r["p"] for r in predict.structure_sets(df, "combine").collect()} == pytest.approx({(1, 1, "a.1.1"): 0.75, (1, 1, "b.2.1"): 0.9, (2, 1, "c.1.1"): 0.2})
    assert sorted((r["domain"], r["set_id"], r["sccs"]) for r in predict.structure_sets(df, "split").collect()) == [(1, 1, "b.2.1"), (1, 2, "a.1.1"), (1, 3, "a.1.1"), (2, 1, "c.1.1")]
    assert sorted(r["p"] for r in predict.scale_structures(df).collect()) == pytest.approx([0.25, 0.4, 0.5, 0.9])
    with pytest.raises(ValueError):
        predict.structure_sets(df, "other")


def test_mcm_calls(spark):
    calls = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "key int, what string")
    folds = spark.createDataFrame([(1, "HHHHHHHHHH", "HHHHHHHHHH", 1, 10), (2, "HHHHHHHHHH", "HHHHHHHHHH", 1, 3)], "key int, parent string, folded string, start int, stop int")
    cover = {r["key"]: r["c"] for r in folds.select("key", structure.fold_coverage("parent", "folded", "start", "stop")["fold_share"].alias("c")).collect()}
    kept = {r["key"] for r in structure.mcm_calls(calls, folds).collect()}
    assert kept == {k for k in (1, 2) if cover[k] > 0.75} | {3} and kept != {1, 2, 3}


def test_cluster_predictors(spark):
    clusters = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", True), (3, "remove", False), (3, "a", True)], "cluster_id int, identifier string, representative boolean")
    terms = spark.createDataFrame([("a", "T1"), ("b", "T1"), ("b", "T2")], "identifier string, acc string")
    classes = spark.createDataFrame([("a", "s1"), ("b", "s9"), ("c", "s2")], "identifier string, superfamily string")
    rows = lambda **o: {tuple(r) for r in metrics.cluster_predictors(clusters, terms, classes, **o).collect()}
    assert rows() == {(1, "T1"), (1, "T2"), (1, "s1")} and rows(keep_without_terms=True) == rows() | {(2, "s2")}


def test_column_features(spark):
    cols = spark.createDataFrame([("p", i, i + 5) for i in range(1, 5)], "protein string, residue int, col int")
    domains = spark.createDataFrame([("p", "d", 2, 3)], "protein string, domain string, start int, stop int")
    atoms = spark.createDataFrame([("p", 3, 30, 31)], "protein string, residue int, seqres int, atom int")
    got = [tuple(r) for r in columns.column_features(cols, atoms, domains).orderBy("col").collect()]
    assert got == [("p", 7, 2, "d", None, None), ("p", 8, 3, "d", 30, 31)]


def _heavy() -> list[tuple[int, int]]:
    return [(1, i) for i in range(120)] + [(k, i) for k in range(2, 8) for i in range(k, k + 12)] + [(99, 7)]


def test_pairs_of_heavy_keys_are_dealt_to_cells(spark, monkeypatch):
    rows = _heavy()
    want = sorted((k, a, b, 10 * a, 10 * b) for k, a in rows for j, b in rows if j == k and a < b)
    df = spark.createDataFrame([(k, i, 10 * i) for k, i in rows] + [(None, 5, 0), (1, None, 0)], "k int, i int, v int")
    for block in (1000, 25, 7):
        met = pairs.pairs_within(df, "k", "i", ("v",), block=block)
        assert sorted(map(tuple, met.collect())) == want
    plan = pairs.pairs_within(df, "k", "i", block=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "i__" in plan and "j__" in plan
    monkeypatch.setattr(pairs, "BLOCK", 9)
    members = spark.createDataFrame([(f"f{i:03}", k) for k, i in rows], "family string, protein_key int")
    own = defaultdict(set)
    for k, i in rows:
        own[k].add(f"f{i:03}")
    assert {tuple(r) for r in hits.related_families(members).collect()} == {(a, b) for s in own.values() for a in s for b in s if a != b}
    edges = spark.createDataFrame(rows + rows[:3], "parent int, child int")
    shared = Counter((a, b) for _, a, b, *_ in want)
    assert {(r["a"], r["b"]): r["shared"] for r in ontology.common_parent_pairs(edges).collect()} == shared


def test_groups_of_any_size_have_spread_prefix_sums(spark):
    rng = random.Random(2)
    rows = [("big", rng.randrange(400), rng.choice([1, -1])) for _ in range(4000)] + [(g, rng.randrange(9), 1) for g in ("a", "b", None) for _ in range(20)]
    df = spark.createDataFrame(rows, "g string, score double, label int".replace("score double", "score int")).withColumn("score", F.col("score").cast("double"))
    for groups in (["g"], None):
        got = evaluate.precision_recall(df, groups, parts=6).collect()
        keyed = defaultdict(list)
        for g, s, y in rows:
            keyed[g if groups else "all"].append((s, y))
        want = {}
        for g, own in keyed.items():
            hits_ = sum(y > 0 for _, y in own)
            for cut in {s for s, _ in own}:
                n, h = sum(s >= cut for s, _ in own), sum(s >= cut and y > 0 for s, y in own)
                want[g, float(cut)] = (n, h, h / n, h / hits_, n / len(own))
        told = {(r["g"] if groups else "all", r["score"]): (r["n"], r["hits"], r["precision"], r["recall"], r["rate"]) for r in got}
        assert set(told) == set(want) and all(told[k] == pytest.approx(want[k]) for k in want)
        assert len(got) == len(want)


def test_chains_of_intervals_by_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for d in range(60):
        for key in range(rng.randint(1, 7)):
            start = rng.randint(1, 90)
            rows.append((d, key, start, start + rng.randint(4, 40), rng.choice([0.8, 0.9, 1.0])))
    got = defaultdict(set)
    for r in structure.representative_path(spark.createDataFrame(rows, "domain int, key int, start int, stop int, ratio double")).collect():
        got[r["domain"]].add((r["start"], r["stop"], r["key"], r["ratio"]))
    for d in range(60):
        unique: dict[tuple, tuple] = {}
        for _, k, a, b, x in (r for r in rows if r[0] == d):
            old = unique.get((a, b), (k, x))
            unique[a, b] = min(old[0], k), max(old[1], x)
        by_key: dict[int, tuple] = {}
        for (a, b), (k, x) in unique.items():
            by_key[k] = min(by_key.get(k, (a, b, x)), (a, b, x))
        own = sorted((a, b, k, x) for k, (a, b, x) in by_key.items())
        apart = lambda p, q: max(0, min(p[1], q[1]) - max(p[0], q[0]) + 1) / (p[1] - p[0] + 1) < 0.1
        best = 0.0
        for mask in range(1, 1 << len(own)):
            chain = [own[i] for i in range(len(own)) if mask >> i & 1]
            if all(apart(p, q) for p, q in zip(chain, chain[1:])):
                best = max(best, sum(x * (b - a + 1) for a, b, _, x in chain))
        assert got[d] <= set(own) and sum(x * (b - a + 1) for a, b, _, x in got[d]) == pytest.approx(best)
    many = [(1, i, 20 * i, 20 * i + 9, 0.9) for i in range(12)]  # 66 pairs could follow each other: too many
    assert structure.representative_path(spark.createDataFrame(many, "domain int, key int, start int, stop int, ratio double")).count() == 0
