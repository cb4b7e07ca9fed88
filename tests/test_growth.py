"""Tasks that follow the rows, and steps that keep work and memory of a task from growing with the input."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldspark.operators import columns, enrich, evaluate, hits, metrics, ontology, predict
from foldspark.plans import q_structure
from foldspark.plans.queries import QUERIES
from foldspark.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_structure_set_in_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 500)
    got = QUERIES["protein_structure_set"](spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert got.rdd.getNumPartitions() == 2 * (rows // 500 + 1)  # both halves, whatever the session's setting
    known = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("l_orderkey", "l_partkey * 8 + l_linenumber").distinct().count()
    assert got.where(F.col("elem").startswith("k")).count() == known


def test_coverage_repeats_no_row(spark):
    rows = [("a", 5.0, 1, 1, 7), ("a", 3.0, 1, 2, 7), ("a", 1.0, 2, 3, 8), ("b", 1.0, 1, 1, None), ("b", 2.0, None, 1, None), (None, 9.0, 1, 1, 1), ("c", 1.0, 1, 1, 1)]
    pred = spark.createDataFrame(rows, "grp string, score double, protein int, domain int, acc int")
    cut = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 4.0), (None, 0.0)], "grp string, threshold double")
    got = evaluate.genome_coverage(pred, cut, ["grp"])
    assert sorted(map(tuple, got.collect())) == [("a", 2, 1, 2, 1), ("b", 2, 1, 1, 0)]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_features_in_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 3)
    hits = spark.createDataFrame([(q, f"f{(q * k) % 3}", f"d{k}") for q in range(10) for k in (1, 2, 2)], "query int, feature string, description string")
    subset = spark.createDataFrame([(1,), (2,), (2,), (4,)], "query int")
    got = enrich.count_features(hits, subset)
    want = {}
    for q in range(10):
        for f in {f"f{(q * k) % 3}" for k in (1, 2)}:
            b, o, d = want.get(f, (0, 0, "z"))
            want[f] = b + 1, o + (q in (1, 2, 4)), min(d, *[f"d{k}" for k in (1, 2) if f == f"f{(q * k) % 3}"])
    assert {r["feature"]: tuple(r)[1:] for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [query#") == 2
    assert ", 11" in got._jdf.queryExecution().optimizedPlan().toString()


def test_families_in_tasks_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(hits, "PAIRS", 20)
    monkeypatch.setattr(tables, "ROWS", 10)
    held = {(f, p) for f in range(12) for p in range(9) if (f * p + f) % 4 < 2}
    got = hits.related_families(spark.createDataFrame(sorted(held) * 2, "family int, protein_key int"))
    count = sum(n * (n - 1) // 2 for n in (sum(p == q for _, q in held) for p in range(9)))
    assert got.rdd.getNumPartitions() == count // 20 + 1 > 4
    assert {tuple(r) for r in got.collect()} == {(f, g) for f, p in held for g, q in held if p == q and f != g}


def test_ancestors_in_tasks_by_direct_terms(spark, monkeypatch):
    monkeypatch.setattr(ontology, "DIRECT", 5)
    up = lambda a: {a >> k for k in range(6)} - {0}
    kind, dead, coded = (lambda a: "mf" if a % 3 else "bp"), (lambda a: int(a % 5 == 0)), (lambda s, a: "12"[(s + a) % 2])
    direct = [(s, a, coded(s, a)) for s in range(30) for a in range(1, 32) if (s * a) % 7 == 1]
    terms = spark.createDataFrame([(a, f"n{a}", kind(a), dead(a)) for a in range(1, 32)], "acc int, name string, term_type string, is_obsolete int")
    closure = spark.createDataFrame([(x, a) for a in range(1, 32) for x in up(a)], "ancestor int, descendant int")
    got = ontology.ancestor_terms(spark.createDataFrame(direct * 2, "sequence_key int, acc int, evidence_code string"), terms, closure, ["mf"], ["1"])
    low = {(s, a) for s, a, c in direct if c == "1" and kind(a) == "mf" and not dead(a)}
    want = {(s, x, f"n{x}", "mf") for s, a in low for x in up(a) if kind(x) == "mf" and not dead(x)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() == len(low) // 5 + 1 > 4


def test_frequency_counts_equal_sets(spark, monkeypatch):
    held = [(c, p) for c in [*range(40), None] for p in ["all", "x", "y", "z", "w", None] if p == "x" or (c or 0) % 7 == len(p or "") or (p == "all" and c != 3) or (p == "z" and c in (5, 6))]
    frame = spark.createDataFrame([r for r in held for _ in range(2 if (r[0] or 0) % 2 else 1)], "cluster_id int, predictor string")
    rows = set(held)
    n, pairs = Counter(p for _, p in rows), Counter((p, q) for c, p in rows for d, q in rows if c == d and c is not None and p and q)
    pairs["all", None] = sum((c, None) in rows and (c, "all") in rows for c in range(40))  # as before
    want = sorted([(p, None, k) for p, k in n.items()] + [(*pq, k) for pq, k in pairs.items()], key=str)
    for block in (1000, 3):
        monkeypatch.setattr(metrics, "BLOCK", block)
        got = metrics.frequency(frame)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert block == 3 or "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # pairs form inside a cluster's set


def test_residues_by_stretches(spark, monkeypatch):
    texts = {1: "-a--bc-", 2: "", 3: "---", 4: "é𝄞-x", 5: "abc", 6: None, 7: "a-b\n- c--"}
    got = columns.residue_columns(spark.createDataFrame(list(texts.items()), "protein int, aligned string"))
    want = [(p, n + 1, c, x) for p, t in texts.items() for n, (c, x) in enumerate((c, x) for c, x in enumerate(t or "") if x != "-")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "filter(transform(" not in got._jdf.queryExecution().optimizedPlan().toString()  # nothing interpreted for each letter
    monkeypatch.setattr(q_structure, "DOCUMENTS", 20)
    assert QUERIES["residue_columns"](spark, SMALL).rdd.getNumPartitions() == spark.read.parquet(f"{SMALL}/documents.parquet").count() // 20 + 1


def test_featured_term_once_for_each_set(spark):
    mi = {(f, x): ((i * 7 + j * 5) % 6 - 2) / 2 for i, f in enumerate("FGH") for j, x in enumerate("abcde") if (i + j) % 3}
    held = {e: {x for j, x in enumerate("abcdez") if (e * 5 + j * j) % 4 < 2} or {"z"} for e in range(24)}
    ent = spark.createDataFrame([(e, x) for e, own in held.items() for x in own] * 2, "entity int, term string")
    got = metrics.featured_term(ent, spark.createDataFrame([(f,) for f in "FGHN"], "func string"), spark.createDataFrame([(*k, v) for k, v in mi.items()], "acc string, acc2 string, metric double"))
    want = [(e, f, *max(((mi.get((f, x), 0.0), x) for x in own))[::-1]) for e, own in held.items() for f in "FGHN"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "entity#" in plan and not any("Aggregate [entity#" in line for line in plan.splitlines())  # sets of terms meet functions, not entities


def test_predictions_join_no_rows_by_function(spark, monkeypatch):
    monkeypatch.setattr(predict, "FUNCTIONS", 3)
    monkeypatch.setattr(tables, "ROWS", 15)
    rng, d = random.Random(5), math.log(1e-7)
    funcs = {f"f{i}": -0.9 * i for i in range(9)}  # f0 isn't below the upper bound
    terms = {"p": [f"p{i}" for i in range(5)], "l": [f"l{i}" for i in range(4)]}
    codes = [f"s{i}" for i in range(4)]
    lr = {(f, x): rng.uniform(-6, 9) for f in funcs for x in [*terms["p"], *terms["l"], *codes] if rng.random() < 0.5}
    mi = {(f, x): rng.choice([-0.5, 0.0, 0.0, 0.5, 1.0]) for f in funcs for k in "pl" for x in terms[k] if rng.random() < 0.5}
    held = {(e, k): {x for x in terms[k] if rng.random() < 0.4} for e in range(12) for k in "pl"}
    domains = [(i, rng.choice([*range(12), None, 99])) for i in range(40)]
    sets = [(i, n, x, rng.choice([0.0, 0.1, 0.4])) for i in range(42) if i % 9 for n in range(1, 3) for x in rng.sample([*codes, "none"], rng.randint(1, 3))]
    frame = spark.createDataFrame
    ent = [frame([(e, x) for (e, k), own in held.items() if k == kind for x in own] * 2 + [(None, terms[kind][0]), (3, None)], "entity int, term string") for kind in "pl"]
    metric = lambda m: [(*k, v) for k, v in m.items()]
    args = (
        frame(domains, "domain int, parent int"), frame(sets, "domain int, set_id int, sccs string, p double"), *ent,
        frame([(f, None, v) for f, v in funcs.items()] + metric(lr), "acc string, acc2 string, metric double"), frame(metric(mi), "acc string, acc2 string, metric double"),
    )
    mass = defaultdict(list)
    for i, n, x, p in sets:
        mass[i, n].append((x, p))
    want = {}
    for i, parent in domains:
        for (j, n), own in mass.items():
            for f, b in funcs.items():
                if i == j and b < 0:
                    top = [max(((mi.get((f, x), 0.0), x) for x in held.get((parent, k), ())), default=(0, None))[1] for k in "pl"]
                    p, l, s = *(lr.get((f, x), d) if x else 0.0 for x in top), sum(q * lr.get((f, x), d) for x, q in own)
                    want[i, n, f] = (parent, b + p, b + l, b + s, b + p + l, b + p + s, b + l + s, b + p + l + s, b, *top)
    for lower in (-99.0, -20.0, -7.5):
        got = predict.predict_functions(*args, lower=lower)
        rows = {(r["domain"], r["set_id"], r["func"]): (r["parent"], *[r[x] for x in predict.SCORES], r["p_acc"], r["l_acc"]) for r in got.collect()}
        assert set(rows) == {k for k, v in want.items() if v[7] >= lower} and len(rows) == got.count()
        assert all(rows[k][1:9] == pytest.approx(want[k][1:9]) and rows[k][::9] == want[k][::9] and rows[k][-1] == want[k][-1] for k in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join " in line and "func#" in line for line in plan.splitlines())


def test_families_move_as_lists(spark, monkeypatch):
    rng = random.Random(1)
    held = {(f"f{f:02}", p) for f in range(40) for p in range(25) if rng.random() < 0.3} | {(f"f{f:02}", 99) for f in range(40)}
    frame = spark.createDataFrame(sorted(held) * 2 + [(None, 1), ("f01", None)], "family string, protein_key int")
    want = {(f, g) for f, p in held for g, q in held if p == q and f != g}
    for block in (1000, 7):
        monkeypatch.setattr(hits, "BLOCK", block)
        got = hits.related_families(frame)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange hashpartitioning" in line and "other#" in line for line in plan.splitlines())  # no pair moves


def test_novel_or_extended_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(ontology, "TILE", 4)
    monkeypatch.setattr(ontology, "RESULTS", 30)
    frame = spark.createDataFrame
    seqs, doms = [(s, s % 2) for s in range(23)] + [(99, None), (98, 7)], [(100 + a, a, a % 2) for a in range(17)] + [(103, 5, 1), (200, None, 0)]
    old = {(s, a) for s in range(23) for a in range(17) if s % 3 and (s * a) % 4 == 1} | {(5, 3), (5, 5), (4, 90)}
    got = ontology.novel_or_extended_in_groups(frame(seqs, "sequence_key int, group int"), frame(doms, "domain_key int, acc int, group int"), frame(sorted(old) * 2, "sequence_key int, acc int"))
    accs = defaultdict(set)
    for d, a, g in doms:
        accs[d, g].add(a)
    has = {s for s, _ in old}
    want = {(d, s): "novel" if s not in has else "extended" if any(a is None or (s, a) not in old for a in own) else "known" for s, g in seqs for (d, h), own in accs.items() if g == h}
    assert {(r["domain_key"], r["sequence_key"]): r["status"] for r in got.collect()} == want and got.count() == len(want)
    assert got.rdd.getNumPartitions() == len(want) // 30 + 1 > 4  # tasks follow the rows of the result
    for part in got.rdd.glom().collect():  # a domain's rows of a tile stand together
        runs = 1 + sum(x["domain_key"] != y["domain_key"] for x, y in itertools.pairwise(part))
        assert not part or runs <= len(part) / 2
