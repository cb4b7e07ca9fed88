"""Published constants and invariants of the other operators."""

import math

import pytest
from pyspark.sql import functions as F

from foldspark.functions import scalar
from foldspark.operators import columns, enrich, evaluate, hits, ontology, predict, structure, summary


def test_hypergeometric():
    assert scalar.hypergeom_values([4, 5], [5, 5], [45, 45], [10, 10]).tolist() == pytest.approx([0.0039645830580152617, 0.00011893749174045687])


def test_scop(spark):
    parts = spark.createDataFrame([("s1", "p", "A", None, None, 30, "a.1.1"), ("s1", "p", "B", None, None, 30, "a.1.1"), ("s2", "q", "D", 118, 211, 500, "b.1.1"), ("s2", "q", "D", 372, 450, 500, "b.1.1")], "scop string, pdb string, chain string, start int, stop int, chain_len int, sccs string")
    assert {r["scop"]: r["length"] for r in structure.scop_length(parts).collect()} == {"s1": 60, "s2": 94 + 79}
    domains = spark.createDataFrame([(1, "p", "A", 0, 30), (2, "p", "A", 0, 31), (3, "q", "D", 0, 400)], "domain int, pdb string, chain string, start int, stop int")
    got = {r["domain"]: r["sccs"] for r in structure.assign_scop(domains, parts).collect()}
    assert got == {2: "a.1.1", 3: "b.1.1"}  # 30 of 60 is not over half, 31 is


def test_best_call(spark):
    rows = spark.createDataFrame([(1, 2, 1.0, "x"), (1, 1, 0.8, "y"), (2, 1, 0.75, "a"), (2, 1, 0.9, "b")], "domain int, size int, confidence double, sccs string")
    assert {r["domain"]: r["sccs"] for r in structure.best_call_per_domain(rows).collect()} == {1: "x", 2: "b"}


def test_function_scores(spark):
    lr = spark.createDataFrame([("MF", None, 1.0), ("MF", "P", 10.0), ("MF", "L", 10.0), ("MF", "A", 30.0), ("MF", "a.1.1", 10.0)], "acc string, acc2 string, metric double")
    mi = spark.createDataFrame([("MF", "P", 10.0), ("MF", "L", 10.0), ("MF", "Z", 20.0), ("MF", "A", 30.0)], "acc string, acc2 string, metric double")
    domains = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "domain int, parent int")
    sets = spark.createDataFrame([(1, 1, "a.1.1", 1.0), (2, 1, "a.1.1", 1.0), (3, 1, "a.1.1", 1.0), (4, 1, "b.1.1", 1.0)], "domain int, set_id int, sccs string, p double")
    proc = spark.createDataFrame([(1, "P"), (2, "P"), (3, "Z"), (3, "P"), (4, "Z"), (4, "P")], "entity int, term string")
    loc = spark.createDataFrame([(1, "L"), (4, "A"), (4, "L")], "entity int, term string")
    got = {r["domain"]: r["pls_llr"] for r in predict.predict_functions(domains, sets, proc, loc, lr, mi, lower=-99, upper=99).collect()}
    d = math.log(1e-7)
    assert got == pytest.approx({1: 31.0, 2: 21.0, 3: d + 10 + 1, 4: d + 30 + d + 1})


def test_closure_and_leaves(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d")], "parent string, child string")
    closure = ontology.transitive_closure(edges)
    got = {(r["ancestor"], r["descendant"]): r["distance"] for r in closure.collect()}
    assert got["r", "d"] == 3 and got["r", "r"] == 0 and got["a", "d"] == 2 and ("d", "a") not in got
    assert {(a, d2) for (a, b) in got for (b2, d2) in got if b == b2} == set(got)  # transitive
    terms = spark.createDataFrame([(1, "r"), (1, "a"), (1, "b"), (2, "c"), (2, "d")], "entity int, acc string")
    assert {(r["entity"], r["acc"]) for r in ontology.local_leaves(terms, closure).collect()} == {(1, "a"), (1, "b"), (2, "d")}


def test_chain_mappings(spark):
    m1 = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("E", "e")], "src string, dst string")
    m2 = spark.createDataFrame([("d", "D"), ("c", "Z"), ("a", "A")], "src string, dst string")
    out = hits.chain_mappings(m1, m2)
    assert {(r["src"], r["dst"]) for r in out.collect()} == {("A", "A"), ("C", "Z")}
    assert ("Z", "C") in {(r["src"], r["dst"]) for r in hits.inverse(out).collect()}


def test_seed_column_map(spark):
    rows = [(1, i, s == "-", t == "-") for i, (s, t) in enumerate(zip("A-BCD", "-ZBCD"))]
    got = columns.seed_column_map(spark.createDataFrame(rows, "alignment int, col int, seed_gap boolean, target_gap boolean")).orderBy("residue").collect()
    assert [r["seed_col"] for r in got] == [None, 1, 2, 3]


def test_similarity_is_symmetric(spark):
    el = spark.createDataFrame([("p", 1, 10), ("p", 2, 11), ("q", 1, 12)], "protein string, elem int, structure int")
    sc = spark.createDataFrame([(10, 12, 6.0), (12, 11, 3.0)], "a int, b int, zscore double")
    got = structure.pairwise_max_avg(el, sc).collect()
    assert [(r["p"], r["q"], r["similarity"]) for r in got] == [("p", "q", pytest.approx((6 + 3 + 6) / 3))]


def test_precision_recall_two_levels(spark):
    rows = [(float(i % 50), 1 if i % 3 else -1) for i in range(1000)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = {r["score"]: r for r in evaluate.precision_recall(df, parts=7).collect()}
    for s in (0.0, 17.0, 49.0):
        n = [x for x in rows if x[0] >= s]
        h = sum(x[1] > 0 for x in n)
        assert (got[s]["n"], got[s]["hits"]) == (len(n), h)
        assert got[s]["recall"] == pytest.approx(h / sum(x[1] > 0 for x in rows))


def test_resample_and_share(spark):
    df = spark.range(100).select(F.col("id").alias("query"))
    got = enrich.background_resample(df, 10, 3).groupBy("iteration").count().collect()
    assert [r["count"] for r in got] == [10, 10, 10]
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "feature string, n long")
    assert sum(r["share"] for r in enrich.proportion(counts).collect()) == pytest.approx(1)


def test_site_clustering(spark):
    pts = [(1, i, float(i), 0.0, 0.0) for i in range(30)]
    coords = spark.createDataFrame(pts, "structure int, residue int, x double, y double, z double")
    near = spark.createDataFrame([(1, 3), (1, 4), (1, 5)], "structure int, residue int")
    r = columns.site_clustering(coords, near, 20).collect()[0]
    assert r["target"] == pytest.approx((1 + 1 + 0.5) / 3) and r["percentile"] > 0.9


def test_representative_path(spark):
    rows = [(1, 1, 1, 50, 0.9), (1, 2, 51, 100, 0.9), (1, 3, 20, 80, 0.85), (2, 4, 1, 9, 0.9), (3, 5, 1, 9, 0.2)]
    got = structure.representative_path(spark.createDataFrame(rows, "domain int, key int, start int, stop int, ratio double"))
    assert {(r["domain"], r["key"]) for r in got.collect()} == {(1, 1), (1, 2), (2, 4)}


def test_scalar_columns(spark):
    df = spark.createDataFrame([("A:5-90",), ("A:-5-90",), ("A:",), ("x",)], "t string")
    chain, start, stop = scalar.chain_range("t", F.lit(120))
    assert [tuple(r) for r in df.select(start, stop).collect()] == [(5, 90), (0, 90), (1, 120), (None, None)]
    assert spark.range(1).select(scalar.gene_name(F.lit("x GN=ABC y")), scalar.hit_id(F.lit("sp|P12|N"), "uniprot")).first()[:] == ("ABC", "P12")
    aln = spark.createDataFrame([(1, 0, "AB-D"), (1, 1, "ABCC")], "k int, o int, s string")
    assert [r["identity"] for r in scalar.percent_identity(aln, "k", "o", "s").orderBy("o").collect()] == [100, 50]


def test_top_percent(spark):
    df = spark.createDataFrame([("f", i, float(i)) for i in range(10)], "file string, decoy int, score double")
    assert sorted(r["decoy"] for r in summary.pare_top_percent(df).collect()) == [0, 1]


def test_cycles_are_errors(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    with pytest.raises(ValueError, match="cycle"):
        ontology.transitive_closure(ring)
    up = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2)], "node int, parent int")
    with pytest.raises(ValueError, match="cycle"):
        ontology.climb(up.select("node"), up, [9])


def test_deep_chains_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "parent int, child int")
    up = edges.select(F.col("child").alias("node"), "parent")
    assert ontology.climb(spark.createDataFrame([(70,)], "node int"), up, [0]).first()["stop"] == 0


def test_large_clusters_are_counted_in_blocks(spark, monkeypatch):
    from collections import Counter

    from foldspark.operators import metrics

    monkeypatch.setattr(metrics, "BLOCK", 7)
    rows = [(1, f"p{i}") for i in range(40)] + [(c, f"p{i}") for c in (2, 3) for i in range(c, 40, c)] + [(c, "all") for c in (1, 2, 3)] + [(4, "p1")]
    by: dict[int, set] = {}
    for c, p in rows:
        by.setdefault(c, set()).add(p)
    want = Counter()
    for own in by.values():
        want.update((a, None) for a in own)
        want.update((a, b) for a in own for b in own)
    got = {(r["acc"], r["acc2"]): r["metric"] for r in metrics.frequency(spark.createDataFrame(rows, "cluster_id int, predictor string")).collect()}
    assert got == dict(want)


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([("q", 1, 0.5, 9.0, "h|x", 7, 1), ("q", 2, 0.9, 3.0, "g|y", 8, 2)], "query string, hit int, confidence double, bits double, header string, id int, rn int")
    assert [tuple(r) for r in hits.best_hit_by(df).collect()] == [("q", 2, 0.9, 3.0, "g|y", 8, 2)]
    kept = hits.prune_filter(df, spark.createDataFrame([("h",)], "id string"))
    assert kept.columns == df.columns and kept.first()["id"] == 7


def test_fisher_tail_against_exact_sums():
    import pandas as pd

    rows = [(4, 1, 6, 30), (0, 5, 5, 9), (1, 30, 40, 500), (30, 2, 3, 50), (9, 300, 20, 4000), (2, 0, 0, 3), (-1, 2, 3, 4), (50, 50, 50, 50)]
    got = scalar.fisher_greater_p.func(*(pd.Series(x) for x in zip(*rows)))
    for (a, b, c, d), p in zip(rows, got):
        if a < 0:
            assert math.isnan(p)
            continue
        want = sum(math.comb(a + b, k) * math.comb(c + d, a + c - k) for k in range(a, min(a + b, a + c) + 1)) / math.comb(a + b + c + d, a + c)
        assert p == pytest.approx(want, rel=1e-9)


def test_shuffled_labels_are_one_permutation(spark):
    ids = spark.range(500).withColumn("id", F.col("id") * 3)
    got = evaluate.shuffle_labels(ids, "id", 1).collect()
    assert sorted(r["id"] for r in got) == sorted(r["other"] for r in got) == [3 * i for i in range(500)]
    assert sum(r["id"] == r["other"] for r in got) < 20 and sorted(map(tuple, got)) == sorted(map(tuple, evaluate.shuffle_labels(ids, "id", 1).collect()))


def test_similarity_matrix(spark):
    elements = spark.createDataFrame([(10, "a", 1), (10, "b", 2), (20, "a", 3), (30, "a", 9)], "protein int, elem string, structure int")
    scores = spark.createDataFrame([(1, 3, 6.0), (3, 2, 3.0)], "a int, b int, zscore double")
    matrix, keys = structure.similarity_matrix(elements, scores)
    assert {r["protein"]: r["idx"] for r in keys.collect()} == {10: 0, 20: 1, 30: 2}
    assert [tuple(r) for r in matrix.collect()] == [(0, 1, 5.0)]
    assert [list(r["values"]) for r in structure.dense_rows(matrix, keys).orderBy("idx").collect()] == [[0.0, 5.0, 0.0], [0.0] * 3, [0.0] * 3]


def test_predictions_reach_the_bound(spark):
    domains = spark.createDataFrame([(1, "P"), (2, None)], "domain int, parent string")
    structures = spark.createDataFrame([(1, 1, "s1", 1.0), (2, 1, "s9", 0.3)], "domain int, set_id int, sccs string, p double")
    process = spark.createDataFrame([("P", "t")], "entity string, term string")
    lr = spark.createDataFrame([("f", None, -1.0), ("g", None, -5.0), ("f", "s1", 2.0)], "acc string, acc2 string, metric double")
    mi = spark.createDataFrame([("f", "t", 0.5)], "acc string, acc2 string, metric double")
    d = math.log(1e-7)
    every = {(1, "f"): 1 + d, (1, "g"): -5 + 2 * d, (2, "f"): -1 + 0.3 * d, (2, "g"): -5 + 0.3 * d}
    for lower in (-99.0, -16.0, -12.0, 0.0):
        rows = predict.predict_functions(domains, structures, process, process.limit(0), lr, mi, lower=lower).collect()
        assert len(rows) == len({(r["domain"], r["func"]) for r in rows})
        assert {(r["domain"], r["func"]): r["pls_llr"] for r in rows} == pytest.approx({k: v for k, v in every.items() if v >= lower})


def test_related_families(spark):
    members = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2), ("b", 2), ("d", None), ("e", None)], "family string, protein_key int")
    assert sorted(map(tuple, hits.related_families(members).collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
