"""Constants of the four-cluster fixture."""

import math

import pytest

from foldspark.operators import metrics

ROWS = [(i, "all") for i in range(4)] + [(i, "a.51.1") for i in range(3)] + [(i, "GO:0043227") for i in range(2)]


@pytest.fixture(scope="module")
def freq(spark):
    return metrics.frequency(spark.createDataFrame(ROWS, "cluster_id int, predictor string"))


def _get(df, a, b, col="metric"):
    rows = df.where(f"acc = '{a}' and acc2 {'is null' if b is None else f"= '{b}'"}").collect()
    assert len(rows) == 1
    return rows[0][col]


def test_frequency(freq):
    assert _get(freq, "all", None) == 4
    assert _get(freq, "a.51.1", None) == 3
    assert _get(freq, "a.51.1", "GO:0043227") == 2
    assert _get(freq, "GO:0043227", "a.51.1") == 2
    assert _get(freq, "all", "a.51.1") == 3


def test_frequency_not(freq):
    out = metrics.frequency_not(freq)
    assert _get(out, "a.51.1", "GO:0043227", "a_not_b") == 1
    assert _get(out, "a.51.1", "GO:0043227", "not_a_b") == 0
    assert _get(out, "a.51.1", "GO:0043227", "not_a_not_b") == 1


def test_probability(freq):
    p = metrics.probability(freq)
    assert _get(p, "a.51.1", "GO:0043227") == pytest.approx(2 / 3, abs=1e-4)
    assert _get(metrics.probability(freq, 2.0), "a.51.1", "GO:0043227") == pytest.approx(0.5833, abs=1e-4)
    assert all(0 <= r["metric"] <= 1 for r in p.collect())
    assert all(r["metric"] > 0.99 for r in p.where("acc2 = 'all'").collect())


def test_log_ratio(freq):
    lr = metrics.log_ratio(metrics.probability(freq))
    assert _get(lr, "a.51.1", "GO:0043227") == pytest.approx(15.0194, abs=1e-3)
    assert _get(lr, "GO:0043227", "a.51.1") == pytest.approx(0.6931, abs=1e-3)


def test_mutual_information(freq):
    mi = metrics.mutual_information(metrics.probability(freq))
    assert _get(mi, "a.51.1", "GO:0043227") == pytest.approx(0.14384, abs=1e-4)
    assert _get(mi, "GO:0043227", "a.51.1") == pytest.approx(0.04247, abs=1e-4)
    assert _get(mi, "a.51.1", "a.51.1") == pytest.approx(0.21576, abs=1e-4)
    assert _get(mi, "all", "all") == pytest.approx(0.0, abs=1e-4)


def test_featured_term(spark):
    mi = spark.createDataFrame([("F", "A", 0.0), ("F", "B", 1.0), ("F", "C", 2.0), ("F", "D", 3.0), ("F", "E", 3.0), ("X", "E", 3.0), ("N", "A", -1.0)], "acc string, acc2 string, metric double")
    ent = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (2, "D"), (2, "E"), (3, "A"), (3, "Z")], "entity int, term string")
    got = {(r["entity"], r["func"]): (r["term"], r["mi"]) for r in metrics.featured_term(ent, spark.createDataFrame([("F",), ("N",)], "func string"), mi).collect()}
    assert got[1, "F"] == ("C", 2.0)
    assert got[2, "F"] == ("E", 3.0)
    assert got[3, "N"] == ("Z", 0.0)  # an absent value of 0 beats a stored negative one


def test_lookup_default(spark, freq):
    pairs = spark.createDataFrame([("a.51.1", None), ("a.51.1", "none")], "acc string, acc2 string")
    assert sorted(r["metric"] for r in metrics.metric_lookup(pairs, metrics.probability(freq), math.log(1e-7)).collect()) == pytest.approx([math.log(1e-7), 0.75], abs=1e-5)
