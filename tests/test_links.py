"""Links between proteins: structures of many holders, proteins of many elements, tasks by links."""

import itertools

import pytest

from foldspark.operators import structure


@pytest.fixture
def tables(spark):
    el = [(p, e, s) for p in range(1, 9) for e, s in ((1, p % 3), (2, 10 + p % 2), (2, 20 + p), (3, 5))]
    sc = [(a, b, float((a * 7 + b * 3) % 11 - 2)) for a, b in itertools.combinations_with_replacement(sorted({s for *_, s in el}), 2) if (a + b) % 3]
    return el, sc, spark.createDataFrame(el, "protein int, elem int, structure int"), spark.createDataFrame(sc, "a int, b int, zscore double")


def brute(el, sc):
    z = {(a, b): s for a, b, s in sc} | {(b, a): s for a, b, s in sc}
    out = {}
    for p, q in itertools.combinations(sorted({x for x, *_ in el}), 2):
        best = {}
        for (x, e, s), (y, f, t) in itertools.product([r for r in el if r[0] == p], [r for r in el if r[0] == q]):
            if (s, t) in z:
                for k in ((0, e), (1, f)):
                    best[k] = max(best.get(k, 0.0), z[s, t])
        if best:
            out[p, q] = sum(best.values()) / 6
    return out


def test_links_in_blocks(tables, monkeypatch):
    el, sc, elements, scores = tables
    want = brute(el, sc)
    monkeypatch.setattr(structure, "BLOCK", 2)
    monkeypatch.setattr(structure, "LINKS", 20)
    got = structure.pairwise_max_avg(elements, scores, is_canonical=True)
    assert got.rdd.getNumPartitions() > 4  # follows the links, not the setting
    assert {(r["p"], r["q"]): pytest.approx(r["similarity"]) for r in got.collect()} == want
    top = structure.homolog_all_vs_all(elements, scores, 2, is_canonical=True).collect()
    for s in range(1, 9):
        near = sorted(((v, q if p == s else p) for (p, q), v in want.items() if s in (p, q)), key=lambda x: (-round(x[0], 9), x[1]))[:2]
        assert [r["other"] for r in sorted(top, key=lambda r: r["rank"]) if r["source"] == s] == [o for _, o in near]
    matrix, keys = structure.similarity_matrix(elements, scores, is_canonical=True)
    assert {(r["row"] + 1, r["column"] + 1): pytest.approx(r["similarity"]) for r in matrix.collect()} == want


def test_holders_move_once_to_a_range(spark, monkeypatch):
    def rows_and_entries(*_):
        def told(batches):
            import pyarrow as pa

            for b in batches:
                n = b.num_rows
                sizes = [b.column(c).flatten().__len__() for c in (1, 6)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (n, sum(sizes))] + [pa.array([0.0])] + [pa.array([0])] * 2, ["p", "q", "total", "n_p", "n_q"])
        return told

    monkeypatch.setattr(structure, "pair_sums", rows_and_entries)
    # Ten groups of 20 proteins that hold one structure each with 5 others; their numbers follow the group.
    el = [(p, e, (p // 20) * 10 + e) for p in range(200) for e in range(6)]
    sc = [(g * 10, g * 10 + e, 1.0) for g in range(10) for e in range(1, 6)]
    got = structure.pairwise_max_avg(spark.createDataFrame(el, "protein long, elem int, structure long"), spark.createDataFrame(sc, "a long, b long, zscore double"), is_canonical=True).select("p", "q")
    rows, entries = (sum(c) for c in zip(*got.collect()))
    # A row a score and holder would be 2 * 5 * 20 * 10 with as many others each; ranges cut a few groups, each then moves twice.
    assert rows <= 2 * 10 and entries <= 2 * 10 * 6 * 20


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_sums_a_few_proteins_at_a_time(monkeypatch, kind):
    import random

    import pyarrow as pa

    from foldspark.functions import linked

    monkeypatch.setattr(linked, "CHUNK", 7)
    rng = random.Random(3)
    name = {"int": lambda p: p - 20, "string": lambda p: f"é{p:03}", "long": lambda p: p << 40}[kind]
    holders = {s: sorted({rng.randrange(40) for _ in range(rng.randint(1, 12))} | {7}) for s in range(12)}
    code = {(s, p): (s + p) % 3 + 3 for s in holders for p in holders[s]}  # element of 3
    scores = {(a, b): rng.choice([-1.0, 0.5, 2.0, 3.0, float(a)]) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5}
    rows = []
    for a in range(12):
        bs = [b for x, b in scores if x == a]
        rows.append((len(holders[a]), [name(p) for p in holders[a]], [code[a, p] for p in holders[a]], [scores[a, b] for b in bs], [len(holders[b]) for b in bs], [len(holders[b]) for b in bs], [name(p) for b in bs for p in holders[b]], [code[b, p] for b in bs for p in holders[b]]))
    q = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[kind]
    types = [pa.int32(), pa.list_(q), pa.list_(pa.int8()), pa.list_(pa.float64()), pa.list_(pa.int16()), pa.list_(pa.int16()), pa.list_(q), pa.list_(pa.int8())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["ma", "aq", "ac", "zs", "nb", "mb", "bq", "bc"])
    best = {}
    for (a, b), z in scores.items():
        for u, v in itertools.product(holders[a], holders[b]):
            for p, q_, e in ((u, v, code[a, u]), (v, u, code[b, v])):
                if p != q_:
                    best[p, q_, e] = max(best.get((p, q_, e), 0.0), z)
    want = {}
    for (p, q_, _), z in best.items():
        want[min(p, q_), max(p, q_)] = want.get((min(p, q_), max(p, q_)), 0.0) + z
    got = [r for b in linked.pair_sums()(iter([batch])) for r in b.to_pylist()]
    assert {(r["p"], r["q"]): r["total"] for r in got} == {(name(p), name(v)): z for (p, v), z in want.items()} and len(got) == len(want)
    assert {r["n_p"] for r in got} | {r["n_q"] for r in got} == {3}
    got = [r for b in linked.pair_sums(3, structure.mean_of_both)(iter([batch])) for r in b.to_pylist()]
    for p in range(40):
        near = sorted(((-z / 6, v if x == p else x) for (x, v), z in want.items() if p in (x, v)))[:3]
        assert sorted((r["rank"], r["q"], r["similarity"]) for r in got if r["p"] == name(p)) == [(i + 1, name(v), -z) for i, (z, v) in enumerate(near)]
