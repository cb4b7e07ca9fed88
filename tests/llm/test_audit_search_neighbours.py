"""Filter audit, lexical search and nearest neighbours against brute force and on edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from foldspark.llm import filter_audit, lexical, neighbours

DOCS = "doc_id long, text string, source string, h1 string, mask string, good string, n_terms string, terms string"


def _words(n: int, rng: random.Random, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def _documents() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for i in range(90):
        text = _words(rng.choice([3, 150, 199, 200, 201, 260]), rng, rng.choice([5, 400]))
        if i % 3 == 0:
            text += rng.choice([" A", " ABCDEF" * 9, " $", " é| x", " #\n\t"])
        rows.append((i, text, f"s{i % 4}" if i % 7 else None))
    rows += [(200 + i, rows[i % 5][1], "s0") for i in range(12)]
    rows += [(-1, None, ""), (-1, "", "s9"), (None, rows[1][1], "s1"), (None, "only here", "s1"), (None, "only here", "s1"), (3, rows[3][1], "s2"), (3, rows[3][1], "s2"), (500, "long $ " * 40_000, "s3")]
    return [(*r, "x", "y", "z", "n", "t") for r in rows]


def _fails(rows: list[tuple]) -> list[set[str]]:
    out = []
    for i, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = set()
        if len(w) < 200:
            own.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            own.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            own.add("C")
        if re.search(r"[#$%&*|]", t):
            own.add("D")
        if any((j if j is not None else math.inf) < (i if i is not None else math.inf) and (u or "") == t for j, u, *_ in rows):
            own.add("E")
        out.append(own)
    return out


def test_audit_against_every_order(spark):
    rows = _documents()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 220, 3)] + [(3, None, 1), (6, 1, 0), (None, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    fails, want, by_filter = _fails(rows), {}, Counter()
    parts = {r[2] or "" for r in rows}
    for part in parts:
        own = [(f, r[0]) for f, r in zip(fails, rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for k, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                want[part, "".join(order), k] = [len(left), len(gone), sum(name in f for f, _ in own) - len(gone), sum(f == {name} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                by_filter[part, name] += len(gone)
    assert len(got) == 600 * len(parts) and {r["step"] for r in got} == {1, 2, 3, 4, 5}
    for r in got:
        key = r["part"], r["filter_order"], r["step"]
        assert [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]] == want[key], key
        assert r["shapley"] == by_filter[r["part"], r["filter_order"][r["step"] - 1]]


def test_gray_walk_stores_every_subset():
    counts = np.random.default_rng(2).integers(0, 50, (16, 2, 3))
    states = filter_audit.gray_walk(counts)
    for active in range(16):
        assert (states[active] == sum(counts[m] for m in range(16) if not m & active)).all()
    assert filter_audit.order_steps(counts, "PQRS")["kept"].shape == (2, 24, 4)


def test_audit_edges(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, none).count() == 0
    got = filter_audit.audit(spark.createDataFrame([(None, None, None, *"xyznt")], DOCS), none).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and all(r["kept"] == (r["filter_order"].index("A") >= r["step"]) for r in got)
    assert {r["good_lost"] for r in got} == {0} and sum(r["shapley"] for r in got if r["step"] == 1) == 24 * 120


def test_audit_sql_on_the_fixture(spark):
    rows = [r for r in _documents() if r[0] is not None]
    docs, labels = [(r[0], r[1], r[2]) for r in rows], [(i, i % 2, int(i % 5 == 0)) for i in range(0, 220, 3)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    con.execute("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    cur = con.execute(filter_audit.SQL)
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select(*names).collect())) == want


def _terms(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _ranked(docs: list[tuple], items: list[tuple], top: int = 20) -> set[tuple]:
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = set()
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 12 * m)) for w in _terms(text) if w in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)}
    return out


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "GAMMA7", "été", "d-e", "x_y", "中文", "the", "the", "of"]) for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(150)]
    docs += [(7, docs[7][1]), (8, "Alpha alpha"), (9, "Alpha alpha"), (None, "alpha Alpha"), (300, None), (301, " \n--"), (302, "beta " * 50_000)]
    items = [(1, "alpha, the ALPHA of beta?"), (2, "ÉTÉ été 中文"), (3, "unknown words"), (4, None), (5, ""), (6, "the of the of the of"), (6, "the of the of the of"), (7, "d e x y"), (8, "gamma7")]
    df = spark.createDataFrame([(i, t, "q", "m", "s") for i, t in docs], "doc_id long, text string, query string, rank string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _ranked(docs, items)
    for options in ({}, {"shard": 40}, {"block": 20}):
        got = lexical.search(df, bench, **options).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert lexical.search(df.where("false"), bench).count() == 0 and lexical.search(df, bench.where("false")).count() == 0


def test_sequential_reads_resolve_ties_and_stop_early(monkeypatch):
    rng = np.random.default_rng(5)
    for size, spread in ((400, 3), (400, 1000), (30, 2)):
        for _ in range(20):
            lists, total = [], np.zeros(size, dtype=np.int64)
            for _ in range(rng.integers(1, 6)):
                doc = rng.permutation(size)[: rng.integers(1, size)].astype(np.int32)
                impact = -np.sort(-rng.integers(0, spread, len(doc)))
                total[doc] += impact
                lists.append((doc, impact))
            order = [d for d in np.lexsort((np.arange(size), -total)) if total[d] > 0][:20]
            found, score = lexical.nra(lists, size, 20, 1)
            assert found.tolist() == order and score.tolist() == total[order].tolist()
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop)
            return np.asarray(super().__getitem__(key))

    impact = np.arange(100_000, 0, -1).view(Watched)
    found, _ = lexical.nra([(np.arange(100_000, dtype=np.int32), impact)], 100_000, 20, 1)
    assert found.tolist() == list(range(20)) and max(reads) <= 2 * lexical.FIRST_READ


def _nearest(rows: list[tuple], top: int = 20) -> dict[int, list[tuple]]:
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v) and len(v) == 6]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            out[i] = sorted((-float((q * v).sum()), j) for j, v in ok if j != i)[:top]
    return out


def test_neighbours_exact_when_asked_to_be_sure(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-3, 4, (400, 6))  # small whole numbers: many ties, exact sums, unequal norms
    rows = [(i, v.tolist()) for i, v in enumerate(base) if v.any()]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000 + 20 * i, rows[6][1]) for i in range(5)]
    bad = [(5000, None), (5020, []), (5040, [0.0] * 6), (5060, [1.0, None, 0, 0, 0, 0]), (5080, [math.nan] * 6), (5100, [math.inf] * 6), (5120, [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in [*rows, *bad, rows[3]]], "vec_id long, embedding array<double>, ids string, cell int")
    want = _nearest(rows)
    for s in (neighbours.Settings(sure=1 - 1e-12), neighbours.Settings(sure=1 - 1e-12, cell=40, block=25, asked=3, leaf=4, sample=300)):
        got: dict[int, list] = {}
        for r in neighbours.nearest(df, settings=s).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
        assert {q: [x[:2] for x in g] for q, g in got.items()} == want
        assert all([x[2] for x in g] == list(range(1, 21)) for g in got.values())


def test_neighbours_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((30, 32))
    x = np.concatenate([centres[rng.integers(0, 30, 2500)] + 0.2 * rng.standard_normal((2500, 32)), rng.standard_normal((500, 32))])
    x *= rng.uniform(0.5, 2, (len(x), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in neighbours.nearest(df, settings=neighbours.Settings(cell=500, block=400)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]].astype(np.float32).astype(float) @ x[r["vec_id"]].astype(np.float32).astype(float)))
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * len(got)) > 0.93 and len(got) == len(x) / 20


def test_chi_square_test_bounds_what_is_verified():
    assert neighbours.chi_square(neighbours.chi_square_quantile(0.9, 8), 8) == pytest.approx(0.9)
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))  # two degrees: exponential
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((4000, 32)), np.ones((1, 32)) + 0.001 * rng.standard_normal((60, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    space = neighbours.Space(1.0, rng.standard_normal((33, 8)), np.zeros(0, dtype=np.int64), np.zeros(0))
    block = neighbours.Block(space, x, [np.array([i]) for i in range(len(x))], 64)
    seen = []
    block.vectors = type("Seen", (), {"__getitem__": lambda _, rows: (seen.append(len(rows)), x_in_order[rows])[1]})()
    x_in_order = x[[int(i[0]) for i in block.ids]]
    rows, _, _ = block.search(x[-1], space.project_query(x[-1:])[0], -math.inf, 21, neighbours.chi_square_quantile(0.97, 8))
    assert all(block.least[rows] >= 4000) and sum(seen) < 600


def test_neighbours_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], kind)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(20, None), (40, [])], kind)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(20, [1.0, 2.0])], kind)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (3, [0.5, -1.0])], kind)).count() == 0  # no queries
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [1.0, 2.0]), (3, [-1.0, -2.0])], kind)).orderBy("rank").collect()
    assert [tuple(r) for r in few] == [(0, 1, 2, 5.0), (0, 2, 1, -1.5), (0, 3, 3, -5.0)]
