"""The pipeline's near-duplicate stage against brute force on planted near copies."""

from __future__ import annotations

import random

import corpus_pipeline

from foldspark.llm import resemblance


def _runs(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _like(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def _planted() -> list[tuple[int, str]]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abdeilnorstu") for _ in range(6))
    rows, line = [], " ".join(word() for _ in range(12))
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(4):  # edits about the limit, both sides of it, in chains
            base = list(base)
            for _ in range(max(1, len(base) // rng.choice([45, 60, 90]))):
                base[rng.randrange(len(base))] = word()
            rows.append(" ".join(base) + rng.choice(["", " tail", f" {line}"]))
    rows += ["", " \n", "one two", "One  TWO", line.upper(), line]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    rows = _planted()
    sets = {i: _runs(t) for i, t in rows}
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    direct = 0
    for i in sets:
        for j in range(i):
            if _like(sets[i], sets[j]) >= 0.8:
                direct += sets[i] != sets[j]
                x, y = sorted((find(i), find(j)))
                of[y] = x
    assert direct > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(df).collect()} == {i: find(i) for i in sets}
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in sets}


def test_near_copies_edges(spark):
    schema = "doc_id long, text string"
    assert resemblance.near_copies(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "no id here"), (5, None), (6, ""), (7, "long " * 30_000), (7, "long " * 30_000), (8, "x")]
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in resemblance.near_copies(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(0, None), (5, 5), (6, 5), (7, 7), (7, 7), (8, 8)]


def test_one_row_stays_of_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "x"), (5, text, "x"), (5, "another text of the same id altogether", "y"), (6, text, "z"), (None, "alone here without any id", None), (None, text, "q"), (7, "the only text of its own kind", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(map(str, ((r["doc_id"], r["key"]) for r in resemblance.keep_one(df).collect())))
    assert got == sorted(map(str, [(5, "x"), (5, "y"), (None, None), (7, "k")]))


def test_large_clusters_of_near_copies(spark, monkeypatch):
    """Hubs and blocks give what all pairs give."""
    monkeypatch.setattr(resemblance, "BLOCK", 600)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeilnorstu") for _ in range(6))
    rows = []
    for size in (70, 45, 30):
        base = [word() for _ in range(80)]
        for k in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    sets = {i: _runs(t) for i, t in rows}
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in sets:
        for j in range(i):
            if _like(sets[i], sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                of[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(df).collect()} == {i: find(i) for i in sets}
