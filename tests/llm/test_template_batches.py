"""Template matching: rows don't depend on batches, nor time on how items begin or repeat."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa

from foldspark.llm import decontaminate


def _phrase(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def _found(table: decontaminate.ItemTable, texts: list[str], batch: int) -> set[tuple]:
    out = set()
    for at in range(0, len(texts), batch):
        tokens = decontaminate.Tokens(pa.array(texts[at : at + batch], pa.string()))
        out |= {(at + d, *x) for d, told in decontaminate._by_document(table, tokens) for x in told}
    return out


def test_rows_do_not_depend_on_batches():
    rng = random.Random(7)
    items = [(i, _phrase(rng, 1 + i % 9)) for i in range(300)]
    table = decontaminate.ItemTable(items)
    texts = [t for _, t in items]
    alone = _found(table, texts, 1)
    assert {(i, i) for i in range(300)} <= {(d, item) for d, item, *_ in alone}
    assert alone == _found(table, texts, 2) == _found(table, texts, 7) == _found(table, texts, 300)


def test_short_items_in_one_row_partitions(spark):
    items = ["tomato basil", "red cup", "green tea now", "blue sky over us all"]
    docs = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i in range(4)}
    assert decontaminate.keep_clean(docs, bench).count() == 0


def test_operators_are_told_apart():
    table = decontaminate.ItemTable([(1, "Compute 5 - 3 and say what it is in words"), (2, "Solve 3x + 5 = 20"), (3, "7 * 2")])
    got = _found(table, ["Compute 5 + 3 and say what it is in words", "Solve 3x - 5 = 20", "Compute 5 - 3 and say what it is in words", "so Solve 3x + 5 = 20 now", "7 / 2", "that 7 * 2 is"], 6)
    exact = {(d, item) for d, item, *_, same in got if same}
    assert exact == {(2, 1), (3, 2), (5, 3)}
    assert {(d, item) for d, item, *_ in got} - exact <= {(0, 1)}  # the same words about other numbers


def test_many_items_with_one_beginning():
    rng = random.Random(1)
    tails = [_phrase(rng, 9) for _ in range(20_000)]
    texts = [" ".join(f"what is the {_phrase(rng, 9)}." for _ in range(60)) for _ in range(100)] + [f"so what is the {tails[5]}"]
    took = []
    for start in ("", "what is the "):
        table = decontaminate.ItemTable([(i, start + t if start else f"{_phrase(rng, 3)} {t}") for i, t in enumerate(tails)])
        began = time.perf_counter()
        found = _found(table, texts, 50)
        took.append(time.perf_counter() - began)
        assert {(d, item) for d, item, *_ in found} == {(100, 5)}
    assert took[1] < 2 * took[0] + 0.5


def test_repeated_passages_are_not_multiplied():
    passage = "the red cup of 5 litres stands beside the old green door of Anna "
    table = decontaminate.ItemTable([(1, passage * 300)])
    began = time.perf_counter()
    found = _found(table, [passage.replace("5", "6") * 300, passage * 299, passage * 301], 3)
    assert time.perf_counter() - began < 2
    assert {d for d, *_ in found} == {0, 1, 2} and {d for d, *_, same in found if same} == {2}


def test_run_hashes_are_those_of_the_values_alone():
    rng = np.random.default_rng(4)
    value = rng.integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2)
    value[30:40] = value[5:15]
    runs = decontaminate.Runs(value)
    h = runs.hash(np.array([5, 30, 6, 30]), np.array([10, 10, 10, 9]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3
