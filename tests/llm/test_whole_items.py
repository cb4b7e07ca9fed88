"""Benchmark items without windows, slots in both directions, and verbatim items against brute force."""

from __future__ import annotations

import random

import pyarrow as pa

from foldspark.llm import decontaminate

BARE = [(1, "What is 12 + 15 * 7?"), (2, "Solve 3x + 5 = 20"), (3, "12 km"), (4, "日本語の文は空白なしで書く"), (5, ""), (6, None), (7, " \n"), (8, "Ans")]


def test_items_without_windows_are_matched_as_they_are(spark):
    texts = ["so: What is 12 + 15 * 7? yes", "what is 12 + 16 * 7?", "Solve 3x + 5 = 20", "it is 12 km away", "it is 13 km away", "彼は日本語の文は空白なしで書くと言った", "日本語の文", None, "", "an Ans, and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(BARE, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (2, 2), (3, 3), (5, 4), (9, 8)}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == {1, 4, 6, 7, 8}


def test_one_value_may_not_stand_for_two():
    item = "give 5 apples to Ann then take 6 apples from Bob and give 7 to Cat again now please"
    text = "give 1 apples to Dan then take 1 apples from Dan and give 1 to Dan again now please"
    table = decontaminate.ItemTable([(1, item)])
    for t, found in ((text, False), (item.replace("5", "2").replace("Bob", "Eve"), True)):
        tokens = decontaminate.Tokens(pa.array([t]))
        assert bool(decontaminate.judged(table, tokens, *table.found(tokens))) == found


def test_verbatim_items_are_never_missed(spark):
    rng = random.Random(3)
    word = lambda: rng.choice([str(rng.randint(1, 99)), "km", "".join(rng.choice("abdeil") for _ in range(rng.randint(2, 6))), "Bob", "x+y"])
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 14)))) for i in range(60)]
    docs = []
    for i in range(200):
        held = rng.sample(items, rng.randint(0, 3))
        docs.append((i, " ".join(x for _, t in held for x in (*(word() for _ in range(rng.randint(0, 9))), t))))
    want = {(d, i) for d, text in docs for i, t in items if f" {t.lower()} " in f" {text.lower()} "}
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in rows}
