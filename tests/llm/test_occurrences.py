"""Several occurrences of a benchmark item in one document."""

from __future__ import annotations

from foldspark.llm import decontaminate

ITEM = "A train leaves Boston at 60 km per hour and travels 120 km before it stops in Albany for 15 minutes to change its crew."
FILLER = "some plain words that stand between and tell of nothing else at all"


def _variant(*to: str) -> str:
    text = ITEM
    for a, b in zip(("60", "120", "15", "Boston", "Albany"), to):
        text = text.replace(a, b)
    return text


def test_each_occurrence_is_judged_by_itself(spark):
    one, two = _variant("75", "150", "20", "Denver", "Omaha"), _variant("80", "190", "35", "Paris", "Lyon")
    put_in = two.replace("before it stops", "before it then stops")
    texts = [f"{FILLER}. {one} {FILLER}. {two}", f"{ITEM} {one}", f"{one} {two} {ITEM} {FILLER}", f"{FILLER}. {put_in} {FILLER}. {one} {put_in}", FILLER]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {0, 1, 2, 3} and [got[i]["exact"] for i in range(4)] == [False, True, True, False]
    assert all(r["consistent"] == 1.0 and r["n_slots"] >= 3 for r in got.values())
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == {4}
