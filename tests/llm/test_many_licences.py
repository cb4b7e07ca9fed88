"""Licence scans with hundreds of templates and thousands of words."""

from __future__ import annotations

import random

from foldspark.llm import license_index


def test_five_hundred_templates(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(2500)]
    templates = []
    for i in range(500):
        text = rng.sample(words, rng.randint(6, 40))
        at = rng.randint(0, len(text) - 4)
        templates.append(license_index.Template(f"x{i:03}", " ".join(text), " ".join(text[at : at + 4])))
    long = ("long", " ".join(words[:150]))
    index = license_index.Index(tuple(templates), (*license_index.BASE, (long[1], long[0])))
    assert len(index.words) > 2000
    held = {i: rng.sample(range(500), i % 4) for i in range(120)}
    rows = [(i, " and then ".join(f"{'Foo ' * rng.randint(0, 9)}{templates[t].text.title()}." for t in own)) for i, own in held.items()]
    rows += [(500, templates[7].mandatory), (501, " ".join(reversed(templates[8].text.split()))), (502, f"so {long[1]} it is"), (503, None)]
    got = {r["doc_id"]: r for r in license_index.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), index=index).collect()}
    for i, own in held.items():
        assert {f"x{t:03}" for t in own} <= set(got[i]["labels"].split(",")), i
    assert got[501]["labels"] == "" and got[502]["base_labels"] == "long" and (got[502]["n_base"], got[502]["first_word"]) == (1, 1) and got[503]["labels"] == ""
