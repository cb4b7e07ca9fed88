"""Documents in several languages, and what no language explains."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldspark.llm import langid

ALPHA = {"wa": ["kato", "meri", "lonka", "sipu", "tavo"], "xb": ["grüft", "schnaz", "verzug", "blöde", "krampf"], "yc": ["quelio", "zhuje", "fyqua", "jyzhe", "pfuqe"], "zd": ["дума", "песня", "волга", "ветер", "город"]}


def test_all_languages_of_a_document_count(spark):
    rng = random.Random(2)
    text = lambda k, n: " ".join(rng.choice(ALPHA[k]) for _ in range(n))
    rows = [(i, text(k, 40), k) for i, k in enumerate(list(ALPHA) * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    noise = " ".join("".join(rng.choice("αβγδεζηθικλμνξοπ") for _ in range(9)) for _ in range(60))
    mixed = [(1, " ".join(text(k, 60) for k in list(ALPHA)[:3])), (2, " ".join(text(k, 60) for k in ALPHA)), (3, text("wa", 9)), (4, noise), (5, "12 34"), (6, None)]
    docs = spark.createDataFrame(mixed, "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert sorted(got[1]["langs"]) == ["wa", "xb", "yc"] and got[1]["shares"] == pytest.approx([1 / 3] * 3, abs=0.05)
    assert sorted(got[2]["langs"]) == list(ALPHA) and got[2]["shares"] == pytest.approx([1 / 4] * 4, abs=0.05)
    assert {r["doc_id"] for r in langid.keep_identified(docs, model).collect()} == {1, 2, 3}
    glued = "kato" * 16 + "волгаветер" * 40
    assert langid.identify(spark.createDataFrame([(1, glued)], "doc_id long, text string"), model).first()["lang_pred"] == "zd"
    assert (langid.mixtures(model, pa.array(["", "7"]))[2] == 0).all()
