"""Token ids of texts with combining marks, and ranges of rows that share an id."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from foldspark.llm import syncmers, token_counts, token_output

PAIRS = ["H̱", "J̌", "T̈", "W̊", "Y̊"]


def _equal(texts: list[str]) -> None:
    enc = token_output.encoder(token_counts.default_tokenizer())
    ids, offsets = enc.documents(pa.array(texts, pa.string()), 1)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == [*enc.rules.library.encode(t, add_special_tokens=False).ids, 1], ascii(t)


def test_capitals_whose_composed_forms_are_small_only():
    _equal([*PAIRS, *(p.lower() for p in PAIRS), " ".join(PAIRS), "HeLLo " + PAIRS[0] + ", WORLD. éÉ ABC, d", "É. À, no MARKS"])


def test_fuzz_of_texts_beyond_ascii():
    rng = random.Random(12)
    signs = ["́", "̈", "̊", "̌", "̱", "̸", "़", "ᄀ", "ᅡ", "é", "ß", "İ", "Σ", "ς", "ñ", "中", "ا", "🙂", "‍", ",", ".", "!", "'", "-", " ", " ", "\n"]
    letters = "aehjtwyAEHJTWYkKxX019"
    _equal(["".join(rng.choice(signs) if rng.random() < 0.4 else rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(10_000)])


def test_rows_of_one_id_are_dealt_to_several_ranges(spark):
    rows = [(None, f"text number {i} of no id") for i in range(400)] + [(i, f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = token_output.encoded(df, parts=8).where("doc_id is null").agg(F.countDistinct("part").alias("n")).first()["n"]
    assert parts >= 6
    got = token_output.token_files(df, parts=8).orderBy("start").collect()
    assert len(got) == 440 and [r["doc_id"] for r in got[400:]] == list(range(40))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert syncmers.edit_comparison(df, parts=8).count() == 440
