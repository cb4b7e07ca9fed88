"""Language sets with many languages: same sets as when all sizes are tried, in time linear in the languages."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from foldspark.llm import langid


def _model(n: int, seed: int) -> langid.LanguageModel:
    rng = np.random.default_rng(seed)
    table = np.log(rng.dirichlet(np.ones(langid.BUCKETS) * 0.05, n).T + 1e-9)
    mean = table.mean(axis=1)
    return langid.LanguageModel([f"l{j:02}" for j in range(n)], table - mean[:, None], mean + np.log(langid.BUCKETS))


def _texts(n: int, size: int) -> pa.Array:
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)])
    return pa.array([" ".join(rng.choice(words, size)) for _ in range(n)])


def test_no_larger_set_is_missed(monkeypatch):
    model, texts = _model(6, 1), _texts(60, 40)
    got = langid.mixtures(model, texts)
    em = langid._em

    def endless(*args, **kwargs):
        pi, gap = em(*args, **kwargs)
        return pi, gap + 1e9

    monkeypatch.setattr(langid, "_em", endless)  # all sizes are tried for all documents
    want = langid.mixtures(model, texts)
    for a, b in zip(got, want):
        assert a == pytest.approx(b)
    assert len({int((row > 0).sum()) for row in got[0]}) > 1


def test_time_is_linear_in_languages():
    texts = _texts(400, 120)
    took = []
    for n in (16, 64):
        model = _model(n, 2)
        began = time.process_time()
        langid.mixtures(model, texts)
        took.append(time.process_time() - began)
    assert took[1] < 6 * took[0]
