"""Fingerprints of texts that may hold no syncmer."""

from __future__ import annotations

import random

import numpy as np

from foldspark.llm import syncmers


def test_texts_without_a_syncmer_have_their_own_fingerprint():
    rng = random.Random(11)
    texts = ["Eser thed nt of.", "Thre er. And erhe."] + ["".join(rng.choice("abcdefgh .") for _ in range(n)) for n in range(1, 41) for _ in range(20)]
    texts = sorted(set(texts))
    rows = syncmers.sketches([*texts, ""])
    assert not rows[-1].any() and rows[:-1].any(axis=1).all()
    who, _, _ = syncmers.anchors(texts)
    assert set(who.tolist()) == set(range(len(texts)))
    blank = np.repeat(rows[-1:], len(texts), axis=0)
    assert (syncmers.likeness(rows[:-1], blank) == 0).all()
    short = np.flatnonzero([16 <= len(t) <= 25 for t in texts])
    assert (syncmers.likeness(rows[short[:-1]], rows[short[1:]]) < 1).all()
    assert (np.stack([syncmers.sketches([t])[0] for t in texts]) == rows[:-1]).all()
