"""Sketches and likeness by position against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from foldspark.llm import syncmers


def _sketch(text: str) -> list[tuple[int, int]]:
    """(byte, position) of each bin, one anchor at a time."""
    _, pos, h = syncmers.anchors([text])
    bins: dict[int, tuple[int, int]] = {}
    for p, x in zip(pos.tolist(), h.tolist()):
        b, low = x >> 57, (x & ((1 << 57) - 1)) >> 8
        bins[b] = min(bins.get(b, (1 << 60, 0)), (low, p % 256))
    out = []
    for b in range(syncmers.BINS):
        far = next(d for d in range(syncmers.BINS) if (b + d) % syncmers.BINS in bins)
        low, p = bins[(b + far) % syncmers.BINS]
        out.append((int(syncmers._mix(np.array([low + far], dtype=np.uint64))[0] >> np.uint64(56)), p))
    return out


def _like(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x, y = _sketch(a), _sketch(b)
    offsets = [(p - q) % 256 for (h, p), (g, q) in zip(x, y) if h == g]
    count = Counter(offsets)
    return sum(count[o] > 1 for o in offsets) / syncmers.BINS


def test_sketches_and_likeness_by_brute_force():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcdefgh .é") for _ in range(n))
    base = make(3000)
    texts = ["", "a", base, base[:1500] + make(1500), make(40) + base, base[700:] + base[:700], make(3000), make(20), base * 30]
    rows = syncmers.sketches(texts)
    for t, r in zip(texts, rows):
        if t:
            assert list(zip(r[: syncmers.BINS].tolist(), r[syncmers.BINS :].tolist())) == _sketch(t)
    for i, a in enumerate(texts):
        got = syncmers.likeness(np.repeat(rows[i : i + 1], len(texts), axis=0), rows)
        assert got.tolist() == [_like(a, b) for b in texts]
    like = lambda i, j: syncmers.likeness(rows[i : i + 1], rows[j : j + 1])[0]
    assert like(2, 2) == 1 and like(2, 4) > 0.9 and like(2, 5) > 0.8 and 0.2 < like(2, 3) < 0.5 and like(2, 6) == 0
