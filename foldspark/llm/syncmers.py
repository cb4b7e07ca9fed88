"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its s-mers is that of its first
or last s-mer. Whether a k-mer is chosen depends on nothing but itself, so shared passages give the
same anchors wherever they stand. A document's fingerprint is a one-permutation min-hash of its
anchors: ``BINS`` bins of eight bits of hash, empty bins filled from the next full bin, and then the bins'
positions in the text. Two fingerprints are alike in the bins that match by position: same hash, and an
offset between the two texts that other bins confirm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import filled, lean, n_parts, ragged, slices, written

K, S, BINS = 16, 6, 128
MIX1, MIX2, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x100000001B3)
#: Hex digits of a fingerprint: a byte of hash and one of position (modulo 256) a bin.
EMPTY = "00" * (2 * BINS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * MIX1
    h ^= h >> np.uint64(32)
    h *= MIX2
    h ^= h >> np.uint64(29)
    return h


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` codes."""
    h = codes[: len(codes) - n + 1].copy()
    for j in range(1, n):
        h *= BASE
        h += codes[j : len(codes) - n + 1 + j]
    return _mix(h)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every run of ``w`` values."""
    span, out = 1, h
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - span : w - span + len(h) - w + 1]) if span < w else out


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of all closed syncmers; a text without one is one anchor, unless it is empty."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = ragged(lens)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    who, pos, val = [], [], []
    whole = lens > 0
    if len(codes) >= k:
        inner = _rolling(codes, s)
        w = k - s + 1
        least = _least(inner, w)
        n = len(codes) - k + 1
        at = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : w - 1 + n] == least))
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + k <= offsets[text + 1]
        at, text = at[inside], text[inside]
        h = codes[at].copy()
        for j in range(1, k):
            h *= BASE
            h += codes[at + j]
        who.append(text)
        pos.append(at - offsets[text])
        val.append(_mix(h))
        whole[text] = False
    short = np.flatnonzero(whole)  # shorter than k, or so short that no k-mer need be chosen
    who.append(short)
    pos.append(np.zeros(len(short), dtype=np.int64))
    val.append(np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for i in short], dtype=np.uint64))
    return np.concatenate(who), np.concatenate(pos), np.concatenate(val)


def sketches(texts: list[str]) -> np.ndarray:
    """Rows of ``BINS`` bytes of hash and ``BINS`` of position; an empty text's are zero."""
    who, pos, h = anchors(texts)
    none = np.iinfo(np.uint64).max
    least = np.full(len(texts) * BINS, none, dtype=np.uint64)
    # The least hash of a bin, and of equal ones the first place modulo 256, are the least number.
    word = ((h & np.uint64((1 << 57) - 1)) >> np.uint64(8)) << np.uint64(8) | (pos.astype(np.uint64) & np.uint64(0xFF))
    np.minimum.at(least, who * BINS + (h >> np.uint64(57)).astype(np.int64), word)
    least = least.reshape(len(texts), BINS)
    full = least != none
    at = np.where(full, np.arange(BINS), 10 * BINS)
    nearest = np.minimum.accumulate(np.concatenate([at, at + BINS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    rows = np.arange(len(texts))[:, None]
    some = full.any(axis=1)
    source = np.where(some[:, None], nearest % BINS, 0)
    taken = least[rows, source]
    value = _mix((taken >> np.uint64(8)) + (nearest - np.arange(BINS)).astype(np.uint64)) >> np.uint64(56)
    out = np.zeros((len(texts), 2 * BINS), dtype=np.uint8)
    out[:, :BINS] = np.where(some[:, None], value, 0)
    out[:, BINS:] = np.where(some[:, None], taken & np.uint64(0xFF), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bins that match by position, 0 to 1: the hashes agree, and at least two bins agree about the
    offset from one text to the other. Agreement by chance has no such company. Two empty texts are alike."""
    same = a[:, :BINS] == b[:, :BINS]
    blank = ~np.stack([a.any(axis=1), b.any(axis=1)])
    places = [x[:, BINS:].astype(np.int32) for x in (a, b)]
    offset = np.where(same, (places[0] - places[1]) % 256, 256 + np.arange(BINS, dtype=np.int32))
    offset.sort(axis=1)
    near = offset[:, 1:] == offset[:, :-1]
    confirmed = np.zeros(offset.shape, dtype=bool)
    confirmed[:, 1:] |= near
    confirmed[:, :-1] |= near
    return np.where(blank.all(axis=0), 1.0, np.where(blank.any(axis=0), 0.0, confirmed.mean(axis=1)))


def syncmer_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos array<int>, hash array<long>: each document's anchors in order of position.

    Null and empty texts have empty arrays; a text without a syncmer is one anchor at 0. Narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                who, pos, h = anchors(filled(part["text"]).to_pylist())
                order = np.lexsort((pos, who))
                offsets = pa.array(ragged(np.bincount(who, minlength=part.num_rows)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.ListArray.from_arrays(offsets, pa.array(pos[order].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(h[order].view(np.int64)))],
                    names=["doc_id", "pos", "hash"],
                )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), "doc_id long, pos array<int>, hash array<long>")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (hex): equal texts have equal fingerprints; null is the empty text,
    whose fingerprint is all zero. Narrow: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = filled(part["text"]).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([r.tobytes().hex() for r in sketches(texts)], pa.string())],
                    names=["doc_id", "n_chars", "fingerprint"],
                )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), "doc_id long, n_chars long, fingerprint string")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
OPEN = f"{COLUMNS}, part int, side string, text string"


def _compared(ids: list, texts: list[str], after: list[str]) -> dict[str, list]:
    """Result columns of documents and the documents after them."""
    edited = []
    for t, a in zip(texts, after):
        h = len(t) // 2
        edited.append(t[: len(t) - h] + a[:h])
    every = sketches(texts + edited + after[-1:])
    n = len(texts)
    own, new = every[:n], every[n : 2 * n]
    follow = np.concatenate([own[1:], every[2 * n :]]) if all(x is y for x, y in zip(after, texts[1:])) else sketches(after)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": [r.tobytes() for r in own], "edited_fingerprint": [r.tobytes() for r in new], "near_edited": likeness(own, new).tolist(), "near_next": likeness(own, follow).tolist(),
    }


def edit_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how near they come.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next
    document in descending id order (after the last: the first). Texts are shuffled once, by id range;
    each range compares neighbours as they stream by and leaves its first and last document open, two
    rows a range, which a second small step joins. Null texts are empty; rows with one id are in falling order
    of a hash of their texts, which ranges are cut by too; a null id comes last; an only document is its own next; an empty table gives none.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("side", pa.string()), ("text", pa.string())])
        blank = {f.name: [None] for f in schema}
        for batch in batches:
            for some in slices(batch):
                ids, texts = some["doc_id"].to_pylist(), filled(some["text"]).to_pylist()
                if held is None:
                    yield pa.RecordBatch.from_pydict(blank | {"part": [part], "side": ["head"], "text": texts[:1]}, schema)
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_pydict(_compared(ids[:-1], texts[:-1], texts[1:]) | {x: [None] * n for x in ("part", "side", "text")}, schema)
        if held is not None:
            yield pa.RecordBatch.from_pydict(blank | {"doc_id": [held[0]], "part": [part], "side": ["tail"], "text": [held[1]]}, schema)

    down = [F.col(c).desc() for c in ("doc_id", "hash", "text")]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts or n_parts(docs), *down[:2]).sortWithinPartitions(*down)
    first = written(dealt.drop("hash").mapInArrow(lean(run), OPEN), "syncmers")
    # The ranges that hold rows, each with the one after it: numbers only, one a range.
    full = sorted(r["part"] for r in first.where("side = 'head'").select("part").collect())
    follow = spark.createDataFrame(list(zip(full, full[1:] + full[:1])), "part int, next int")
    heads = first.where("side = 'head'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    open_rows = first.where("side = 'tail'").join(F.broadcast(follow), "part").join(heads, "next").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = _compared(*(batch[c].slice(i, 1).to_pylist() for c in ("doc_id", "text", "after")))
                yield pa.RecordBatch.from_pydict(
                    one,
                    pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
                )

    done = first.where("side is null").drop("part", "side", "text")
    every = done.unionByName(open_rows.mapInArrow(lean(close), COLUMNS))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
