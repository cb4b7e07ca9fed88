"""Toxicity scores by a factorization machine over hashed terms.

Terms are a document's distinct words and word beginnings, hashed. The machine has a weight and a short
vector for each term; the score adds the weights and the products of all pairs of vectors, so that two
terms together (an insult and whom it is aimed at) count for more than either. It is fitted on a
bounded, class-wise sample of labelled rows and applied to every document in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import filled, lean, ragged, sampled, segment_sum, slices
from foldspark.llm.langid import words_of

BUCKETS, FACTORS = 1 << 18, 4
#: Labelled documents of each class that the machine is fitted on, at most about (a bounded sample).
ROWS_PER_CLASS = 6000
#: Letters of the word beginnings that are terms beside the whole words.
STEM = 5
STEPS, RATE, L1, L2 = 100_000, 0.15, 1.0, 1e-4
#: Deviation of vectors' first values, their rate, and the size under which a trained one is set to 0.
START, VECTOR_RATE, SMALL = 0.05, 0.05, 0.1
#: Rows that must hold a term, deviations of its share of label 1 from which it tells by itself, and share of
#: the rows from which it is frequent.
MIN_ROWS, MIN_Z, FREQUENT = 3, 4.0, 0.002
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def term_ids(words: list[str]) -> np.ndarray:
    """Two buckets for each word: of the whole word and of its beginning (the word again if it is short)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    offsets = ragged(np.array([len(w) for w in words], dtype=np.int64))
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    # A letter and its place give a number; a word's is their sum, so that all letters count.
    h = (codes + np.uint64(1)) * _MIX + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    out = np.empty((len(words), 2), dtype=np.int64)
    for col, own in ((0, h), (1, np.where(place < STEM, h, 0).astype(np.uint64))):
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(own, out=total[1:])
        x = (total[offsets[1:]] - total[offsets[:-1]] + np.uint64(col)) * _MIX
        out[:, col] = ((x ^ x >> np.uint64(31)) % np.uint64(BUCKETS)).astype(np.int64)
    return out


def terms(texts: pa.Array, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each text end to end, and offsets; ``live``: of these buckets only."""
    lists = words_of(texts)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    codes = flat.dictionary_encode()
    ids = term_ids(codes.dictionary.to_pylist())
    use = codes.indices.to_numpy(zero_copy_only=False)
    if live is not None and len(ids):
        kept = live[ids].any(axis=1)[use]
        doc, use = doc[kept], use[kept]
    # Distinct (document, word) first: most words repeat.
    key = np.unique(doc * np.int64(max(1, len(ids))) + use) if len(ids) else np.zeros(0, dtype=np.int64)
    doc, word = key // max(1, len(ids)), key % max(1, len(ids))
    blank = codes.dictionary.index("").as_py()
    if blank >= 0:
        doc, word = doc[word != blank], word[word != blank]
    key = np.unique(np.concatenate([doc * BUCKETS + ids[word, 0], doc * BUCKETS + ids[word, 1]])) if len(word) else np.zeros(0, dtype=np.int64)
    key = key if live is None else key[live[key % BUCKETS]]
    return key % BUCKETS, ragged(np.bincount(key // BUCKETS, minlength=len(texts)))


class Machine:
    """Bias, weights and vectors; ``margin`` is the log-odds of rows of terms."""

    def __init__(self, bias: float, weight: np.ndarray, vector: np.ndarray):
        self.bias, self.weight, self.vector = bias, weight, vector

    def margin(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = self.bias + segment_sum(self.weight[ids].astype(np.float64), offsets)
        live = self.vector.any(axis=1)[ids]
        kept = ragged(segment_sum(live.astype(np.int64), offsets))
        v = self.vector[ids[live]].astype(np.float64)
        total, square = segment_sum(v, kept), segment_sum(v * v, kept)
        return out + 0.5 * (total * total - square).sum(axis=1)


def telling(ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Buckets whose share of label 1 is ``MIN_Z`` deviations off the mean's, rows counted by their weights."""
    weights = weights / weights.min() if len(weights) else weights
    each = np.repeat(weights, np.diff(offsets))
    rows = np.bincount(ids, weights=each, minlength=BUCKETS)
    toxic = np.bincount(ids, weights=each * np.repeat(labels, np.diff(offsets)), minlength=BUCKETS)
    share = float(np.clip((labels * weights).sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4))
    return np.abs(toxic - rows * share) >= MIN_Z * np.sqrt(np.maximum(rows, 1) * share * (1 - share))


def _loss(machine: Machine, ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    margin = np.clip(machine.margin(ids, offsets), -30, 30)
    return float((weights * (np.logaddexp(0, margin) - labels * margin)).sum())


def _rows(ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(offsets)[rows]
    off = ragged(lens)
    return ids[np.repeat(offsets[rows] - off[:-1], lens) + np.arange(off[-1])], off


def train(ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Machine:
    """The machine over terms that tell by themselves, or over all frequent terms: whichever explains a fifth of the
    rows better when it is fitted to the others. Then it is fitted to all rows.

    Terms that say nothing alone count only in pairs; where no such pair tells, their many vectors would
    only learn the rows by heart. Ties, and rows of one class, take the first.
    """
    n, rng = len(labels), np.random.default_rng(seed)
    rows_of = np.bincount(ids, minlength=BUCKETS)
    told = telling(ids, offsets, labels, weights) & (rows_of >= MIN_ROWS)
    every = told | (rows_of >= max(MIN_ROWS, FREQUENT * n))
    held = rng.random(n) < 0.2
    parts = [np.flatnonzero(~held), np.flatnonzero(held)]
    if any(len(set(labels[r].tolist())) < 2 for r in parts):
        return descend(ids, offsets, labels, weights, told, seed)
    (fi, fo), (hi, ho) = (_rows(ids, offsets, r) for r in parts)
    known = telling(fi, fo, labels[parts[0]], weights[parts[0]]) & (np.bincount(fi, minlength=BUCKETS) >= MIN_ROWS)
    losses = [_loss(descend(fi, fo, labels[parts[0]], weights[parts[0]], terms_, seed), hi, ho, labels[parts[1]], weights[parts[1]]) for terms_ in (known, known | every)]
    return descend(ids, offsets, labels, weights, told if losses[0] <= losses[1] else every, seed)


def descend(ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray, allowed: np.ndarray, seed: int = 7) -> Machine:
    """Fits weights and vectors of the allowed terms by mini-batches with adaptive rates. An L1 pull holds the weights
    of terms that tell nothing by themselves at 0; their vectors are free. Vectors that stay small are set to 0."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    kept = allowed[ids]
    ids, offsets = ids[kept], ragged(segment_sum(kept.astype(np.int64), offsets))
    # Terms are numbered anew, so that what is trained is as large as they are many.
    names = np.flatnonzero(allowed)
    ids, k = np.searchsorted(names, ids), len(names)
    z, g2, w = np.zeros(k), np.zeros(k), np.zeros(k)
    v, v2 = rng.normal(0, START, (k, FACTORS)), np.full((k, FACTORS), 1e-2)
    share = float(np.clip((labels * weights).sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4))
    bias, b2 = float(np.log(share / (1 - share))), 1.0
    for _ in range(int(np.clip(-(-STEPS // max(1, n)), 5, 40)) if k else 0):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            idx, off = _rows(ids, offsets, rows)
            lens = np.diff(off)
            lv = v[idx]
            total = segment_sum(lv, off)
            margin = bias + segment_sum(w[idx], off) + 0.5 * (total * total - segment_sum(lv * lv, off)).sum(axis=1)
            g = weights[rows] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows])
            bias -= RATE * g.sum() / np.sqrt(b2)
            b2 += float((g * g).sum())
            touched, inv = np.unique(idx, return_inverse=True)
            gw = np.bincount(inv, weights=np.repeat(g, lens), minlength=len(touched))
            new = g2[touched] + gw * gw
            z[touched] += gw - (np.sqrt(new) - np.sqrt(g2[touched])) / RATE * w[touched]
            g2[touched] = new
            zt = z[touched]
            w[touched] = np.where(np.abs(zt) <= L1, 0.0, -(zt - np.sign(zt) * L1) / ((1 + np.sqrt(new)) / RATE + L2))
            grad = np.repeat(g, lens)[:, None] * (np.repeat(total, lens, axis=0) - lv)
            gv = np.stack([np.bincount(inv, weights=grad[:, f], minlength=len(touched)) for f in range(FACTORS)], axis=1) + L2 * v[touched]
            v2[touched] += gv * gv
            v[touched] -= VECTOR_RATE * gv / np.sqrt(v2[touched])
    v[np.abs(v).max(axis=1, initial=0) < SMALL] = 0
    weight, vector = np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, FACTORS), dtype=np.float32)
    weight[names], vector[names] = w, v
    return Machine(bias, weight, vector)


def fit(
    docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
) -> Machine:
    """Fits on labelled rows where ``keep`` (of ``doc_id``) holds, about ``rows_per_class`` of each class,
    chosen by a hash of their ids and weighted back to the classes' shares. Null ids and labels other than 0 and
    1 are left out; null texts have no terms. Without labelled rows the
    machine scores every text alike. Of an id's several labels the greatest counts.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(keep)
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rates = {k: min(1.0, rows_per_class / n) for k, n in sizes.items()}
    if not sizes:
        return Machine(-5.0, np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, FACTORS), dtype=np.float32))
    rate = F.create_map(*[x for k, r in sorted(rates.items()) for x in (F.lit(k), F.lit(r))])
    chosen = known.where(sampled("doc_id", rate[F.col("label")]))
    # At most two times rows_per_class ids: a proven bound for the broadcast. Of an id's several texts one is taken.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, offsets = terms(filled(part["text"]))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["label"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    names=["doc_id", "label", "ids"],
                )

    table = rows.select("doc_id", "label", "text").mapInArrow(lean(run), "doc_id long, label int, ids array<int>").toArrow().sort_by("doc_id")
    lists = table["ids"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    label = table["label"].to_numpy().astype(np.float64)
    weight = np.where(label > 0, 1 / rates.get(1, 1.0), 1 / rates.get(0, 1.0))
    return train(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ragged(lists.value_lengths().to_numpy(zero_copy_only=False)), label, weight / weight.mean())


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted (1 if score >= threshold) of every row.

    Null and empty texts score as a text without terms. Rows repeat as they occur. Narrow.
    """

    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS weights and vectors: 5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        live = (machine.weight != 0) | machine.vector.any(axis=1)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = terms(filled(part["text"]), live)
                p = 1 / (1 + np.exp(-np.clip(machine.margin(ids, offsets), -50, 50)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), "doc_id long, score double, predicted int")
