"""Ranked lexical search by NRA (no random access) over impact-sorted postings.

One pass over the documents writes their counts of query terms and their lengths; corpus totals follow
from that table. Its rows are then shards of a document-partitioned index: a task inverts a bounded shard
into posting lists in falling order of impact and answers every query by sequential reads alone. Each
document read has a lower bound of its score (what was seen) and an upper bound (what its unseen lists may
still hold); reading ends when no other document can enter the best ones or tie with them, and theirs
are exact. The best of all shards are merged by one window that Spark limits before the exchange.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import filled, lean, ragged, slices, written

TOP = 20
#: Characters of query texts in a block, about: bounds the terms that tasks and the driver hold.
BLOCK = 2_000_000
#: Postings of a shard, about.
SHARD = 2_000_000
#: Postings that each list gives in the first round of reads; every further round gives twice as many.
FIRST_READ = 64
#: Small letters for A-Z; blanks for all ASCII characters but letters and digits.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

Query = tuple[int | None, str, list[tuple[int, int]]]


def term_list(text: str | None) -> list[str]:
    """The terms of a text: runs of ASCII letters, digits and characters beyond ASCII, with A-Z as small letters."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).decode("utf-8", "surrogatepass")
    return [w for w in raw.split(" ") if w]


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts end to end, the number of the text of each)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(_PLAIN)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw))
    lists = pc.split_pattern(plain, " ")
    words = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    return words.filter(pa.array(full)), doc[full]


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> Iterator[tuple[list[str], list[Query]]]:
    """(terms, queries as (id, text, [(term's number, repeats)])) of bounded blocks of the distinct queries."""
    items = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, int(-(-size // block)))
    for b in range(blocks):
        told: list[Query] = []
        code: dict[str, int] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect():
            many = Counter(term_list(r["text"]))
            told.append((r["item_id"], r["text"], [(code.setdefault(w, len(code)), n) for w, n in many.items()]))
        yield list(code), told


def term_counts(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_terms, and arrays ``terms`` and ``tf`` with the query terms that a row's text holds. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_string())
        width = max(len(known), 1)
        for batch in batches:
            for part in slices(batch):
                words, doc = plain_words(filled(part["text"]))
                coded = words.dictionary_encode()
                term = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
                n = np.bincount(doc, minlength=part.num_rows)
                at = term >= 0
                held, tf = np.unique(doc[at] * width + term[at], return_counts=True)
                offsets = pa.array(ragged(np.bincount(held // width, minlength=part.num_rows)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (held % width, tf)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n_terms", "terms", "tf"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(lean(run), "doc_id long, n_terms long, terms array<int>, tf array<int>")


def weights(n_docs: int, df: dict[int, int], n_terms: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term's number."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(n_terms)], dtype=np.int64)


class Shard:
    """Posting lists of a bounded run of documents, each in falling order of impact."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int):
        # Documents are numbered in order of their ids (no id last), so that ties go to the smaller number.
        self.ids = ids
        m = 75 + (25 * lengths * n_docs) // max(n_words, 1)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order].astype(np.int32), impact[order]
        self.lists = ragged(np.bincount(term, minlength=len(weight)))

    def search(self, terms: list[tuple[int, int]], top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents' numbers, scores) of the best ``top`` documents with scores of at least ``floor`` and above 0."""
        return nra(
            [(self.doc[self.lists[t] : self.lists[t + 1]], self.impact[self.lists[t] : self.lists[t + 1]] * n) for t, n in terms if self.lists[t + 1] > self.lists[t]],
            len(self.ids), top, max(floor, 1),
        )


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` documents by (score, smaller number) from (documents, falling impacts) lists, by sequential reads.

    ``lower`` is what was seen of each document, ``open_`` the lists in which it wasn't seen yet. A list bounds what it may still
    hold by its next impact. Documents whose upper bound is under ``floor``, or under the ``top``-th lower bound, can't be among
    the best; equal bounds stay until ties are resolved. Lists in which every document still in
    question was seen are read no further. The end: no other document is in question, and all bounds of the best meet.
    """
    lower = np.zeros(size, dtype=np.int64)
    open_ = np.ones((len(lists), size), dtype=bool)
    at, step = [0] * len(lists), FIRST_READ
    live = np.arange(size)  # documents in question, those that no list has shown yet among them
    while True:
        bound = np.array([x[1][a] if a < len(x[0]) else 0 for a, x in zip(at, lists)], dtype=np.int64)
        upper = lower[live] + bound @ open_[:, live]
        cut = floor
        if len(live) > top:
            cut = max(floor, int(np.partition(lower[live], len(live) - top)[len(live) - top]))
        keep = upper >= cut
        live, upper = live[keep], upper[keep]
        exact = upper == lower[live]
        if exact.all():
            break
        wanted = (bound > 0) & open_[:, live[~exact]].any(axis=1)
        for k in np.flatnonzero(wanted).tolist():
            doc, impact = lists[k]
            to = min(at[k] + step, len(doc))
            new = doc[at[k] : to]
            lower[new] += impact[at[k] : to]
            open_[k, new] = False
            at[k] = to
        step *= 2
    score = lower[live]
    best = np.lexsort((live, -score))[:top]
    return live[best], score[best]


SCHEMA = "query int, doc_id long, score long"


def search(
    docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    top: int = TOP, block: int = BLOCK, shard: int = SHARD,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest scores above 0 of every query.

    Equal scores rank by ascending doc_id, a null id last. Null and blank texts have no terms: such
    documents are never found and such queries give no rows. Repeated documents are each ranked; queries that share id and text count
    once, and texts that share an id are each ranked by themselves. An empty table on either side gives none. Documents are read once for
    each block of about ``block`` characters of queries (a stated query set in blocks), whatever their number.
    """
    return reduce(DataFrame.unionByName, [_search(docs, terms, told, id_col, text_col, top, shard) for terms, told in query_blocks(queries, item_col, item_text, block)])


def _search(docs: DataFrame, terms: list[str], told: list[Query], id_col: str, text_col: str, top: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    counts = written(term_counts(docs, terms, id_col, text_col), "terms")
    totals = counts.agg(F.count(F.when(F.col("n_terms") > 0, 1)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_words")).first()
    df = {r["t"]: r["n"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    n_docs, n_words = int(totals["n_docs"]), int(totals["n_words"])
    shared = spark.sparkContext.broadcast((weights(n_docs, df, len(terms)), [q[2] for q in told]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = shared.value
        best = [(np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64)) for _ in asked]
        for held in _shards(batches, shard):
            _answer(Shard(*held, weight, n_docs, n_words), asked, best, top)
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for _, x in best])
        ids = [i for x, _ in best for i in x]
        score = np.concatenate([np.zeros(0, dtype=np.int64), *[x for _, x in best]])
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, pa.int64()), pa.array(score)], names=["query", "doc_id", "score"])

    found = counts.mapInArrow(lean(run), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, q[0]) for i, q in enumerate(told)], "query int, item_id long")
    return found.withColumn("rank", rank).where(F.col("rank") <= top).join(names, "query").select("item_id", "rank", "doc_id", "score")


def _answer(shard: Shard, asked: list[list[tuple[int, int]]], best: list, top: int) -> None:
    """Puts the shard's best documents of each query among those of the task's earlier shards."""
    for q, terms in enumerate(asked):
        ids, score = best[q]
        doc, new = shard.search(terms, top, int(score[-1]) if len(score) == top else 1)
        if len(doc):
            ids, score = np.append(ids, shard.ids[doc]), np.append(score, new)
            order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i] is None, ids[i] or 0))[:top]
            best[q] = ids[order], score[order]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """(ids, lengths, term, doc, tf) of runs of documents with about ``limit`` postings, documents in order of ids."""
    held, n = [], 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch["terms"]), 0))
        if batch.num_rows:
            held.append(batch)
            n += len(batch["terms"].flatten())
        if n >= limit:
            yield _shard(held)
            held, n = [], 0
    if held:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()  # nulls come last
    terms = table["terms"].combine_chunks()
    doc = np.repeat(np.arange(len(table)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    tf = table["tf"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.array(table["doc_id"].to_pylist(), dtype=object)
    return ids, table["n_terms"].to_numpy(), terms.flatten().to_numpy(zero_copy_only=False), doc, tf


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
item AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (
  SELECT q, word, count(*) AS qtf FROM (SELECT q, unnest(words) AS word FROM item) GROUP BY q, word),
total AS (
  SELECT count(*) FILTER (len(words) > 0) AS n, coalesce(sum(len(words)), 0)::BIGINT AS l FROM doc),
posting AS (
  SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM doc) WHERE word IN (SELECT word FROM asked) GROUP BY r, word),
weight AS (
  SELECT word, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total GROUP BY word, n),
scored AS (
  SELECT q, r, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(words) * n) // l))))::BIGINT AS score
  FROM asked JOIN posting USING (word) JOIN weight USING (word) JOIN doc USING (r), total GROUP BY q, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scored JOIN item USING (q) WHERE score > 0 QUALIFY rank <= 20
"""
