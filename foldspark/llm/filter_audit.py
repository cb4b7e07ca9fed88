"""Audit of how document filters interact, by a Gray-code walk over all subsets of them.

Each document has a mask of the filters that it fails. What order of filters removes what follows from
the counts of each part's mask cells alone, so documents are counted once into cells (32 for five filters)
and never again. The walk visits all subsets of filters, one toggled at a time, with a counter of active
failures for every cell and running survivors; the survivors of each subset are stored, and every step of every
order of the filters is a difference of two stored states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import lean, written

#: The filters of the query in order of their letters; the last one is the repeated text.
NAMES = "ABCDE"
#: What is counted in each cell: documents, good ones, toxic ones.
COUNTED = ("n", "good", "toxic")
#: Parts whose cells are walked together.
PARTS = 256


@dataclass(frozen=True)
class Limits:
    words: int = 200  # A: fewer words fail
    distinct: int = 50  # B: a smaller percentage of distinct words fails
    capitals: int = 2  # C: a larger percentage of A-Z fails
    signs: str = "#$%&*|"  # D: any of these fails


def text_failures(text: Column, limits: Limits = Limits()) -> Column:
    """Bits 0 to 3 for the filters A to D that a text (null: '') fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    signs = "[" + "".join(rf"\x{ord(c):02X}" for c in limits.signs) + "]"
    failed = (n < limits.words, 100 * distinct < limits.distinct * n, 100 * capitals > limits.capitals * F.length(text), text.rlike(signs))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """part, mask (bits of the failed filters A to E), good, toxic of every row of ``docs``.

    E fails if a smaller id has the same text, told by two 64-bit hashes of it. A null id counts as the
    greatest; rows with the same least id all pass. A document is good or toxic if any label row of its id says so; a null id has no labels. Texts are
    read once; what is exchanged are digests of fixed size, by keys that hold the id, so that neither
    a text nor a null id that many rows share makes a large group.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"), text_failures(text, limits).alias("failed"),
    )
    digest = written(digest, "digest")
    first = digest.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")).select(
        "h1", "h2", F.coalesce("first", F.lit(0)).alias("first_id"), F.col("first").isNull().alias("no_id"),
    )
    rows = digest.withColumns({"first_id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})
    rows = rows.join(first.withColumn("passes", F.lit(True)), ["h1", "h2", "first_id", "no_id"], "left")
    told = labels.select(
        F.col("doc_id").cast("long").alias("first_id"), F.lit(False).alias("no_id"), F.lit(0).alias("spread"), (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"),
    ).where("first_id is not null and (good or toxic)")
    told = told.groupBy("first_id", "no_id", "spread").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.withColumn("spread", F.when(F.col("no_id"), F.pmod("h1", F.lit(1024)).cast("int")).otherwise(0))
    mask = F.col("failed") + F.when(F.col("passes"), 0).otherwise(1 << 4)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return rows.join(told, ["first_id", "no_id", "spread"], "left").select("part", mask.alias("mask"), flag("good"), flag("toxic"))


def cells(rows: DataFrame, n_filters: int = len(NAMES)) -> DataFrame:
    """part, and for each of ``COUNTED`` an array with a count for every mask: two levels of small sums."""
    small = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    by_mask = small.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTED)))).alias("by_mask"))
    masks = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    return by_mask.select("part", *[F.transform(masks, _count_of(c)).alias(c) for c in COUNTED])


def _count_of(name: str) -> Callable[[Column], Column]:
    return lambda mask: F.coalesce(F.element_at("by_mask", mask).getField(name), F.lit(0))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: ``counts`` and the result have an axis of masks, or subsets, first.

    The walk goes from the empty subset through all others in Gray order. A cell whose counter of active
    failures leaves zero leaves the running survivors; one whose counter comes back to zero returns to them.
    """
    size = len(counts)
    masks = np.arange(size)
    failing = np.zeros(size, dtype=np.int64)
    survivors = counts.sum(axis=0)
    states = np.empty_like(counts)
    states[0] = survivors
    active = 0
    for i in range(1, size):
        bit = i & -i  # the filter that step i of the Gray code toggles
        active ^= bit
        cell = (masks & bit) > 0
        if active & bit:
            survivors = survivors - counts[cell & (failing == 0)].sum(axis=0)
            failing[cell] += 1
        else:
            failing[cell] -= 1
            survivors = survivors + counts[cell & (failing == 0)].sum(axis=0)
        states[active] = survivors
    return states


def order_steps(counts: np.ndarray, names: str = NAMES) -> dict[str, np.ndarray]:
    """Columns of all orders and steps for counts (masks, parts, ``COUNTED``): arrays (parts, orders, steps)."""
    states = gray_walk(counts)
    orders = np.array(list(permutations(range(len(names)))))
    bits = 1 << orders
    after = np.cumsum(bits, axis=1)
    before = after - bits
    lost = (states[before] - states[after]).transpose(2, 0, 1, 3)
    masks = np.arange(len(counts))
    fails = np.stack([counts[(masks >> f) & 1 == 1, :, 0].sum(axis=0) for f in range(len(names))], axis=1)
    only = counts[1 << np.arange(len(names)), :, 0].T
    removed = lost[..., 0]
    shapley = np.stack([np.where(orders == f, removed, 0).sum(axis=(1, 2)) for f in range(len(names))], axis=1)
    kept = states[after][..., 0].transpose(2, 0, 1)
    return {"kept": kept, "removed": removed, "redundant": fails[:, orders] - removed, "unique_fails": only[:, orders], "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": shapley[:, orders]}


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(table: DataFrame, names: str = NAMES) -> DataFrame:
    """``SCHEMA`` rows of every part of a table of ``cells``: all orders of the filters, all steps."""
    orders = ["".join(o) for o in permutations(names)]
    steps = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part = batch.slice(at, PARTS)
                n, width = part.num_rows, len(orders) * steps
                counts = np.stack([part[c].flatten().to_numpy(zero_copy_only=False).reshape(n, 1 << steps).T for c in COUNTED], axis=2)
                told = order_steps(counts, names)
                index = pa.array(np.repeat(np.arange(n), width))
                order = pa.array(orders).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), steps), n)))
                step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n * len(orders)))
                yield pa.RecordBatch.from_arrays(
                    [part["part"].take(index), order, step, *[pa.array(x.ravel()) for x in told.values()]],
                    names=["part", "filter_order", "step", *told],
                )

    return table.mapInArrow(lean(run), SCHEMA)


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row for each part, order of the five filters, and step; zeros included.

    Null and empty texts fail A (no word is under 200 words) and are one text for E. A null part is ''.
    Repeated rows each count; rows of one text with equal ids don't fail E for each other. An empty table gives no rows;
    columns beside those named are left out. ``shapley`` sums what the row's filter removes in its part over all orders.
    """
    return interactions(cells(failures(docs, labels, **options)))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (
  SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
told AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * list_unique(words) < 50 * len(words))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first, first IS NOT NULL)::INT AS mask
  FROM texts JOIN firsts USING (t) LEFT JOIN told USING (doc_id)),
cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
filters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a JOIN filters b ON b.bit <> a.bit JOIN filters c ON c.bit NOT IN (a.bit, b.bit) JOIN filters d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN filters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier FROM orders, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
