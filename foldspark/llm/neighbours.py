"""Approximate nearest neighbours by few stable projections, kd-trees and a chi-square stopping test.

Vectors are put on a sphere, where the largest inner product is the smallest distance, and projected to a
few Gaussian dimensions: of a vector at distance d, the squared projected distance over d^2 is chi-square
distributed. Projected neighbours therefore come from a kd-tree in order of their distance and are verified on the
original vectors until the next one's distance lies beyond the quantile that any vector nearer than the worst
kept one exceeds with a small, set probability.

On Spark, the top of the tree is fitted to a bounded sample and deals all vectors to cells; large cells are cut into blocks,
each with a tree of its own. A query is searched in its own cell first; the scores found there say by the
same test which other cells it has to visit. Equal vectors are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import lean, n_parts, sampled, written

TOP, EVERY = 20, 20


@dataclass(frozen=True)
class Settings:
    dims: int = 8  # projected dimensions; even, for the closed form of the distribution
    sure: float = 0.97  # probability that a vector as near as the worst kept one is verified before the search ends
    cell: int = 8192  # vectors of a cell that the top of the tree aims at ...
    cells: int = 4096  # ... with at most so many cells
    sample: int = 65_536  # vectors, about, that the top of the tree is fitted to
    block: int = 16_384  # vectors of a block, about: what a task holds
    asked: int = 16_384  # queries, about, that one task answers on one block
    leaf: int = 64  # vectors in a leaf
    seed: int = 13


def chi_square(x: float, dims: int) -> float:
    """Distribution function of the chi-square distribution with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))


def chi_square_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square(hi, dims) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


def median_splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree of so many levels, each cut at the median of the widest dimension: (dimension, place) of its inner
    nodes in order of levels, the points' numbers leaf after leaf, and the leaves' offsets."""
    dim, place = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    parts = [np.arange(len(points))]
    for level in range(depth):
        halves = []
        for i, part in enumerate(parts):
            node = (1 << level) - 1 + i
            own = points[part]
            if len(part):
                dim[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            x = own[:, dim[node]]
            order = np.argsort(x, kind="stable")
            place[node] = x[order[(len(part) - 1) // 2]] if len(part) else 0.0
            left = x <= place[node]
            halves += [part[left], part[~left]]
        parts = halves
    return dim, place, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@dataclass(frozen=True)
class Space:
    """The projection, and the top of the tree: everything that tasks need to place a vector."""

    norm: float  # the largest norm of all vectors
    matrix: np.ndarray
    dim: np.ndarray
    place: np.ndarray

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Of vectors on the sphere: scaled by the largest norm, with one more coordinate that fills up their norm."""
        x = vectors / self.norm
        more = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, more]) @ self.matrix

    def project_query(self, vectors: np.ndarray) -> np.ndarray:
        """Of queries: their direction alone decides."""
        return (vectors / lengths(vectors)[:, None]) @ self.matrix[:-1]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        while len(node) and node[0] < len(self.dim):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] > self.place[node])
        return node - len(self.dim)


def lengths(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1)
    return np.minimum(top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1)), np.finfo(float).max)


def matrix_of(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


class Block:
    """A kd-tree over the projections of a block's vectors, the vectors, and the ids that have each."""

    def __init__(self, space: Space, vectors: np.ndarray, ids: list[np.ndarray], leaf: int):
        points = space.project(vectors)
        depth = max(0, math.ceil(math.log2(max(len(points), 1) / leaf)))
        _, _, order, offsets = median_splits(points, depth)
        offsets = np.unique(offsets)  # leaves that points on one plane left empty go
        self.offsets, self.points, self.vectors, self.ids = offsets, points[order], vectors[order], [ids[i] for i in order.tolist()]
        self.least = np.array([x[0] for x in self.ids])
        self.many = np.array([len(x) for x in self.ids])
        self.low, self.high = (f.reduceat(self.points, offsets[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.norm = space.norm

    def search(self, query: np.ndarray, point: np.ndarray, known: float, top: int, beyond: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(rows of this block, their scores, score of the ``top``-th id or -inf) for one query, best first.

        ``known`` is a score that ``top`` ids elsewhere reach, ``beyond`` the chi-square quantile of the test. Leaves open in order of
        their distance; what they hold waits until all nearer leaves are open, so that neighbours are verified in order of projected distance.
        """
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        far = np.append(far[order], np.inf)
        scale = float(lengths(query[None])[0]) * self.norm
        rows, score, worst = np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf
        wait, wait_far = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(order):
            radius = self._radius(max(worst, known), scale, beyond)
            if far[at] > radius:
                break
            leaves = order[at : at + step]
            at, step = at + len(leaves), 2 * step
            new = np.concatenate([np.arange(self.offsets[i], self.offsets[i + 1]) for i in leaves.tolist()])
            apart = self.points[new] - point
            wait, wait_far = np.append(wait, new), np.append(wait_far, (apart * apart).sum(axis=1))
            now = wait_far <= min(far[at], radius)
            new = wait[now]
            keep = ~now & (wait_far <= radius)
            wait, wait_far = wait[keep], wait_far[keep]
            told = self.vectors[new] @ query
            good = told >= max(worst, known)
            rows, score = np.append(rows, new[good]), np.append(score, told[good])
            best = np.lexsort((self.least[rows], -score))[:top]
            rows, score = rows[best], score[best]
            full = np.flatnonzero(np.cumsum(self.many[rows]) >= top)
            if len(full):
                worst = float(score[full[0]])
        return rows, score, worst

    @staticmethod
    def _radius(score: float, scale: float, beyond: float) -> float:
        """Squared projected distance at which the test holds, if ``score`` is the worst kept."""
        if not math.isfinite(score):
            return math.inf if score < 0 else 0.0
        return beyond * max(2 - 2 * min(max(score / scale, -1.0), 1.0), 0.0) + 1e-12

    def answer(self, query: np.ndarray, point: np.ndarray, known: float, top: int, beyond: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(ids, scores, score of the ``top``-th) of the best ids, with scores added up in one way for all vectors."""
        rows, _, worst = self.search(query, point, known, top, beyond)
        if not len(rows):
            return np.zeros(0, dtype=np.int64), np.zeros(0), worst
        exact = np.repeat((self.vectors[rows] * query).sum(axis=1), self.many[rows])
        ids = np.concatenate([self.ids[i] for i in rows.tolist()])
        best = np.lexsort((ids, -exact))[:top]
        return ids[best], exact[best], worst


def usable(vector: Column) -> Column:
    """True for a vector that takes part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, float]:
    """(vec_id, v, h1, h2 of the rows that take part; their length; their largest norm).

    Vectors can only be compared with those of their length: the length that most rows have counts, the larger of two.
    Vectors are told apart by two 64-bit hashes.
    """
    kind = rows.schema[vector_col].dataType.elementType.typeName()
    vector = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    norm = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))
    sizes = rows.groupBy(F.size("v").alias("length")).agg(
        F.count("*").alias("n"), F.max(F.least(norm, F.lit(1.7e308))).alias("norm"),
    ).orderBy(F.desc("n"), F.desc("length")).first()
    if sizes is None:
        return rows.select("vec_id", "v", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")), 0, 1.0
    return rows.where(F.size("v") == sizes["length"]).select(
        "vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"),
    ), int(sizes["length"]), float(sizes["norm"])


def classes(vectors: DataFrame, top: int) -> DataFrame:
    """h1, h2, v, ids: each distinct vector with its ``top`` smallest ids; more of them are in no answer.

    The window is limited before its exchange too: of a vector that many rows share, each task sends ``top`` rows at most.
    """
    first = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    return vectors.withColumn("place", first).where(F.col("place") <= top).groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _space(table: DataFrame, length: int, norm: float, n: int, s: Settings) -> Space:
    """The projection, and splits fitted to a sample of about ``s.sample`` vectors, the only ones that the driver sees."""
    matrix = np.random.default_rng(s.seed).standard_normal((length + 1, s.dims))
    flat = Space(norm, matrix, np.zeros(0, dtype=np.int64), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = flat.project(matrix_of(batch["v"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], names=["y"])

    some = table.where(sampled("h1", F.lit(min(1.0, s.sample / max(n, 1))))).select("v").mapInArrow(lean(run), "y array<double>")
    points = np.array([r["y"] for r in some.collect()]).reshape(-1, s.dims)
    depth = max(0, math.ceil(math.log2(max(1, min(s.cells, n / s.cell, len(points) / 16)))))
    dim, place, _, _ = median_splits(points, depth)
    return Space(norm, matrix, dim, place)


def _placed(table: DataFrame, space: Space, query: bool = False) -> DataFrame:
    """Adds ``cell``, and ``y``, the projection. Narrow."""
    shared = table.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            points = (own.project_query if query else own.project)(matrix_of(batch["v"]))
            y = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1]), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.cell(points).astype(np.int32)), y], names=[*batch.schema.names, "cell", "y"])

    return table.mapInArrow(lean(run), ", ".join(f"{n} {t}" for n, t in [*table.dtypes, ("cell", "int"), ("y", "array<double>")]))


FOUND = "h1 long, h2 long, worst double, hits array<struct<below: double, id: long>>"


def _answers(data: DataFrame, visits: DataFrame, space: Space, n_data: dict[int, int], top: int, s: Settings) -> DataFrame:
    """``FOUND`` rows: what each visit (h1, h2, v, known, cell) finds in each block of its cell.

    A cell of more than ``s.block`` vectors is cut into blocks by hash, and its queries, if they are many, are dealt
    to copies of its blocks. A task gets a block's vectors first and holds them, then its queries one batch after the other.
    """
    spark = data.sparkSession
    n_asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most s.cells rows
    plan = spark.createDataFrame([(c, -(-n // s.block), -(-n_asked[c] // s.asked)) for c, n in n_data.items() if c in n_asked], "cell int, blocks int, copies int")
    some = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    plan = F.broadcast(plan)  # a row for each cell, at most s.cells of them
    left = data.join(plan, "cell").select(
        "cell", F.pmod("h1", "blocks").cast("int").alias("block"), F.explode(some("copies")).alias("copy"), F.lit(False).alias("asks"), "h1", "h2",
        "v", "ids", F.lit(None).cast("double").alias("known"),
    )
    right = visits.join(plan, "cell").select(
        "cell", F.explode(some("blocks")).alias("block"), F.pmod(F.hash("h1", "h2"), "copies").cast("int").alias("copy"), F.lit(True).alias("asks"),
        "h1", "h2", "v", F.array().cast("array<long>").alias("ids"), "known",
    )
    keys = ["cell", "block", "copy"]
    both = left.unionByName(right).repartition(n_parts(data), *keys).sortWithinPartitions(*keys, "asks")
    shared = spark.sparkContext.broadcast(space)
    beyond = chi_square_quantile(s.sure, s.dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, block, key = shared.value, [], None, None
        for batch in batches:
            for now, asks, rows in _runs(batch, keys):
                if now != key:
                    key, held, block = now, [], None
                if not asks:
                    held.append(rows.select(["v", "ids"]))
                elif held or block:
                    if block is None:
                        ids = [x for b in held for x in np.split(b["ids"].flatten().to_numpy(), np.cumsum(pc.list_value_length(b["ids"]).to_numpy())[:-1])]
                        block, held = Block(own, np.concatenate([matrix_of(b["v"]) for b in held]), ids, s.leaf), []
                    yield _answered(block, own, rows, top, beyond)

    return both.mapInArrow(lean(run), FOUND)


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Runs of rows with equal keys and ``asks``."""
    cols = [batch[k].to_numpy(zero_copy_only=False) for k in [*keys, "asks"]]
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
        if b > a:
            yield tuple(int(c[a]) for c in cols[:-1]), bool(cols[-1][a]), batch.slice(a, b - a)


def _answered(block: Block, space: Space, rows: pa.RecordBatch, top: int, beyond: float) -> pa.RecordBatch:
    queries = matrix_of(rows["v"])
    points = space.project_query(queries)
    known = pc.fill_null(rows["known"], -math.inf).to_numpy(zero_copy_only=False)
    told = [block.answer(q, p, k, top, beyond) for q, p, k in zip(queries, points, known.tolist())]
    ends = np.cumsum([0, *(len(ids) for ids, _, _ in told)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays(
        [pa.array(-np.concatenate([x for _, x, _ in told]), pa.float64()), pa.array(np.concatenate([i for i, _, _ in told]), pa.int64())],
        names=["below", "id"],
    )
    worst = pa.array([w if math.isfinite(w) else None for _, _, w in told], pa.float64())
    return pa.RecordBatch.from_arrays([rows["h1"], rows["h2"], worst, pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["h1", "h2", "worst", "hits"])


def _further(home: DataFrame, space: Space, boxes: tuple[np.ndarray, np.ndarray, np.ndarray], s: Settings) -> DataFrame:
    """(h1, h2, v, known, cell) of the cells beside its own that a query has to visit, by the test on the cells' boxes."""
    shared = home.sparkSession.sparkContext.broadcast(boxes)
    beyond, norm = chi_square_quantile(s.sure, s.dims), space.norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, low, high = shared.value
        for batch in batches:
            points, own = matrix_of(batch["y"]), batch["cell"].to_numpy()
            known = pc.fill_null(batch["known"], -math.inf).to_numpy(zero_copy_only=False)
            scale = lengths(matrix_of(batch["v"])) * norm
            lists = []
            for i in range(batch.num_rows):
                gap = np.maximum(np.maximum(low - points[i], points[i] - high), 0)
                near = (gap * gap).sum(axis=1) <= Block._radius(float(known[i]), float(scale[i]), beyond)
                lists.append(cell[near & (cell != own[i])])
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([cell[:0], *lists]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("h1", "h2", "v", "known")] + [cells], names=["h1", "h2", "v", "known", "cells"])

    kinds = dict(home.dtypes)
    return home.mapInArrow(lean(run), f"h1 long, h2 long, v {kinds['v']}, known double, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, every: int = EVERY, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` largest inner products found for each row whose id is divisible by ``every``.

    Equal scores rank by the smaller id. Candidates are all other rows; a row with the query's id is its
    own. Rows with no id or whose vector is null, empty, zero, of another length than most, or holds null or non-finite
    components take no part. Repeated rows count once; an id with several vectors asks, and is found, with each of
    them. An empty table gives no rows.

    Approximate: a neighbour as near as the worst of the answer is missed with probability 1 - ``settings.sure`` at most. Exact copies
    are searched once and lose no id. Vectors whose directions tell little (no neighbour much nearer than the rest) are
    verified against most cells: the test then has no reason to end early.
    """
    s = settings
    vectors, length, norm = vectors_of(rows, id_col, vector_col)
    spark = rows.sparkSession
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = written(classes(vectors, top + 1), "vectors")
    space = _space(table, length, norm, table.count(), s)
    data = _placed(table, space)
    told = data.groupBy("cell").agg(
        F.count("*").alias("n"), *[f(F.col("y")[i]).alias(f"{name}{i}") for i in range(s.dims) for name, f in (("low", F.min), ("high", F.max))],
    ).collect()  # at most s.cells rows
    sizes = {r["cell"]: r["n"] for r in told}
    boxes = (np.array([r["cell"] for r in told]), *(np.array([[r[f"{side}{i}"] for i in range(s.dims)] for r in told]) for side in ("low", "high")))
    asked = vectors.where(F.col("vec_id") % every == 0)
    unique = written(asked.groupBy("h1", "h2").agg(F.any_value("v").alias("v")), "queries")
    queries = _placed(unique, space, query=True)
    data = data.select("cell", "h1", "h2", "v", "ids")
    home = queries.withColumn("known", F.lit(None).cast("double"))
    first = written(_answers(data, home, space, sizes, top + 1, s), "found")
    known = first.groupBy("h1", "h2").agg(F.max("worst").alias("known"))
    second = _answers(data, written(_further(queries.join(known, ["h1", "h2"], "left"), space, boxes, s), "visits"), space, sizes, top + 1, s)
    best = first.unionByName(second).groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, top + 1).alias("hits"))
    ids = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    own = F.slice(F.filter("hits", lambda x: x["id"] != F.col("query_id")), 1, top)
    return ids.join(best, ["h1", "h2"]).select("query_id", F.posexplode(own).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.below")).alias("score"),
    )
