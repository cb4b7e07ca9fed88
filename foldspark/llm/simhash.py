"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their four 16-bit blocks. Two
fingerprints within ``radius`` bits have block counts that differ by at most ``radius`` in sum, so tile
pairs beyond it are never formed; the others are compared whole with numpy exclusive-or and bit
counts. Tiles are cut into pieces of bounded size. A compared pair of tiles gives a spanning forest of
its links, never all pairs, and the components of all forests are found by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import filled, lean, ragged, slices, written

BITS, RADIUS, WORDS = 64, 3, 3
BLOCKS, SIDE = 4, 17
#: Fingerprints in a piece of a tile, about.
PIECE = 1024
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint_words(raw: bytes, words: int = WORDS) -> list[int]:
    """XXH64 (seed 42) of each run of ``words`` words of a text whose A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    w = raw.translate(LOWER).split()
    if not w:
        return []
    if len(w) < words:
        return [xxh64_intdigest(b" ".join(w), 42)]
    return [xxh64_intdigest(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(words)))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64-bit SimHash as a signed long): bit b is 1 if over half the shingle hashes set it.

    Words are runs of anything but ASCII white space; shingles repeat as they occur; a text of fewer
    words is one shingle; null, empty and blank texts have fingerprint 0. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                rows = [fingerprint_words(r, words) for r in filled(part["text"]).cast(pa.binary()).to_pylist()]
                n = np.array([len(r) for r in rows], dtype=np.int64)
                h = np.array([x for r in rows for x in r], dtype="<u8")
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                offsets = ragged(n)
                ones = np.zeros((len(n), BITS), dtype=np.int64)
                some = n > 0
                if some.any():
                    ones[some] = np.add.reduceat(bits, offsets[:-1][some], axis=0, dtype=np.int32)
                fp = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of ``a`` and ``b`` that are connected within ``radius`` bits across the two."""
    hit = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= radius  # of signed numbers it counts the absolute value
    rows = np.flatnonzero(hit.any(axis=1))
    if not len(rows):
        return []
    cols = np.flatnonzero(hit.any(axis=0))
    hit = hit[np.ix_(rows, cols)]
    none = len(rows)
    left = np.arange(none)
    while True:
        right = np.where(hit, left[:, None], none).min(axis=0)
        new = np.minimum(left, np.where(hit, right[None, :], none).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == left).all():
            break
        left = new
    x, y = a[rows], b[cols]
    links = {(int(p), int(q)) for p, q in zip(x, x[left]) if p != q}
    return list(links | {(int(p), int(q)) for p, q in zip(y, x[right]) if p != q})


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Offsets of block counts that differ by at most ``radius`` in sum, one of each mirrored two."""
    every = [d for d in product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, d)) <= radius]
    return [d for d in every if d >= (0,) * BLOCKS]


def tiles(fps: DataFrame, piece: int = PIECE) -> DataFrame:
    """p0..p3 (block counts), piece, fps array<long>: distinct fingerprints in pieces of about ``piece``.

    The counts of tiles, at most 17^4 rows, are broadcast; hot tiles are cut by a hash.
    """
    block = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)).cast("int").alias(f"p{i}") for i in range(BLOCKS)]
    keyed = fps.select("fp", *block)
    keys = [f"p{i}" for i in range(BLOCKS)]
    sizes = keyed.groupBy(*keys).agg(F.ceil(F.count("*") / piece).cast("long").alias("pieces"))
    cut = keyed.join(F.broadcast(sizes), keys).withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    return cut.groupBy(*keys, "piece").agg(F.collect_list("fp").alias("fps"))


def links(fps: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """u, v (longs): links between distinct fingerprints whose components are those of all pairs
    within ``radius`` bits. ``fps`` has the distinct ``fp``; few, none or one give none."""
    table = written(tiles(fps, piece), "tiles")
    keys = [f"p{i}" for i in range(BLOCKS)]
    near = F.array(*[F.array(*map(F.lit, d)) for d in _neighbours(radius)])
    here = table.select(*[F.col(k).alias(f"a{k}") for k in keys], F.col("piece").alias("apiece"))
    probe = here.withColumn("d", F.explode(near)).select("*", *[(F.col(f"a{k}") + F.col("d")[i]).alias(k) for i, k in enumerate(keys)]).drop("d")
    probe = probe.where(" and ".join(f"{k} between 0 and {SIDE - 1}" for k in keys))
    same = " and ".join(f"a{k} = {k}" for k in keys)
    # First which pieces meet, then their fingerprints, so that only tiles with a partner move.
    pairs = probe.join(table.select(*keys, "piece"), keys).where(f"not ({same}) or apiece <= piece")
    left = table.select(*[F.col(k).alias(f"a{k}") for k in keys], F.col("piece").alias("apiece"), F.col("fps").alias("a"))
    met = pairs.join(left, [*[f"a{k}" for k in keys], "apiece"]).join(table.withColumnRenamed("fps", "b"), [*keys, "piece"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            sides = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch["a"], batch["b"])]
            for i in range(batch.num_rows):
                a, b = (np.asarray(v[o[i] : o[i + 1]]) for v, o in sides)
                found += forest(a, b, radius)
            uv = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

    return met.mapInArrow(lean(run), "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) of an undirected graph, by large-star and small-star joins.

    Each round is written to the shared folder. Only nodes with an edge are returned.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.where("u <> v").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id reachable by links of at most ``radius`` bits.

    Equal fingerprints always link. Blank texts share fingerprint 0 and link like any other. Repeated
    rows share a component; a null id never names a component unless all its ids are null. An empty
    table gives none.
    """
    fp = written(fingerprints(docs, id_col, text_col, words), "simhash")
    reps = written(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash")
    found = components(links(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    classed = reps.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = classed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = classed.join(least, "component").select("fp", "component_id")
    return fp.join(by_fp, "fp").select("doc_id", "fp", "component_id")
