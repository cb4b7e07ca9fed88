"""SimHash near-duplicates by true resemblance: groups of texts that share four fifths of their runs of words.

Sets of runs of five words get SimHash fingerprints of four lanes of 64 bits. Fingerprints are dealt to tiles by the size
of their sets; tiles whose sizes rule a link out never meet, and within the others all fingerprints are
compared with exclusive-or and bit counts, lane after lane. What is within the radius is a candidate; each compared
pair of tiles gives a spanning forest of its candidates, and their components are clusters. Links are
then verified inside clusters, on whole sets: small clusters at once; in large ones all members are first
held against a few hubs, and what then is in different components is compared in blocks.

Two sets of likeness 0.8 differ in a bit with probability 0.1614 at most (0.1875 for four runs of five), so that
the radius misses one of them in about 3e-7 of all cases (1e-4 for those of four and five runs).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from foldspark.llm._common import filled, lean, ragged, slices, written
from foldspark.llm.simhash import components

#: Words of a run; lanes of 64 bits; bits in which candidates may differ, in the first lane and in all.
WORDS, LANES = 5, 4
RADIUS1, RADIUS = 29, 72
#: Verified links have likeness of 4/5 or more: 9 * shared >= 4 * (size + size).
LINKED = "9 * shared >= 4 * (n + m)"
#: Sizes of sets in one tile differ by this factor at most: linked sets are in one tile or in neighbours.
STEP = 1.2501
#: Fingerprints in a piece of a tile, and runs of words in a block of a cluster, about.
PIECE, BLOCK = 4096, 1 << 17
#: Ids up to which a list of documents is broadcast; longer ones are joined by shuffle.
FEW = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
#: The bits of a byte, each in a byte of its own.
_SPREAD = np.packbits(
    np.repeat(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None], 8, axis=2) & np.array([1, 0, 0, 0, 0, 0, 0, 0], dtype=np.uint8),
    bitorder="little",
).view("<u8")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def run_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sorted distinct hashes) of the runs of ``words`` words of each text, A-Z lower-cased.

    A text of fewer words is one run; a blank text has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    codes = lists.flatten().dictionary_encode()
    names = codes.dictionary.to_pylist()
    known = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in names] or [0], dtype=np.uint64)
    some = np.array([bool(w) for w in names] or [False])
    use = codes.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    keep = some[use]
    use, doc = use[keep], doc[keep]
    word, n = known[use], np.bincount(doc, minlength=len(texts))
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(n, out=first[1:])
    size = np.minimum(n, words)[doc]  # words in a run of this text
    at = np.flatnonzero(np.arange(len(word)) + size <= first[doc + 1])
    short = (size[at] < words) & (at != first[doc[at]])
    at = at[~short]
    h = size[at].astype(np.uint64)
    for j in range(words):
        inside = j < size[at]
        h = np.where(inside, _mixed(h ^ word[np.minimum(at + j, len(word) - 1)]), h)
    of = doc[at]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return ragged(np.bincount(of[new], minlength=len(texts))), h[new]


def _keys(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number for each set; 0 for the empty one."""
    sums = np.zeros((2, len(h) + 1), dtype=np.uint64)
    np.cumsum(_mixed(h), out=sums[0, 1:])
    np.cumsum(_mixed(h ^ _MIX), out=sums[1, 1:])
    a, b = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
    return np.where(np.diff(offsets) > 0, _mixed(_mixed(a) ^ b), np.uint64(0)).view(np.int64)


def bit_sums(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each run of hashes set each of 64 bits; empty runs give 0."""
    n = np.diff(offsets)
    parts = -(-n // 255)  # a byte counts up to 255
    out = np.zeros((len(n), 64), dtype=np.int64)
    if not len(h):
        return out
    own = np.repeat(np.arange(len(n)), parts)
    within = np.arange(len(own)) - np.repeat(ragged(parts)[:-1], parts)
    starts = offsets[:-1][own] + 255 * within
    sums = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], starts, axis=0).view(np.uint8).reshape(len(own), 64)
    some = np.flatnonzero(n)
    out[some] = np.add.reduceat(sums, ragged(parts)[:-1][some], axis=0, dtype=np.int64)
    return out


def lanes_of(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows of ``LANES`` longs: a bit is 1 if over half of the set's mixed hashes set it."""
    n = np.diff(offsets)
    out = np.zeros((len(n), LANES), dtype="<i8")
    for lane in range(LANES):
        ones = bit_sums(_mixed(h ^ _LANE[lane]), offsets)
        out[:, lane] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()
    return out


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the set of runs; 0: none), n (its size), f0 to f3 (lanes of the fingerprint). Narrow."""
    names = ["doc_id", "key", "n", *(f"f{i}" for i in range(LANES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                offsets, h = run_sets(filled(part["text"]))
                lanes = lanes_of(offsets, h)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(_keys(offsets, h)), pa.array(np.diff(offsets)), *(pa.array(lanes[:, i].copy()) for i in range(LANES))],
                    names=names,
                )

    return _read(docs, id_col, text_col).mapInArrow(lean(run), ", ".join(f"{x} long" for x in names))


def among(rows: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose id is (``left_semi``) or isn't (``left_anti``) among ``ids`` (one column), null-safe.

    Up to ``FEW`` ids are broadcast, so that the rows stay in place; more are joined by shuffle.
    """
    named = ids.toDF("among__id")
    if named.limit(FEW + 1).count() <= FEW:
        named = F.broadcast(named)
    return rows.join(named, rows[id_col].eqNullSafe(named["among__id"]), how)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, runs array<long> of the documents that ``wanted`` (doc_id) names, each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                offsets, h = run_sets(filled(part["text"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_keys(offsets, h)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["key", "runs"],
                )

    rows = among(_read(docs, id_col, text_col), "doc_id", wanted, "left_semi")
    return rows.mapInArrow(lean(run), "key long, runs array<long>").dropDuplicates(["key"])


class Forest:
    """Components of numbered nodes as links come in."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (up := self.label[self.label])).any():
                self.label = up

    def links(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node that isn't its component's least, and that one, by name."""
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return names[at], names[self.label[at]]


def candidates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``a``, rows of ``b``) within the radius and of sizes that allow a link, block by block."""
    for x in range(0, len(a), 256):
        for y in range(0, len(b), 2048):
            few, many = a[x : x + 256], b[y : y + 2048]
            near = np.bitwise_count(few[:, None, 0] ^ many[None, :, 0]) <= RADIUS1
            i, j = np.nonzero(near)
            d = np.zeros(len(i), dtype=np.int16)
            for lane in range(LANES):
                d += np.bitwise_count(few[i, lane] ^ many[j, lane])
            i, j = x + i, y + j
            ok = (d <= RADIUS) & (5 * np.minimum(n[i], m[j]) >= 4 * np.maximum(n[i], m[j]))
            yield i[ok], j[ok]


def candidate_links(reps: DataFrame) -> DataFrame:
    """u, v: links between keys whose components are those of all candidates. ``reps``: key, n > 0, f0 to f3."""
    tile = reps.withColumn("tile", F.floor(F.log("n") / log(STEP)).cast("int"))
    sizes = tile.groupBy("tile").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # one row a tile, under 200
    dealt = tile.join(F.broadcast(sizes), "tile").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    table = written(dealt.groupBy("tile", "piece").agg(F.collect_list(F.struct("key", "n", *(f"f{i}" for i in range(LANES)))).alias("prints")), "tiles")
    here = table.select(F.col("tile").alias("atile"), F.col("piece").alias("apiece")).withColumn("tile", F.explode(F.array(F.col("atile"), F.col("atile") + 1)))
    pairs = here.join(table.select("tile", "piece"), "tile").where("atile < tile or apiece <= piece")
    left = table.select(F.col("tile").alias("atile"), F.col("piece").alias("apiece"), F.col("prints").alias("a"))
    met = pairs.join(left, ["atile", "apiece"]).join(table.withColumnRenamed("prints", "b"), ["tile", "piece"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch[c].slice(row, 1).flatten() for c in ("a", "b")]
                keys = [s.field("key").to_numpy(zero_copy_only=False) for s in sides]
                sizes_ = [s.field("n").to_numpy(zero_copy_only=False) for s in sides]
                prints = [np.stack([s.field(f"f{i}").to_numpy(zero_copy_only=False) for i in range(LANES)], axis=1).view(np.uint64) for s in sides]
                names, number = np.unique(np.concatenate(keys), return_inverse=True)
                forest, k = Forest(len(names)), len(keys[0])
                for i, j in candidates(*prints, *sizes_):
                    forest.join(number[i], number[k + j])
                u, v = forest.links(names)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return met.mapInArrow(lean(run), "u long, v long").distinct()


def verified(keys: list[np.ndarray], sets: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links whose components are those of all pairs of the two sides whose sets are alike.

    Shared runs are counted for all pairs at once, some thousand runs at a time.
    """
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in sets]
    shared = np.zeros((len(sets[0]), len(sets[1])), dtype=np.float32)
    flat = [np.concatenate(side) for side in sets]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    common = np.intersect1d(flat[0], flat[1])
    at = [np.searchsorted(common, f) for f in flat]
    held = [(x < len(common)) & (common[np.minimum(x, len(common) - 1)] == f) if len(common) else np.zeros(len(f), dtype=bool) for x, f in zip(at, flat)]
    at, owner = [x[h] for x, h in zip(at, held)], [o[h] for o, h in zip(owner, held)]
    order = [np.argsort(x, kind="stable") for x in at]
    at, owner = [x[o] for x, o in zip(at, order)], [w[o] for w, o in zip(owner, order)]
    step = 2048
    for begin in range(0, len(common), step):
        dense = []
        for side in (0, 1):
            lo, hi = np.searchsorted(at[side], [begin, begin + step])
            d = np.zeros((len(sizes[side]), min(step, len(common) - begin)), dtype=np.float32)
            d[owner[side][lo:hi], at[side][lo:hi] - begin] = 1
            dense.append(d)
        shared += dense[0] @ dense[1].T
    i, j = np.nonzero(9 * shared >= 4 * (sizes[0][:, None] + sizes[1][None, :]))
    names, number = np.unique(np.concatenate(keys), return_inverse=True)
    forest = Forest(len(names))
    forest.join(number[i], number[len(keys[0]) + j])
    return forest.links(names)


def _stars(large: DataFrame) -> DataFrame:
    """u, v: verified links of large clusters' members to three hubs: any member, the one most like it, and
    of those that the second leaves out again the one most like it. Linear in the members."""
    found, told = large, None
    for pick in (
        F.max(F.struct("key", "n", "runs")), F.max(F.when(F.col("like") < 1, F.struct("like", "key", "n", "runs"))),
        F.max(F.when(~F.col("linked"), F.struct("like", "key", "n", "runs"))),
    ):
        hubs = found.groupBy("cluster").agg(pick.alias("hub")).where("hub is not null")
        near = large.join(hubs.selectExpr("cluster", "hub.key v", "hub.n m", "hub.runs theirs"), "cluster").withColumn("shared", F.size(F.array_intersect("runs", "theirs")))
        near = near.withColumn("like", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).withColumn("linked", F.expr(LINKED))
        found = written(near.select("cluster", "key", "n", "runs", "v", "like", "linked"), "stars")
        links = found.where("linked and key <> v").selectExpr("key u", "v")
        told = links if told is None else told.unionByName(links)
    return told


def _blocks(members: DataFrame) -> DataFrame:
    """u, v: verified links from comparing blocks of clusters' members. ``members``: cluster, c (component so
    far), key, n, runs. Members of one large component aren't compared with each other again."""
    mass = members.groupBy("cluster", "c").agg(F.sum("n").alias("runs_of_c"))
    kind = members.join(mass, ["cluster", "c"]).withColumn("own", F.when(F.col("runs_of_c") >= BLOCK, F.col("c")))
    size = kind.groupBy("cluster", "own").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("cluster", "s_cluster").withColumnRenamed("own", "s_own")
    dealt = kind.join(size, (F.col("cluster") == F.col("s_cluster")) & F.col("own").eqNullSafe(F.col("s_own")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    table = written(dealt.groupBy("cluster", "own", "block").agg(F.collect_list(F.struct("key", "runs")).alias("sets")).withColumn("id", F.expr("uuid()")), "blocks")
    ids = table.select("cluster", "own", "block", "id")
    other = ids.selectExpr("cluster", "own b_own", "block b_block", "id b_id")
    mixed = ids.where("own is null").join(other, "cluster").where("b_own is not null or block <= b_block").select("id", "b_id")
    owns = ids.where("own is not null").select("cluster", "own").distinct()
    apart = owns.join(owns.selectExpr("cluster", "own b_own"), "cluster").where("own < b_own")
    apart = apart.join(ids, ["cluster", "own"]).join(other, ["cluster", "b_own"]).select("id", "b_id")
    pairs = mixed.unionByName(apart)
    met = pairs.join(table.selectExpr("id", "sets a"), "id").join(table.selectExpr("id b_id", "sets b"), "b_id").select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, sets = [], []
                for c in ("a", "b"):
                    side = batch[c].slice(row, 1).flatten()
                    keys.append(side.field("key").to_numpy(zero_copy_only=False))
                    runs = side.field("runs")
                    flat, ends = runs.flatten().to_numpy(zero_copy_only=False), np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))
                    sets.append(np.split(flat, ends[:-1]))
                u, v = verified(keys, sets)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return met.mapInArrow(lean(run), "u long, v long").distinct()


def verified_links(clusters: DataFrame) -> DataFrame:
    """u, v: links between keys whose components are those of all alike sets. ``clusters``: cluster, key, n, runs."""
    mass = clusters.groupBy("cluster").agg(F.sum("n").alias("mass"))
    sized = clusters.join(mass, "cluster")
    large = written(sized.where(F.col("mass") > BLOCK).drop("mass"), "large")
    small = sized.where(F.col("mass") <= BLOCK).select("cluster", F.col("cluster").alias("c"), "key", "n", "runs")
    if large.isEmpty():
        return _blocks(small)
    stars = written(_stars(large), "links")
    found = components(stars).withColumnRenamed("node", "key")
    labelled = large.join(found, "key", "left").select("cluster", F.coalesce("component", "key").alias("c"), "key", "n", "runs")
    return stars.unionByName(_blocks(labelled.unionByName(small)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, component_id of every row: the least doc_id reachable by links of likeness 0.8.

    Equal sets always link; null, empty and blank texts are one group; a text of fewer than five words is
    one run. Repeated rows share a component. A null id never names a component unless all its ids are
    null. An empty table gives none.
    """
    told = written(signatures(docs, id_col, text_col), "signatures")
    lanes = [F.first(f"f{i}").alias(f"f{i}") for i in range(LANES)]
    reps = written(told.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *lanes), "sets")
    met = components(candidate_links(reps.where("n > 0"))).withColumnRenamed("node", "key").withColumnRenamed("component", "cluster")
    members = written(met.join(reps.select("key", "rep", "n"), "key"), "members")
    sets = _sets(docs, members.select("rep").distinct(), id_col, text_col)
    clusters = written(members.select("cluster", "key", "n").join(sets, "key"), "clusters")
    found = components(verified_links(clusters)).withColumnRenamed("node", "key")
    # Only keys with links need another name than their own.
    linked = written(found.join(reps.select("key", "rep"), "key"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    moved = linked.join(least, "component").select("key", "least", F.lit(True).alias("moved"))
    named = reps.select("key", "rep").join(moved, "key", "left").select("key", F.when(F.col("moved"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    return told.select("doc_id", "key").join(named, "key").select("doc_id", "key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, of the least id of each component.

    Of rows that share the kept id of their component and its text, that of the least hash over all its columns stays. Documents stay in
    place: only the ids that go, and ids that stand in several rows, are looked up.
    """
    found = written(near_copies(docs, id_col, text_col), "near")
    several = written(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "several")
    gone = written(found.where("not (doc_id <=> component_id)").select("doc_id").unionByName(several).distinct(), "gone")
    kept = among(docs, id_col, gone, "left_anti")
    if several.isEmpty():
        return kept
    # Ids that stand in several rows: each row by its own text.
    packed = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = among(packed, "doc_id", several, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part["doc"], part["doc_id"], pa.array(_keys(*run_sets(filled(part["text"]))))], names=["doc", "doc_id", "key"])

    keyed = packed.mapInArrow(lean(run), f"doc {packed.schema['doc'].dataType.simpleString()}, doc_id long, key long")
    own = found.where("doc_id <=> component_id").selectExpr("doc_id own_id", "key own_key").distinct()
    stay = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")))
    one = stay.groupBy("doc_id", "key").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return kept.unionByName(one.select("doc.*"))
