"""Structural classes by interval overlap, pair scores, whole-protein similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.linked import pair_sums
from foldspark.functions.scalar import KNOWN_TYPES, fold_coverage, half_open_overlap, overlap_ratio
from foldspark.sources.tables import settled, tasks


#: Parts of classes that a task takes, about.
PARTS = 60_000


def assign_scop(domains: DataFrame, parts: DataFrame, share: float = 0.5) -> DataFrame:
    """domain, sccs (distinct codes, sorted, joined by ', '), size, confidence.

    ``domains`` (domain, pdb, chain, start, stop), ``parts`` (scop, pdb, chain, start, stop, chain_len,
    sccs); a part without a range, or with start 0, is its whole chain. A class counts if the half-open
    overlap is over ``share`` of its length (stop - start + 1, or the chain's), summed over its parts.
    Equi join on (pdb, chain); a domain without a class gives none. Overlaps are summed where a chain's rows meet: a class whose parts
    lie on one chain is decided there, and only counts by domain and code move on; of the others the sums do.
    """
    whole = F.col("p_start").isNull() | (F.col("p_start") == 0)
    p = parts.select("scop", "pdb", "chain", F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), "chain_len", "sccs")
    length = F.when(whole, F.col("chain_len")).otherwise(F.col("p_stop") - F.col("p_start") + 1)
    at = F.struct("pdb", "chain")
    sizes = p.groupBy("scop").agg((F.sum(length) * share).alias("least"), (F.min(at) != F.max(at)).alias("many"))
    common = F.when(whole, F.abs(F.col("stop") - F.col("start"))).otherwise(half_open_overlap("start", "stop", "p_start", "p_stop"))
    tasks = max(int(domains.sparkSession.conf.get("spark.sql.shuffle.partitions")), p.count() // PARTS + 1)
    met = domains.repartition(tasks, "pdb", "chain").join(p.join(sizes, "scop").repartition(tasks, "pdb", "chain"), ["pdb", "chain"]).withColumn("common", common).where("common <> 0 or least < 0")
    met = met.groupBy("pdb", "chain", "domain", "scop", "sccs", "least", "many").agg(F.sum("common").alias("common")).where("many or common > least")
    open_, kept = F.when(F.col("many"), F.col("scop")), [F.when(F.col("many"), F.col(c)).alias(c) for c in ("least", "common")]
    local = met.select("pdb", "chain", "domain", "sccs", open_.alias("scop"), *kept).groupBy("pdb", "chain", "domain", "sccs", "scop", "least").agg(F.sum("common").alias("common"), F.count("*").alias("n"))
    sums = local.select("domain", "sccs", "scop", "least", "common", "n").repartition("domain").groupBy("domain", "sccs", "scop", "least").agg(F.sum("common").alias("common"), F.sum("n").alias("n"))
    return sums.where("scop is null or common > least").groupBy("domain").agg(
        F.array_join(F.array_sort(F.collect_set("sccs")), ", ").alias("sccs"),
        F.greatest(F.sum(F.when(F.col("scop").isNull(), F.col("n")).otherwise(1)), F.lit(1)).alias("size"),
    ).withColumn("confidence", F.lit(1.0))


def scop_length(parts: DataFrame) -> DataFrame:
    """scop, length: whole chains and ranges summed."""
    whole = F.col("start").isNull() | (F.col("start") == 0)
    return parts.groupBy("scop").agg(F.sum(F.when(whole, F.col("chain_len")).otherwise(F.col("stop") - F.col("start") + 1)).alias("length"))


def domain_astral_overlap(domains: DataFrame, astrals: DataFrame, of: str = "domain", least: float = 0.0) -> DataFrame:
    """domain, astral, ratio: inclusive overlap of the same pdb and chain letter, as a share of ``of``."""
    a = astrals.select("astral", "pdb", F.substring("chain", 1, 1).alias("letter"), F.col("start").alias("a0"), F.col("stop").alias("a1"))
    d = domains.select("domain", "pdb", F.substring("chain", 1, 1).alias("letter"), F.col("start").alias("d0"), F.col("stop").alias("d1"))
    ratio = overlap_ratio("d0", "d1", "a0", "a1") if of == "domain" else overlap_ratio("a0", "a1", "d0", "d1")
    return d.join(a, ["pdb", "letter"]).select("domain", "astral", ratio.alias("ratio")).where((F.col("ratio") > 0) & (F.col("ratio") >= least)).distinct()


def domain_structures(domains: DataFrame, hits: DataFrame) -> DataFrame:
    """domain, pdb, chain: of a domain's structures (key) the greatest (pdb, chain)."""
    best = F.max(F.struct("pdb", "chain")).alias("b")
    return domains.join(hits, "key").groupBy("domain").agg(best).select("domain", "b.pdb", "b.chain")


def structures_of_experiments(
    experiments: DataFrame, proteins: DataFrame, domains: DataFrame, sequences: DataFrame, chains: DataFrame, regions: DataFrame, entries: DataFrame,
    kinds: tuple[str, ...] = KNOWN_TYPES,
) -> DataFrame:
    """domain, parent, kind, pdb, chain, start, stop, length: one structure a domain sequence and its parent.

    ``experiments`` (id), ``proteins`` (experiment, sequence), ``domains`` (id, sequence, parent, kind, parent_id: three
    letters and the sequence of a chain), ``sequences`` (id, sequence), ``chains`` (sequence, chain, pdb_key), ``regions``
    (domain_id, start, stop), ``entries`` (id, pdb). Of several the greatest (pdb, chain, kind, start, stop) is
    taken. Chains of one sequence are cut to the greatest before they meet domains, and experiments only
    select, so that no product of copies is formed. Rows without a partner in any table are left out.
    """
    best = chains.join(
        entries.select(F.col("id").alias("pdb_key"), "pdb"), "pdb_key",
    ).where("chain is not null").groupBy(F.col("sequence").alias("chain_seq")).agg(F.max(F.struct("pdb", "chain")).alias("best"))
    held = proteins.join(experiments, proteins["experiment"] == experiments["id"], "left_semi").select(F.col("sequence").alias("parent")).distinct()
    rows = domains.where(F.col("kind").isin(*kinds)).select(
        F.col("id").alias("domain_id"), F.col("sequence").alias("domain"), "parent", "kind",
        F.substring("parent_id", 4, 1 << 20).try_cast("long").alias("chain_seq"),
    )
    rows = rows.join(held, "parent", "left_semi").join(best, "chain_seq").join(regions.select("domain_id", "start", "stop"), "domain_id")
    one = rows.groupBy("domain", "parent").agg(F.max(F.struct("best.pdb", "best.chain", "kind", "start", "stop")).alias("b"))
    text = sequences.select(F.col("id").alias("domain"), F.length("sequence").alias("length"))
    return one.join(text, "domain").select("domain", "parent", "b.kind", "b.pdb", "b.chain", "b.start", "b.stop", "length")


def best_call_per_domain(calls: DataFrame) -> DataFrame:
    """The call of greatest size, then confidence, then least code."""
    w = Window.partitionBy("domain").orderBy(F.col("size").desc(), F.col("confidence").desc(), "sccs")
    return calls.withColumn("row__no", F.row_number().over(w)).where("row__no = 1").drop("row__no")


def mcm_calls(calls: DataFrame, folds: DataFrame, least: float = 0.75) -> DataFrame:
    """Calls whose foldable part covers more than ``least`` of it with the domain; kept where no fold is known.

    ``folds`` (key, parent, folded, start, stop); of several the least folded part counts.
    """
    f = folds.withColumn("cover__", fold_coverage("parent", "folded", "start", "stop")["fold_share"]).groupBy("key").agg(F.min_by("cover__", "folded").alias("cover__"))
    return calls.join(f, "key", "left").where(F.coalesce("cover__", F.lit(1.0)) > least).drop("cover__")


def canonical(pairs: DataFrame, score: str = "zscore") -> DataFrame:
    """a <= b and one score: that stored forward if there is one, the greatest of several."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    rows = pairs.select(a.alias("lo"), b.alias("hi"), F.struct((F.col("a") <= F.col("b")).alias("forward"), F.col(score).alias("s")).alias("x"))
    return rows.groupBy("lo", "hi").agg(F.max("x").alias("x")).select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("x.s").alias(score))


def lookup_pair_score(wanted: DataFrame, scores: DataFrame, default: float | None = None) -> DataFrame:
    """a, b, zscore of the wanted pairs, in either direction."""
    own = canonical(scores).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "zscore")
    found = wanted.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(own, ["lo", "hi"], "left")
    z: Column = F.col("zscore") if default is None else F.coalesce("zscore", F.lit(default))
    return found.select("a", "b", z.alias("zscore"))


def missing_pairs(wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """a, b without a score in either direction."""
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    return wanted.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(scores.select(lo, hi).distinct(), ["lo", "hi"], "left_anti").select("a", "b")


def protein_structure_set(known: DataFrame, decoys: DataFrame, most: int = 5) -> DataFrame:
    """protein, elem, structure: each known structure an element, a domain's best decoys one.

    ``known`` (protein, structure), ``decoys`` (protein, domain, structure, probability).
    """
    w = Window.partitionBy("protein", "domain").orderBy(F.col("probability").desc(), "structure")
    top = decoys.withColumn("row__no", F.row_number().over(w)).where(F.col("row__no") <= most)
    one = known.select("protein", F.concat(F.lit("k"), F.col("structure")).alias("elem"), "structure").distinct()
    return one.unionByName(top.select("protein", F.concat(F.lit("d"), F.col("domain")).alias("elem"), "structure"))


#: Links between proteins that a task takes at most, about; elements or holders from which a protein or a structure is split.
LINKS, BLOCK = 16_000_000, 1000
#: Scores of a structure that move as one row, at most.
SCORES = 256


def _stored_elements(elements: DataFrame, ranges: int) -> tuple[DataFrame, bool]:
    """(place, protein, structure, code, ways; whether any protein is split), settled: distinct elements with a structure.

    Proteins are dealt to places by ranges. code: n (n - 1) / 2 + e of the element's number e, from 0, among its protein's n distinct elements.
    Proteins of 32 bits and codes have the narrowest type that holds them. ways: in how many parts the partners of a protein of very many
    elements are dealt to tasks.
    """
    rows = elements.where("protein is not null").select("protein", "elem", "structure").repartitionByRange(ranges, "protein").distinct()
    own = Window.partitionBy("protein")
    rows = rows.withColumns({"e": F.dense_rank().over(own.orderBy("elem")).cast("long"), "rows": F.count("*").over(own)}).withColumn("n", F.max("e").over(own))
    code = (F.col("n") * (F.col("n") - 1) / 2).cast("long") + F.col("e") - 1
    ways = F.ceil(F.col("rows") / BLOCK).cast("int").alias("ways")
    rows = settled(rows.select(F.spark_partition_id().alias("place"), "protein", "structure", code.alias("code"), ways).where("structure is not null"))
    most = rows.agg(F.max("code"), F.max("ways"), F.min("protein"), F.max("protein")).first()
    whole = isinstance(most[2], int) and -(1 << 31) <= most[2] and most[3] < 1 << 31
    narrow = next(k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("long", 63)) if (most[0] or 0) < 1 << bits)
    return rows.withColumns({"code": F.col("code").cast(narrow)} | ({"protein": F.col("protein").cast("int")} if whole else {})), (most[1] or 1) > 1


def _links(holders: DataFrame, stored: DataFrame, scores: int) -> int:
    """About how many links there are, for the number of tasks: structures of four times the mean number of holders, or more, count with
    theirs, all others with the mean. No score moves for it where those are few."""
    c = F.col("c")
    mean = holders.agg(F.sum(c * c) / F.sum(c)).first()[0] or 0.0
    many = settled(holders.where(c > 4 * mean))
    if many.isEmpty():
        return int(scores * mean * mean)
    ca, cb = (many.select(F.col("structure").alias(k), F.col("c").alias(f"c_{k}")) for k in "ab")
    part = lambda k: F.coalesce(f"c_{k}", F.lit(mean))
    return int(stored.select("a", "b").join(ca, "a", "left").join(cb, "b", "left").agg(F.sum(part("a") * part("b"))).first()[0] or 0)


def _pair_sums(elements: DataFrame, scores: DataFrame, keep: int | None = None, similarity: Callable | None = None) -> tuple[DataFrame, bool]:
    """(p, q, total, n_p, n_q of pairs p < q; False), or (p, q, similarity, rank of the best ``keep`` q of a p; whether a p has several ranks 1).

    total: the best scores of both proteins' elements, 0 or more, summed. Pairs of proteins are dealt to tasks by ranges of p, whose number
    follows the links, which are estimated first. What moves is not a row a link, and not even one for each score and holder: of each
    structure the holders move as one array with the scores that it has, and of each score the holders of the other structure,
    once to each range that needs them. Links are formed there, a few proteins at a time, and never sorted or spilled. Structures with
    very many holders are split into blocks of them, and proteins of very many elements are dealt to several tasks by q.
    """
    spark, kind = elements.sparkSession, elements.schema["protein"].dataType
    stored = settled(scores.where("a is not null and b is not null").select("a", "b", F.coalesce(F.col("zscore").cast("double"), F.lit(0.0)).alias("zscore")))
    count = stored.count()
    holders = settled(elements.where("structure is not null").groupBy("structure").agg(F.count("*").alias("c")))
    n, by = tasks(spark, _links(holders, stored, count) * (2 if keep else 1), LINKS), tasks(spark, count)
    held, split = _stored_elements(elements, n)
    heavy = settled(holders.where(F.col("c") > BLOCK).select("structure", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    dealt = held.join(heavy, "structure", "left").withColumn("block", F.pmod(F.xxhash64("protein"), F.coalesce("blocks", F.lit(1))).cast("int"))
    holder = F.struct("place", "protein", "code", *(["ways"] if split else []))
    lists = dealt.repartition(by, "structure").groupBy("structure", "block").agg(F.collect_list(holder).alias("held"))
    x, y = (lists.select(F.col("structure").alias(k), F.col("held").alias(f"held_{k}"), *(["block"] if k == "a" else [])) for k in "ab")
    met, parts = stored.repartition(by, "b").join(y, "b"), [f.name for f in held.select(holder.alias("u")).schema["u"].dataType]
    # Arrays of numbers are smaller on their way than arrays of rows.
    met = met.select("a", "b", "zscore", *(F.col("held_b")[c].alias(c) for c in parts)).repartition(by, "a").withColumn("held_b", F.arrays_zip(*parts)).drop(*parts).join(x, "a")
    light = (lambda u: u["ways"] == 1) if split else (lambda u: F.lit(True))
    mine = lambda u: (u["place"] == F.col("place")) & light(u)
    after = lambda u: F.lit(True) if keep else u["place"] >= F.col("place")
    other = lambda u: ~mine(u) & after(u)
    places = F.array_distinct(F.concat(*(F.filter(s, light)["place"] if split else F.col(s)["place"] for s in ("held_a", "held_b"))))
    rows = met.sortWithinPartitions("a").withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), SCORES.bit_length() - 1)).withColumn("place", F.explode(places))
    rows = rows.withColumns({"own_a": F.exists("held_a", mine), "own_b": F.when(F.col("a") == F.col("b"), F.filter("held_b", lambda u: F.lit(False))).otherwise(F.filter("held_b", mine))})
    full = F.when(F.col("a") == F.col("b"), F.filter("held_b", after)).otherwise(F.concat("own_b", F.filter("held_b", other)))  # a structure with itself meets once
    rows = rows.select("a", "block", "chunk", "place", "zscore", "held_a", F.size("own_b").alias("mb"), F.when(F.col("own_a"), full).otherwise(F.col("own_b")).alias("held_b"))
    rows = rows.where("size(held_b) > 0").select("a", "block", "chunk", "place", "held_a", F.struct("zscore", F.col("mb").cast("smallint").alias("mb"), F.col("held_b.protein").alias("q"), F.col("held_b.code").alias("c")).alias("g"))
    rows = rows.groupBy("a", "block", "chunk", "place").agg(F.first("held_a").alias("held_a"), F.collect_list("g").alias("g"))
    rows = rows.withColumn("own_a", F.filter("held_a", mine)).withColumn("held_a", F.concat("own_a", F.filter("held_a", other))).where("size(held_a) > 0")
    rows = rows.select(
        "place", F.size("own_a").alias("ma"), F.col("held_a.protein").alias("aq"), F.col("held_a.code").alias("ac"), F.col("g.zscore").alias("zs"),
        F.transform("g.q", lambda v: F.size(v).cast("smallint")).alias("nb"), F.col("g.mb").alias("mb"), F.flatten("g.q").alias("bq"), F.flatten("g.c").alias("bc"),
    )
    if split:  # each protein of very many elements meets its partners by their parts
        sides = F.array(F.struct(F.col("held_a").alias("own"), F.col("held_b").alias("others")), F.struct(F.when(F.col("a") != F.col("b"), F.col("held_b")).alias("own"), F.col("held_a").alias("others")))
        big = met.select("zscore", F.inline(sides)).select("zscore", "others", F.explode(F.filter("own", lambda u: u["ways"] > 1)).alias("u"))
        big = big.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("u.ways") - 1))).withColumn("others", F.filter("others", lambda v: F.pmod(F.xxhash64(v["protein"]), F.col("u.ways")) == F.col("k"))).where("size(others) > 0")
        rows = rows.unionByName(big.select(
            F.pmod(F.xxhash64("u.protein", "k"), F.lit(n)).cast("int").alias("place"), F.lit(1).alias("ma"), F.array("u.protein").alias("aq"), F.array("u.code").alias("ac"), F.array("zscore").alias("zs"),
            F.array(F.size("others").cast("smallint")).alias("nb"), F.array(F.lit(0).cast("smallint")).alias("mb"), F.col("others.protein").alias("bq"), F.col("others.code").alias("bc"),
        ))
    p = held.schema["protein"].dataType.simpleString()
    shape = f"p {p}, q {p}, similarity double, rank int" if keep else f"p {p}, q {p}, total double, n_p long, n_q long"
    out = rows.repartitionById(n, "place").drop("place").mapInArrow(pair_sums(keep, similarity), shape)
    return out.withColumns({k: F.col(k).cast(kind) for k in "pq"}), split


def mean_of_both(total: Column, n_p: Column, n_q: Column) -> Column:
    """The mean over all elements of both proteins."""
    return total / (n_p + n_q)


def pairwise_max_avg(elements: DataFrame, scores: DataFrame, is_canonical: bool = False, similarity: Callable[[Column, Column, Column], Column] = mean_of_both) -> DataFrame:
    """p < q, similarity: the mean over both proteins' elements of the best score with the other, 0 or more.

    Starts from the stored scores: pairs of proteins without any are 0 and not returned. Each link is formed
    once, for both directions, where its pair is summed; a task's pairs come in order of (p, q). ``is_canonical``
    says that ``scores`` has one row a pair, as ``canonical`` gives it. ``similarity`` makes the number of the
    sum of best scores and the elements of both.
    """
    sums, _ = _pair_sums(elements, scores if is_canonical else canonical(scores))
    return sums.select("p", "q", similarity(F.col("total"), F.col("n_p"), F.col("n_q")).alias("similarity"))


def homolog_all_vs_all(
    elements: DataFrame, scores: DataFrame, keep: int = 100, is_canonical: bool = False,
    similarity: Callable[[Column, Column, Column], Column] = mean_of_both,
) -> DataFrame:
    """source, other, similarity, rank: the best ``keep`` proteins of each source.

    All links of a source are dealt to its task, so pairs don't move, and its others are ranked there. Only if there are sources of very many
    elements, which have several tasks, ``keep`` of each task at most move. ``similarity`` is given arrays of numbers, not columns.
    """
    best, split = _pair_sums(elements.where("structure is not null"), scores if is_canonical else canonical(scores), keep, similarity)
    best = best.withColumnsRenamed({"p": "source", "q": "other"})
    if not split:
        return best
    w = Window.partitionBy("source").orderBy(F.col("similarity").desc(), "other")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def ranked(rows: DataFrame, key: str, *ties: str) -> DataFrame:
    """The rows with idx, from 0, in order of a key of any ordered type and then the ties.

    Rows are dealt by ranges and sorted in them once; their number in a range and the sizes of the ranges
    before it give the index, so no window holds more than a row a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, key, *ties).sortWithinPartitions(key, *ties)
    placed = settled(placed.withColumn("id__", F.monotonically_increasing_id()))  # the range's number above 33 bits, the row's below
    part, row = F.shiftright("id__", 33), F.col("id__").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part__")).agg(F.count("*").alias("n__"))
    before = sizes.select("part__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base__"))
    return placed.withColumn("part__", part).join(F.broadcast(before), "part__").withColumn("idx", F.col("base__") + row).drop("part__", "base__", "id__")  # a row a range


def score_index(df: DataFrame, key: str = "structure") -> DataFrame:
    """key, idx: distinct keys, numbers or strings, in order, from 0."""
    return ranked(df.select(key).distinct(), key)


def similarity_matrix(elements: DataFrame, scores: DataFrame, is_canonical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matrix: row < column, similarity; keys: protein, idx): the upper triangle as sparse triples, all else is 0.

    ``elements`` (protein, elem, structure) as for ``pairwise_max_avg``; indexes are in order of the proteins.
    """
    keys = settled(score_index(elements, "protein"))
    numbered = settled(elements.join(keys, "protein").select(F.col("idx").alias("protein"), "elem", "structure"))
    return pairwise_max_avg(numbered, scores, is_canonical).select(F.col("p").alias("row"), F.col("q").alias("column"), "similarity"), keys


#: Keys of a matrix whose rows may be written out in full.
DENSE = 20_000


def dense_rows(matrix: DataFrame, keys: DataFrame) -> DataFrame:
    """idx, values: a full row of numbers for each index, for text output of small matrices: of ``DENSE`` keys at most,
    since a row has a number a key; more are an error."""
    n = keys.agg(F.count("*")).first()[0]
    if n > DENSE:
        raise ValueError(f"a full matrix of {n} keys; keep the sparse one")
    own = matrix.groupBy(F.col("row").alias("idx")).agg(F.map_from_entries(F.collect_list(F.struct("column", "similarity"))).alias("held"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return keys.select("idx").join(own, "idx", "left").select("idx", F.transform(every, lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0.0))).alias("values"))


def group_matrix(members: DataFrame, scores: DataFrame) -> DataFrame:
    """row, column, zscore of a group's structures (structure, idx), row < column."""
    s = canonical(scores)
    m1, m2 = (members.select(F.col("structure").alias(k), F.col("idx").alias(f"i{k}")) for k in ("a", "b"))
    out = s.where("a <> b").join(m1, "a").join(m2, "b")
    return out.select(F.least("ia", "ib").alias("row"), F.greatest("ia", "ib").alias("column"), "zscore")


def pair_blocks(keys: DataFrame) -> DataFrame:
    """block_a <= block_b over the last two digits of keys: at most 100 blocks."""
    b = keys.select(F.right(F.lpad(F.col("key").cast("string"), 2, "0"), F.lit(2)).alias("block")).distinct()
    return b.withColumnRenamed("block", "block_a").crossJoin(F.broadcast(b.withColumnRenamed("block", "block_b"))).where("block_a <= block_b")  # 100 rows


def best_path(candidates: Column, apart: float = 0.1, most_edges: int = 50) -> Column:
    """Of sorted structs (start, stop, key, ratio) the chain in order, of intervals that hardly overlap, with the
    greatest sum of ratio * length; empty if more than ``most_edges`` pairs of them could follow each other. Ratios count in
    billionths, so that sums are whole numbers, and equal ones are ties whatever the order of their parts.

    Dynamic programming in one fold: each interval's best chain ends a chain of one before it that is apart from it by
    overlap as a share of the earlier one. Ties go to the interval first in order.
    """
    length = lambda x: x["stop"] - x["start"] + 1
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("edges"), F.array().cast("array<struct<start: bigint, stop: bigint, total: bigint, path: array<int>>>").alias("held"))

    def step(state: Column, x: Column) -> Column:
        common = lambda y: F.greatest(F.lit(0), F.least(y["stop"], x["stop"]) - F.greatest(y["start"], x["start"]) + 1)
        before = F.filter(F.transform(state["held"], lambda y, i: F.struct(
            y["total"].alias("total"), (-i).alias("first"), y["path"].alias("path"), (common(y) / length(y) < apart).alias("apart"),
        )), lambda y: y["apart"])
        best = F.array_max(F.transform(before, lambda y: F.struct(y["total"], y["first"], y["path"])))
        total = F.coalesce(best["total"], F.lit(0).cast("long")) + F.round(x["ratio"] * 1e9).cast("long") * length(x)
        path = F.concat(F.coalesce(best["path"], none), F.array(F.size(state["held"]).cast("int")))
        own = F.struct(x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop"), total.alias("total"), path.alias("path"))
        grown = F.struct((state["edges"] + F.size(before)).alias("edges"), F.concat(state["held"], F.array(own)).alias("held"))
        return F.when(state["edges"] > most_edges, state).otherwise(grown)

    def picked(state: Column) -> Column:
        best = F.array_max(F.transform(state["held"], lambda y, i: F.struct(y["total"].alias("total"), (-i).alias("first"), y["path"].alias("path"))))
        return F.when(state["edges"] > most_edges, none).otherwise(best["path"])

    return F.transform(F.aggregate(candidates, start, step, picked), lambda i: F.get(candidates, i))


def representative_path(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """domain, key, start, stop, ratio: a domain's representative structures.

    Candidates with overlap ``least`` or more, unique by key and by (start, stop), in order of (start, stop, key): those of
    ``best_path``. A domain's candidates, a few each, meet in one row.
    """
    c = candidates.where(F.col("ratio") >= least).groupBy("domain", "start", "stop").agg(F.min("key").alias("key"), F.max("ratio").alias("ratio"))
    c = c.groupBy("domain", "key").agg(F.min(F.struct("start", "stop", "ratio")).alias("x")).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("x.start", "x.stop", "key", "x.ratio"))).alias("all"))
    return c.select("domain", F.inline(best_path(F.col("all")))).select("domain", "key", "start", "stop", "ratio")
