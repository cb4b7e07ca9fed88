"""Sequence hits: filters, best hits, links, sequence identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.sources.tables import settled, tasks

#: Pairs of families that a task takes, about, while they repeat; families of a protein from which it is split into blocks.
PAIRS, BLOCK = 3_000_000, 1000


def filter_hsps(df: DataFrame, evalue: float, length: float, identities: int) -> DataFrame:
    """Strict form: evalue <, align_len > length * hit_len, identities >."""
    return df.where((F.col("evalue") < evalue) & (F.col("align_len") > F.col("hit_len") * length) & (F.col("identities") > identities))


def filter_hsps_detailed(df: DataFrame, evalue: float, length: float, identity: float) -> DataFrame:
    """Inclusive form: longer aligned string over the longer sequence, identities over the query."""
    aligned = F.greatest("query_aligned", "hit_aligned") / F.greatest("query_len", "hit_len")
    return df.where((F.col("evalue") <= evalue) & (aligned >= length) & (F.col("identities") / F.col("query_len") >= identity))


def filter_hsps_loader(df: DataFrame, lengths: DataFrame, evalue: float = 1e-5, length: float = 0.75) -> DataFrame:
    """Tabular form: alignment over the query's length (query, query_len)."""
    return df.join(lengths, "query").where((F.col("align_len") / F.col("query_len") >= length) & (F.col("evalue") <= evalue))


def filter_hsps_family(df: DataFrame, found: DataFrame, evalue: float = 1e-6, length: float = 0.8) -> DataFrame:
    """Distinct hits as long as the query, give or take, that are not found already (hit)."""
    near = F.least("align_len", "query_len") / F.greatest("align_len", "query_len")
    return df.where((near >= length) & (F.col("evalue") <= evalue)).select("query", "hit").distinct().join(found, "hit", "left_anti")


def first_passing_hit(df: DataFrame, passing: DataFrame | None = None) -> DataFrame:
    """The first row by ``order`` of each query."""
    rows = df if passing is None else passing
    return rows.withColumn("row__no", F.row_number().over(Window.partitionBy("query").orderBy("order"))).where("row__no = 1").drop("row__no")


def best_hit_by(df: DataFrame) -> DataFrame:
    """Of each query the hit of greatest confidence, then bits, then least id; confidence 0 is left out."""
    w = Window.partitionBy("query").orderBy(F.col("confidence").desc(), F.col("bits").desc(), "hit")
    return df.where("confidence > 0").withColumn("row__no", F.row_number().over(w)).where("row__no = 1").drop("row__no")


def prune_filter(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id before the pipe is in ``ids`` (id)."""
    key = F.substring_index("header", "|", 1)
    return records.withColumn("prune__id", key).join(ids.select(F.col("id").alias("prune__id")).distinct(), "prune__id", "left_semi").drop("prune__id")


def link_hits(hits: DataFrame, accessions: DataFrame, domains: DataFrame) -> DataFrame:
    """hit, sequence_key, domain_key: the first usable sequence of a hit's accession (taxonomy 0 is none), and its domains."""
    usable = accessions.where("taxonomy_id <> 0").groupBy("ac").agg(F.min("sequence_key").alias("sequence_key"))
    linked = hits.select("hit").distinct().join(usable, F.col("hit") == F.col("ac"), "left").select("hit", "sequence_key")
    return linked.join(domains, "sequence_key", "left").select("hit", "sequence_key", "domain_key")


def dedupe_sequences(records: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences to insert: sha1, sequence; links: record_id, sha1, sequence_key or null if new).

    ``records`` (record_id, sequence), ``stored`` (sequence_key, sha1).
    """
    hashed = records.withColumn("sha1", F.sha1("sequence"))
    new = hashed.groupBy("sha1").agg(F.min("sequence").alias("sequence")).join(stored, "sha1", "left_anti")
    return new, hashed.join(stored, "sha1", "left").select("record_id", "sha1", "sequence_key")


def related_families(members: DataFrame) -> DataFrame:
    """family, other: families that share a protein. Each pair is formed in the task of the lesser family and mirrored when it is distinct.

    Families are dealt to tasks by ranges, whose number follows the pairs, which are counted first. A protein's families move as one
    array, once to each range that holds some of them; pairs are formed and made distinct there, and move no more. Of a protein of very many
    families blocks of them meet, dealt to cells of two blocks each.
    """
    rows = members.select("family", "protein_key").where("family is not null and protein_key is not null")
    by = tasks(rows.sparkSession, rows.count())
    one = settled(rows.repartition(by, "protein_key").distinct())
    c = F.col("count")
    held = one.groupBy("protein_key").count()
    n = tasks(one.sparkSession, int(held.agg(F.sum(c * (c - 1) / 2)).first()[0] or 0), PAIRS)
    heavy = settled(held.where(c > BLOCK).select("protein_key", F.ceil(c / BLOCK).cast("int").alias("blocks")))
    placed = settled(one.repartitionByRange(n, "family").select(F.spark_partition_id().alias("place"), "family", "protein_key"))
    dealt = placed.join(heavy, "protein_key", "left").withColumn("block", F.pmod(F.xxhash64("family"), F.coalesce("blocks", F.lit(1))).cast("int"))
    lists = dealt.repartition(by, "protein_key").groupBy("protein_key", "block", "blocks").agg(F.collect_list(F.struct("place", "family")).alias("held"))
    met = [lists.select(F.col("held").alias("x"), F.col("held").alias("y"))]
    if not heavy.isEmpty():
        split = lists.where("blocks is not null")
        x = split.select("protein_key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("held").alias("x")).where("i < j")
        y = split.select("protein_key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("held").alias("y")).where("i < j")
        cells = x.repartition(n, "protein_key", "i", "j").join(y.repartition(n, "protein_key", "i", "j"), ["protein_key", "i", "j"])
        met += [cells.select("x", "y"), cells.select(F.col("y").alias("x"), F.col("x").alias("y"))]
    there = lambda u: u["place"] == F.col("place")
    after = lambda u: u["place"] >= F.col("place")
    sent = reduce(DataFrame.unionByName, met).withColumn("place", F.explode(F.array_distinct(F.col("x")["place"])))
    sent = sent.select("place", F.filter("x", there)["family"].alias("own"), F.filter("y", after)["family"].alias("others")).where("size(others) > 0")
    pairs = sent.repartitionById(n, "place").select("place", F.explode("own").alias("family"), "others").select("place", "family", F.explode("others").alias("other"))
    pairs = pairs.where("family < other").groupBy("place", "family", "other").agg(F.lit(1))
    return pairs.select(F.explode(F.array(F.struct("family", "other"), F.struct(F.col("other").alias("family"), F.col("family").alias("other")))).alias("p")).select("p.*")


def superfamily_members(calls: DataFrame, symbols: DataFrame, confidence: float = 0.8) -> DataFrame:
    """superfamily, sequence_key, method, symbol of confident calls."""
    from foldspark.functions.scalar import explode_sccs, sccs_level

    rows = explode_sccs(calls.where(F.col("confidence") >= confidence)).withColumn("superfamily", sccs_level("sccs", 3))
    return rows.select("superfamily", "sequence_key", "method").distinct().join(symbols, "sequence_key", "left")


def unique_tasks(proteins: DataFrame, experiments: list[int]) -> DataFrame:
    """sequence_key: distinct sequences of the experiments' proteins (sequence_key, experiment)."""
    return proteins.where(F.col("experiment").isin(experiments)).select("sequence_key").where("sequence_key is not null").distinct()


def alignment_to_atom(columns: DataFrame, seqres: DataFrame, atoms: DataFrame) -> DataFrame:
    """protein, col, residue, seqres, atom: alignment column to sequence residue, to residue of the structure's sequence,
    to atom record. ``columns`` (protein, col, residue), ``seqres`` (protein, residue, structure, seqres), ``atoms``
    (structure, seqres, atom); what a step doesn't map is dropped."""
    return columns.join(seqres, ["protein", "residue"]).join(atoms, ["structure", "seqres"]).select("protein", "col", "residue", "structure", "seqres", "atom")


def chain_mappings(*maps: DataFrame) -> DataFrame:
    """src, dst: index maps (src, dst) one after the other; keys without a match are dropped."""
    out = maps[0].select("src", "dst")
    for m in maps[1:]:
        out = out.join(m.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
    return out


def inverse(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced_edges(nodes: DataFrame, sources: list[DataFrame], neighbours: bool = False) -> DataFrame:
    """i1, i2, kind: edges of all sources with both ends in ``nodes`` (node), or either if ``neighbours``."""
    from foldspark.sources.tables import union_all

    edges, own = union_all(sources), nodes.select("node").distinct()
    first = edges.join(own.withColumnRenamed("node", "i1"), "i1", "left_semi")
    if not neighbours:
        return first.join(own.withColumnRenamed("node", "i2"), "i2", "left_semi").select("i1", "i2", "kind").distinct()
    return first.select("i1", "i2", "kind").unionByName(edges.join(own.withColumnRenamed("node", "i2"), "i2", "left_semi").select("i1", "i2", "kind")).distinct()


def network_nodes(proteins: DataFrame, ids: DataFrame, functions: DataFrame, publications: DataFrame | None = None) -> DataFrame:
    """sequence_key, gis, acc, llr [, pmid_count]: a protein's distinct ids (empty if none), its annotation of least llr and, with
    ``publications`` (gi, pmids), those of all its ids; 0 if it has none."""
    gi = ids.groupBy("sequence_key").agg(F.array_sort(F.collect_set("gi")).alias("gis"))
    best = functions.groupBy("sequence_key").agg(F.min(F.struct("llr", "acc")).alias("b"))
    out = proteins.select("sequence_key").distinct().join(gi, "sequence_key", "left").join(best, "sequence_key", "left")
    if publications is not None:
        told = ids.select("sequence_key", "gi").distinct().join(publications, "gi").groupBy("sequence_key").agg(F.sum("pmids").alias("pmids"))
        out = out.join(told, "sequence_key", "left")
    more = [] if publications is None else [F.coalesce("pmids", F.lit(0)).alias("pmid_count")]
    return out.select("sequence_key", F.coalesce("gis", F.array().cast("array<long>")).alias("gis"), F.col("b.acc").alias("acc"), F.col("b.llr").alias("llr"), *more)
