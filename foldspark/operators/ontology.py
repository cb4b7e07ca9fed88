"""Ontology graphs: closure, ancestors, leaves, matrices, annotation differences, taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalar import UNIVERSAL
from foldspark.operators.pairs import pairs_within
from foldspark.operators.trees import walk_up
from foldspark.sources.tables import settled, tasks

#: Direct annotations of which a task takes all ancestors, about.
DIRECT = 100_000
#: Sequences that meet a domain side by side, and rows of pairs of sequence and domain that a task forms, about.
TILE, RESULTS = 64, 50_000_000


def transitive_closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """ancestor, descendant, distance (least; a node itself at 0) of an acyclic (parent, child) table.

    Distances double: pairs at exactly 2^k steps are joined with all pairs up to 2^k, and with themselves for the next
    round, so rounds grow with the logarithm of the depth. Each is written, so that lineage stays short. A cycle is an error.
    """
    edges = edges.select("parent", "child").where("parent is not null and child is not null").distinct()
    own = edges.select(F.col("parent").alias("n")).unionByName(edges.select(F.col("child").alias("n")))
    own = (own if nodes is None else own.unionByName(nodes.toDF("n"))).distinct()
    far = settled(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")))
    pairs, steps = far.withColumn("distance", F.lit(1)), 1
    while not far.isEmpty():
        if not pairs.where("ancestor = descendant").isEmpty():
            raise ValueError("the graph has a cycle")
        up = far.select("ancestor", F.col("descendant").alias("mid"))
        longer = up.join(pairs.withColumnRenamed("ancestor", "mid"), "mid").select("ancestor", "descendant", (F.col("distance") + steps).alias("distance"))
        pairs, before = settled(pairs.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance"))), far
        far, steps = settled(up.join(before.withColumnRenamed("ancestor", "mid"), "mid").select("ancestor", "descendant").distinct()), 2 * steps
    return settled(pairs.unionByName(own.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).alias("distance"))))  # used several times


def ancestor_terms(annotations: DataFrame, terms: DataFrame, closure: DataFrame, types: list[str] | None = None, codes: list[str] | None = None) -> DataFrame:
    """sequence_key, acc, name, term_type: non-obsolete ancestors, of the same type, of direct terms.

    ``annotations`` (sequence_key, acc, evidence_code), ``terms`` (acc, name, term_type, is_obsolete),
    ``closure`` (ancestor, descendant: accs). ``types`` and ``codes`` restrict the direct terms. Ancestors of another type, and
    obsolete ones, are cut from the closure before annotations meet it; rows are made distinct where a sequence's meet, in tasks that follow
    the direct terms, which are settled and counted.
    """
    direct = annotations if codes is None else annotations.where(F.col("evidence_code").isin(codes))
    own = terms.where("is_obsolete = 0")
    low = own if types is None else own.where(F.col("term_type").isin(types))
    direct = settled(direct.join(low.select("acc").distinct(), "acc", "left_semi").select("sequence_key", F.col("acc").alias("descendant")).distinct())
    links = closure.select("ancestor", "descendant").join(low.select(F.col("acc").alias("descendant"), F.col("term_type").alias("own_type")), "descendant")
    links = links.join(own.select(F.col("acc").alias("ancestor"), "name", "term_type"), "ancestor").where("term_type = own_type")
    up = direct.join(links, "descendant").select("sequence_key", F.col("ancestor").alias("acc"), "name", "term_type")
    return up.repartition(tasks(direct.sparkSession, direct.count(), DIRECT), "sequence_key").distinct()


def terms_for_sequences(products: DataFrame, associations: DataFrame, evidence: DataFrame, closure: DataFrame | None = None, codes: list[str] | None = None) -> DataFrame:
    """seq_id, acc: terms of positive associations with the evidence codes, with ancestors if a closure is given."""
    ev = evidence if codes is None else evidence.where(F.col("code").isin(codes))
    found = products.join(associations.where("is_not = 0"), "product_id").join(ev, "association_id", "left_semi").select("seq_id", "acc").distinct()
    if closure is None:
        return found
    return found.join(closure, found["acc"] == closure["descendant"]).select("seq_id", F.col("ancestor").alias("acc")).distinct()


def direct_annotations(products: DataFrame, associations: DataFrame, evidence: DataFrame, no_electronic: bool = True) -> DataFrame:
    """xref, acc of products, without electronic evidence if asked."""
    ev = evidence.where("code <> 'IEA'") if no_electronic else evidence
    return products.join(associations, "product_id").join(ev, "association_id", "left_semi").select("xref", "acc").distinct()


def parents(closure: DataFrame) -> DataFrame:
    """acc, parent."""
    return closure.where((F.col("distance") == 1) & (F.col("ancestor").cast("string") != UNIVERSAL)).select(F.col("descendant").alias("acc"), F.col("ancestor").alias("parent"))


def children(closure: DataFrame) -> DataFrame:
    """acc, child."""
    return closure.where((F.col("distance") == 1) & (F.col("descendant").cast("string") != UNIVERSAL)).select(F.col("ancestor").alias("acc"), F.col("descendant").alias("child"))


def local_leaves(entity_terms: DataFrame, closure: DataFrame) -> DataFrame:
    """entity, acc: terms of an entity that are no ancestor of another of its terms.

    Each ancestor brings a mask of 256 bits with one set for each of its entities, so an entity that surely lacks it is cut before
    anything moves; the rest is looked up exactly.
    """
    rows = entity_terms.select("entity", "acc").distinct()
    bit = F.pmod(F.xxhash64("entity"), F.lit(256))
    word, flag = F.floor(bit / 64), F.expr("shiftleft(1L, cast(pmod(xxhash64(entity), 64) as int))")
    masks = rows.groupBy("acc").agg(*[F.bit_or(F.when(word == i, flag).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(4)])
    links = closure.where("distance > 0").select(F.col("ancestor"), "descendant").join(masks.withColumnRenamed("acc", "ancestor"), "ancestor")
    own = F.when(word == 0, F.col("m0")).when(word == 1, F.col("m1")).when(word == 2, F.col("m2")).otherwise(F.col("m3"))
    above = rows.join(links, F.col("acc") == F.col("descendant")).where(own.bitwiseAND(flag) != 0).select("entity", F.col("ancestor").alias("acc")).distinct()
    return rows.join(above, ["entity", "acc"], "left_anti")


def induced_dag(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """parent, child: direct edges with both ends in the term set (acc)."""
    t = terms.select("acc").distinct()
    return edges.join(
        t.withColumnRenamed("acc", "parent"), "parent", "left_semi",
    ).join(t.withColumnRenamed("acc", "child"), "child", "left_semi").select("parent", "child").distinct()


def parent_matrix(edges: DataFrame, index: DataFrame) -> DataFrame:
    """row, column, value: sparse 1 where the term of index ``row`` is a parent of the term of index ``column``.

    ``index`` (acc, idx); edges with an end outside the index give none.
    """
    up = edges.select("parent", "child").distinct().join(index.select(F.col("acc").alias("parent"), F.col("idx").alias("row")), "parent")
    return up.join(index.select(F.col("acc").alias("child"), F.col("idx").alias("column")), "child").select("row", "column", F.lit(1).alias("value"))


def common_parent_pairs(edges: DataFrame) -> DataFrame:
    """a, b, shared: children a < b of a common parent, and how many they share. Parents of many children meet theirs in blocks."""
    return pairs_within(edges.select("parent", "child").distinct(), "parent", "child").groupBy("a", "b").agg(F.count("*").alias("shared"))


def annotation_matrix(entity_terms: DataFrame, index: DataFrame) -> DataFrame:
    """entity, column, value: sparse 0/1 triples with the terms' indexes (acc, idx)."""
    return entity_terms.distinct().join(index, "acc").select("entity", F.col("idx").alias("column"), F.lit(1).alias("value"))


def climb(nodes: DataFrame, parent_of: DataFrame, stops: list[int]) -> DataFrame:
    """node, stop: the first of ``stops`` on the way up from a node; null if there is none.

    ``parent_of`` (node, parent); a node that is its own parent is at the top. Steps double from round to
    round (``trees.walk_up``). A cycle is an error.
    """
    at_stop = F.col("at").isin(stops)
    up = parent_of.select("node", F.col("parent").alias("at")).where("node <> at").where(~F.col("node").isin(stops))
    found = walk_up(up, at_stop).distinct().withColumnRenamed("at", "stop")
    own = nodes.where(F.col("node").isin(stops)).select("node", F.col("node").alias("stop")).distinct()
    return nodes.select("node").distinct().join(found.unionByName(own), "node", "left")


def kingdom(nodes: DataFrame, parent_of: DataFrame) -> DataFrame:
    """node, stop among 2, 2157 and 2759: bacteria, archaea, eukaryotes."""
    return climb(nodes, parent_of, [2, 2157, 2759])


def leaf_counts(edges: DataFrame) -> DataFrame:
    """node, leaves: leaves at or under every node of a tree."""
    closure = transitive_closure(edges)
    leaves = closure.select("descendant").distinct().join(edges.select(F.col("parent").alias("descendant")).distinct(), "descendant", "left_anti")
    return closure.join(leaves, "descendant", "left_semi").groupBy(F.col("ancestor").alias("node")).agg(F.countDistinct("descendant").alias("leaves"))


def new_annotations(recent: DataFrame, previous: DataFrame) -> DataFrame:
    """sequence_key, acc of closure-expanded recent terms that were not there before."""
    return recent.select("sequence_key", "acc").distinct().join(previous, ["sequence_key", "acc"], "left_anti")


def confirmed_predictions(predicted: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(predicted - old) that are among (new - old), by (sequence_key, acc)."""
    keys = ["sequence_key", "acc"]
    return predicted.join(old, keys, "left_anti").join(new.join(old, keys, "left_anti"), keys, "left_semi")


def novel_or_extended(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """domain_key, sequence_key, status: novel if the protein has no known term, extended if a predicted
    term is not among them, else known."""
    has = known.select("sequence_key").distinct().withColumn("has", F.lit(True))
    same = known.select("sequence_key", "acc").distinct().withColumn("same", F.lit(True))
    rows = predicted.join(has, "sequence_key", "left").join(same, ["sequence_key", "acc"], "left")
    rows = rows.groupBy("domain_key", "sequence_key").agg(F.bool_or(F.coalesce("has", F.lit(False))).alias("has"), F.bool_or(F.col("same").isNull()).alias("more"))
    return rows.select("domain_key", "sequence_key", F.when(~F.col("has"), "novel").when(F.col("more"), "extended").otherwise("known").alias("status"))


def confirmed_in_groups(sequences: DataFrame, terms: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``confirmed_predictions`` where each sequence (sequence_key, group) is predicted all terms (acc, group) of its groups.

    Starts from what is new, so the predictions are looked up and never written out.
    """
    fresh = new.select("sequence_key", "acc").distinct().join(old, ["sequence_key", "acc"], "left_anti")
    met = fresh.join(sequences, "sequence_key").join(terms.select("acc", F.col("group").alias("group__")), "acc").where(F.col("group") == F.col("group__"))
    return met.select("sequence_key", "acc").distinct()


def novel_or_extended_in_groups(sequences: DataFrame, domains: DataFrame, known: DataFrame) -> DataFrame:
    """``novel_or_extended`` where each sequence (sequence_key, group) meets all domains (domain_key, acc, group) of its group.

    A sequence and a domain have one group each. The known terms of a group that a sequence has come with it as one array, and the result
    is formed by one join, as large as it must be, which no later step moves. Its tasks follow its rows, which are counted first: groups of very
    many are dealt to several. Rows come by tiles of sequences, for each domain the same few sequences, so that files of the result
    stay small: columns are runs, or repeat what stood shortly before.
    """
    at = sequences.select("sequence_key", "group").distinct()
    told = known.select("sequence_key", "acc").distinct()
    held = told.join(at, "sequence_key").join(domains.select("acc", F.col("group").alias("group__")).distinct(), "acc").where(F.col("group") == F.col("group__"))
    held = held.groupBy("sequence_key").agg(F.collect_set("acc").alias("held"))
    own = domains.groupBy("group", "domain_key").agg(F.collect_set("acc").alias("accs"), F.bool_or(F.col("acc").isNull()).alias("gap"))
    rows = at.groupBy("group").agg(F.count("*").alias("s")).join(own.groupBy("group").agg(F.count("*").alias("d")), "group")
    sizes = settled(rows.select("group", F.ceil(F.col("s") * F.col("d") / RESULTS).cast("int").alias("parts"), (F.col("s") * F.col("d")).alias("rows")))
    n, sizes = tasks(at.sparkSession, sizes.agg(F.sum("rows")).first()[0] or 0, RESULTS), sizes.drop("rows")
    at = at.join(told.select("sequence_key", F.lit(True).alias("has")).distinct(), "sequence_key", "left").join(held, "sequence_key", "left").join(sizes, "group")
    tile = F.floor((F.row_number().over(Window.partitionBy("group").orderBy("sequence_key")) - 1) / TILE).cast("int")
    tiles = at.withColumn("tile", tile).groupBy("group", "tile", "parts").agg(F.array_sort(F.collect_list(F.struct("sequence_key", "has", "held"))).alias("tiled"))
    tiles = tiles.select("group", F.pmod("tile", "parts").alias("part"), "tiled").repartition(n, "group", "part")
    own = own.join(sizes, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").repartition(n, "group", "part")
    more = F.col("gap") | F.col("held").isNull() | (F.size(F.array_except("accs", "held")) > 0)
    met = tiles.join(own.hint("merge"), ["group", "part"]).select("domain_key", "accs", "gap", F.inline("tiled"))  # each tile meets one domain after the other
    return met.select("domain_key", "sequence_key", F.when(F.col("has").isNull(), "novel").when(more, "extended").otherwise("known").alias("status"))


def background(annotations: DataFrame) -> DataFrame:
    """acc, sequences, share: distinct sequences of each term and their share of all."""
    total = annotations.agg(F.countDistinct("sequence_key").alias("total"))
    return annotations.groupBy("acc").agg(F.countDistinct("sequence_key").alias("sequences")).crossJoin(F.broadcast(total)).select(
        "acc", "sequences", (F.col("sequences") / F.col("total")).alias("share"),
    )  # one row


def term_counts(proteins: DataFrame, terms: DataFrame, roots: list[str]) -> DataFrame:
    """protein, terms: distinct terms without roots; proteins without any count 0."""
    own = terms.where(~F.col("acc").isin(roots)).groupBy("protein").agg(F.countDistinct("acc").alias("terms"))
    return proteins.join(own, "protein", "left").select("protein", F.coalesce("terms", F.lit(0)).alias("terms"))


def not_annotated(terms: DataFrame, annotations: DataFrame, sequence: Column) -> DataFrame:
    """Terms (acc) of a branch that a sequence doesn't have."""
    return terms.join(annotations.where(F.col("sequence_key") == sequence), "acc", "left_anti")


def transfer_annotations(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """query, acc, evidence_code, hit_seqs: terms of the passing hits, with the hits that bring each."""
    return hits.join(terms, "hit").groupBy("query", "acc").agg(F.array_sort(F.collect_set("hit")).alias("hit_seqs")).withColumn("evidence_code", F.lit("IEA"))
