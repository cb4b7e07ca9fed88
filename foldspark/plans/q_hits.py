"""Queries of hits, identity, scalar functions and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.functions import scalar
from foldspark.operators import hits
from foldspark.plans.queries import query
from foldspark.sources import tables


@query("SELECT * FROM hits WHERE evalue < 0.05 AND align_len > hit_len * 0.5 AND identities > 10")
def filter_hsps(t):
    return hits.filter_hsps(t.hits, 0.05, 0.5, 10)


@query("SELECT * FROM hits WHERE evalue <= 0.05 AND least(align_len, hit_len) / hit_len >= 0.5 AND identities / 50 >= 0.6")
def filter_hsps_detailed(t):
    rows = t.hits.withColumns({"query_aligned": F.least("align_len", F.col("hit_len").cast("double")), "hit_aligned": F.lit(0.0), "query_len": F.lit(50)})
    return hits.filter_hsps_detailed(rows, 0.05, 0.5, 0.6).select(*t.hits.columns)


@query("SELECT h.*, o_custkey % 60 + 1 AS query_len FROM hits h JOIN orders ON o_orderkey = query WHERE align_len / (o_custkey % 60 + 1) >= 0.75 AND evalue <= 0.03")
def filter_hsps_loader(t):
    return hits.filter_hsps_loader(t.hits, t.read("orders").select(F.col("o_orderkey").alias("query"), (F.col("o_custkey") % 60 + 1).alias("query_len")), 0.03)


@query("SELECT DISTINCT query, hit FROM hits WHERE least(align_len, 40) / greatest(align_len, 40) >= 0.8 AND evalue <= 0.06 AND hit NOT IN (SELECT partkey FROM parts WHERE size > 25)")
def filter_hsps_family(t):
    return hits.filter_hsps_family(t.hits.withColumn("query_len", F.lit(40.0)), t.parts.where("size > 25").select(F.col("partkey").alias("hit")), 0.06)


@query("SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY line, hit, bits, evalue, identities, align_len, confidence) AS r FROM hits WHERE evalue < 0.05) WHERE r = 1")
def first_passing_hit(t):
    rows = t.hits.where("evalue < 0.05").withColumn("order", F.struct("line", "hit", "bits", "evalue", "identities", "align_len", "confidence"))
    return hits.first_passing_hit(rows).drop("order")


@query("SELECT query, hit, confidence, bits FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, bits DESC, hit) AS r FROM hits WHERE confidence > 0) WHERE r = 1")
def best_hit_by(t):
    return hits.best_hit_by(t.hits).select("query", "hit", "confidence", "bits")


@query("SELECT partkey || '|' || brand AS header FROM parts WHERE partkey IN (SELECT hit FROM hits WHERE evalue = 0.0)")
def prune_filter(t):
    records = t.parts.select(F.concat_ws("|", "partkey", "brand").alias("header"))
    return hits.prune_filter(records, t.hits.where("evalue = 0").select(F.col("hit").cast("string").alias("id")))


@query(
    "SELECT h.hit, u.sequence_key, o_orderkey AS domain_key FROM (SELECT DISTINCT hit FROM hits) h LEFT JOIN (SELECT p_partkey AS ac, min(p_partkey % 1500) AS sequence_key FROM part WHERE p_size % 7 <> 0 GROUP BY 1) u ON u.ac = h.hit LEFT JOIN orders ON o_custkey = u.sequence_key"
)
def link_hits(t):
    acc = t.read("part").select(F.col("p_partkey").alias("ac"), (F.col("p_partkey") % 1500).alias("sequence_key"), (F.col("p_size") % 7).alias("taxonomy_id"))
    return hits.link_hits(t.hits, acc, t.read("orders").select(F.col("o_custkey").alias("sequence_key"), F.col("o_orderkey").alias("domain_key")))


DEDUPE = {"h": "SELECT doc_id, sha1(text) AS sha1 FROM documents", "s": "SELECT min(doc_id) AS sequence_key, sha1 FROM h WHERE doc_id % 3 = 0 GROUP BY 2"}


def _dedupe(t):
    docs = t.read("documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("sequence"))
    stored = docs.where("record_id % 3 = 0").groupBy(F.sha1("sequence").alias("sha1")).agg(F.min("record_id").alias("sequence_key"))
    return hits.dedupe_sequences(docs, stored)


@query("SELECT doc_id AS record_id, h.sha1, sequence_key FROM h LEFT JOIN s USING (sha1)", DEDUPE)
def sequence_links(t):
    return _dedupe(t)[1]


@query("SELECT DISTINCT sha1, text AS sequence FROM documents, (SELECT doc_id AS d, sha1 FROM h) WHERE doc_id = d AND sha1 NOT IN (SELECT sha1 FROM s)", DEDUPE)
def dedupe_sequences(t):
    return _dedupe(t)[0]


@query("SELECT DISTINCT x.f AS family, y.f AS other FROM (SELECT DISTINCT l_suppkey AS f, l_partkey AS p FROM lineitem) x JOIN (SELECT DISTINCT l_suppkey AS f, l_partkey AS p FROM lineitem) y ON x.p = y.p AND x.f <> y.f")
def related_families(t):
    return hits.related_families(t.read("lineitem").select(F.col("l_suppkey").alias("family"), F.col("l_partkey").alias("protein_key")))


@query("SELECT DISTINCT array_to_string((string_split(code, '.'))[1:3], '.') AS superfamily, protein AS sequence_key, method, o_orderpriority AS symbol FROM calls JOIN parts USING (partkey) LEFT JOIN orders ON o_orderkey = protein WHERE confidence >= 0.08")
def superfamily_members(t):
    calls = t.calls.join(t.parts, "partkey").select(F.col("code").alias("sccs"), F.col("protein").alias("sequence_key"), "method", "confidence")
    return hits.superfamily_members(calls, t.read("orders").select(F.col("o_orderkey").alias("sequence_key"), F.col("o_orderpriority").alias("symbol")), 0.08)


@query("SELECT c_custkey AS src, s_nationkey AS dst FROM customer JOIN supplier ON s_suppkey = c_custkey")
def chain_mappings(t):
    one = t.read("customer").select(F.col("c_custkey").alias("src"), F.col("c_custkey").alias("dst"))
    two = t.read("supplier").select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    return hits.chain_mappings(one, hits.inverse(two))


EDGES = {"e": "SELECT o_custkey AS i1, l_suppkey AS i2, l_returnflag AS kind FROM orders JOIN lineitem ON l_orderkey = o_orderkey"}


@query("SELECT DISTINCT * FROM e WHERE i1 IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND i2 IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", EDGES)
def induced_edges(t):
    rows = t.read("orders").join(t.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("i1"), F.col("l_suppkey").alias("i2"), F.col("l_returnflag").alias("kind"))
    nodes = t.read("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("node"))
    return hits.induced_edges(nodes, [rows.where("kind = 'R'"), rows.where("kind <> 'R'")])


@query(
    "SELECT c_custkey AS sequence_key, coalesce(gis, []) AS gis, acc, llr FROM customer LEFT JOIN (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderkey)) AS gis FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON k = c_custkey LEFT JOIN (SELECT sequence_key AS k2, acc, size * 1.0::DOUBLE AS llr, row_number() OVER (PARTITION BY sequence_key ORDER BY size, acc) AS r FROM annotations JOIN parts ON partkey = acc) ON k2 = c_custkey AND r = 1"
)
def network_nodes(t):
    ids = t.read("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("sequence_key"), F.col("o_orderkey").alias("gi"))
    fn = t.annotations.join(t.parts, F.col("acc") == F.col("partkey")).select("sequence_key", "acc", F.col("size").cast("double").alias("llr"))
    return hits.network_nodes(t.read("customer").select(F.col("c_custkey").alias("sequence_key")), ids, fn)


@query(
    "SELECT c_custkey AS sequence_key, coalesce(gis, []) AS gis, acc, llr, coalesce(pmids, 0)::BIGINT AS pmid_count FROM customer LEFT JOIN (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderkey)) AS gis FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON k = c_custkey LEFT JOIN (SELECT sequence_key AS k2, acc, size * 1.0::DOUBLE AS llr, row_number() OVER (PARTITION BY sequence_key ORDER BY size, acc) AS r FROM annotations JOIN parts ON partkey = acc) ON k2 = c_custkey AND r = 1 LEFT JOIN (SELECT o_custkey AS k3, sum(n) AS pmids FROM orders JOIN (SELECT l_orderkey AS k4, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON k4 = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1) ON k3 = c_custkey"
)
def network_nodes_published(t):
    ids = t.read("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("sequence_key"), F.col("o_orderkey").alias("gi"))
    fn = t.annotations.join(t.parts, F.col("acc") == F.col("partkey")).select("sequence_key", "acc", F.col("size").cast("double").alias("llr"))
    pubs = t.read("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("gi")).agg(F.count("*").alias("pmids"))
    return hits.network_nodes(t.read("customer").select(F.col("c_custkey").alias("sequence_key")), ids, fn, pubs)


# Scalar functions.


@query("SELECT partkey, array_to_string((string_split(code, '.'))[1:2], '.') AS two, regexp_replace(code, '\\.[^.]*$', '') AS superfamily, regexp_replace(regexp_replace(code, '\\.[^.]*$', ''), '\\.[^.]*$', '') AS fold FROM parts")
def class_codes(t):
    return t.parts.select("partkey", scalar.sccs_level("code", 2).alias("two"), scalar.superfamily("code").alias("superfamily"), scalar.fold("code").alias("fold"))


@query("SELECT partkey, unnest([code, brand]) AS sccs FROM parts")
def explode_sccs(t):
    return scalar.explode_sccs(t.parts.select("partkey", F.concat(F.col("code"), F.lit(" ,, "), F.col("brand")).alias("sccs")))


@query("SELECT c_custkey, c_custkey::VARCHAR AS number FROM customer")
def hit_id(t):
    return t.read("customer").select("c_custkey", F.regexp_replace(F.coalesce(scalar.hit_id("c_name", "number"), F.lit("0")), "^$", "0").alias("number"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS bddb, c_custkey::VARCHAR AS human, c_nationkey::VARCHAR AS experiment, 'msa' AS kind, 'A' || c_custkey AS uniprot, 'A' || c_custkey || ':' || c_nationkey || '-' || c_custkey AS ranged, 'd' || lpad(c_custkey::VARCHAR, 6, '0') AS astral FROM customer")
def hit_styles(t):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    uniprot = F.concat(F.lit("sp|A"), key, F.lit("|"), "c_name", F.lit(" Range:"), nation, F.lit("-"), key)
    human = F.concat(key, F.lit(" | "), key, F.lit(" | "), nation, F.lit(" | "), "c_name")
    typed = scalar.hit_fields(F.concat_ws("|", key, key, nation, F.lit("msa<")), "typed_domain")
    return t.read("customer").select(
        "c_custkey",
        scalar.hit_id(F.concat(F.lit("bddb|"), key, F.lit("| "), "c_name"), "bddb").alias("bddb"),
        scalar.hit_fields(human, "local_human")["protein"].alias("human"),
        typed["experiment"].alias("experiment"),
        typed["kind"].alias("kind"),
        scalar.hit_id(uniprot, "uniprot").alias("uniprot"),
        scalar.ranged_id(uniprot).alias("ranged"),
        scalar.hit_id(F.concat(F.lit("d"), F.lpad(key, 6, "0"), F.lit(" a.1.1.1")), "astral").alias("astral"),
    )


@query("SELECT partkey, method, CASE method WHEN 'psiblast' THEN 'psi' WHEN 'fold_recognition' THEN 'fr' ELSE 'mcm' END AS grp, CASE method WHEN 'psiblast' THEN 1.0 WHEN 'fold_recognition' THEN 0.9 ELSE 0.5 END::DOUBLE AS scale, method IN ('psiblast', 'fold_recognition') AS known FROM (SELECT DISTINCT partkey, method FROM calls)")
def model_groups(t):
    return t.calls.select("partkey", "method").distinct().withColumn("grp", scalar.model_group("method")).withColumn("scale", scalar.model_scale("grp")).withColumn("known", scalar.known_type("method"))


@query("SELECT item_id, translate(text, 'XZBU', 'AQNC') AS seq, regexp_replace(text, '[*\\s.-]', '', 'g') AS clean FROM benchmark")
def sequence_text(t):
    return t.read("benchmark").select("item_id", scalar.translate_nonstandard("text").alias("seq"), scalar.clean_sequence("text").alias("clean"))


@query("SELECT doc_id, round((len(text) - len(replace(text, 'e', ''))) / len(text), 8) AS share, substr(text, 3, 7) AS part FROM documents")
def ss_fractions(t):
    d = t.read("documents").withColumn("ss", F.translate("text", "HEe", "hhH").alias("ss"))
    return d.select("doc_id", F.round(scalar.ss_fractions("text", "ss")[0], 8).alias("share"), scalar.region_slice("text", F.lit(3), F.lit(9)).alias("part"))


@query("SELECT partkey, chain, CASE WHEN size % 5 = 0 THEN 1 WHEN size % 5 = 1 THEN NULL ELSE greatest(size - 9, 0) END AS start, CASE WHEN size % 5 = 0 THEN 77 WHEN size % 5 = 1 THEN NULL ELSE size + 40 END AS stop FROM (SELECT *, CASE WHEN size % 5 <> 1 THEN 'A' END AS chain FROM parts)")
def parse_chain_range(t):
    text = F.when(F.col("size") % 5 == 0, "A:").when(F.col("size") % 5 == 1, "?").otherwise(F.concat(F.lit("A:"), F.col("size") - 9, F.lit("-"), F.col("size") + 40))
    chain, start, stop = scalar.chain_range("text", F.lit(77))
    return t.parts.withColumn("text", text).select("partkey", chain.alias("chain"), start.alias("start"), stop.alias("stop"))


@query("SELECT domain, pdb, chain, start, round(greatest(0, least(stop, 60) - greatest(start, 25) + 1) / (stop - start + 1), 8) AS ratio FROM regions")
def overlap_ratio(t):
    return t.regions.select("domain", "pdb", "chain", "start", F.round(scalar.overlap_ratio("start", "stop", F.lit(25), F.lit(60)), 8).alias("ratio"))


@query("SELECT doc_id, CASE WHEN a > 0 THEN a END AS start, CASE WHEN a > 0 THEN a + k END AS stop, CASE WHEN a > 0 THEN round(greatest(0, least(a + k, 60) - greatest(a, 10)) / k, 8) END AS fold_share FROM (SELECT doc_id, len(text) // 2 + 1 AS k, strpos(text, substr(text, len(text) // 4 + 1, len(text) // 2 + 1)) AS a FROM documents WHERE text <> '')")
def fold_coverage(t):
    f = scalar.fold_coverage("text", F.expr("substring(text, length(text) div 4 + 1, length(text) div 2 + 1)"), F.lit(10), F.lit(60))
    return t.read("documents").where("text <> ''").select("doc_id", f.alias("f")).select("doc_id", "f.start", "f.stop", F.round("f.fold_share", 8).alias("fold_share"))


@query("SELECT partkey, round(exp(lgamma(31) - lgamma(x + 1) - lgamma(31 - x) + lgamma(71) - lgamma(20 - x + 1) - lgamma(70 - 20 + x + 1) - lgamma(101) + lgamma(21) + lgamma(81)), 8) AS p FROM (SELECT partkey, size % 20 AS x FROM parts)")
def hypergeom_point(t):
    return t.parts.select("partkey", F.round(scalar.hypergeom_point((F.col("size") % 20).cast("long"), F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(20).cast("long")), 8).alias("p"))


@query(
    """SELECT partkey, class, round(1 / (1 + 1 / exp(CASE class WHEN 1 THEN -4.532031 + 0.658800 * z + 0.133027 * o - 0.091581 * v - 4.08231 * r WHEN 2 THEN -1.597025 + 0.664228 * z + 0.092968 * o - 0.353935 * v - 6.715978 * r ELSE -4.095602 + 0.673068 * z + 0.051677 * o + 0.025341 * v - 5.160030 * r END)), 8) AS probability
    FROM (SELECT partkey, size / 5.0 AS z, size / 3.0 AS o, 4.0 AS v, abs(ln((size + 20) / 40.0)) AS r, CASE WHEN size % 2 = 0 AND size % 3 <> 0 THEN 1 WHEN size % 2 <> 0 AND size % 3 = 0 THEN 2 ELSE 3 END AS class FROM parts)"""
)
def mcm_score(t):
    alpha, beta = F.when(F.col("size") % 2 == 0, 0.4).otherwise(0.0), F.when(F.col("size") % 3 == 0, 0.3).otherwise(0.0)
    s = scalar.fold_score(F.col("size") / 5, F.col("size") / 3, F.lit(4.0), F.col("size") + 20, F.lit(40.0), alpha, beta, F.lit(0.2), F.lit(0.0))
    return t.parts.select("partkey", s.alias("s")).select("partkey", "s.class", F.round("s.probability", 8).alias("probability"))


@query("SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def upsert(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    return tables.upsert(o, o.where("k % 3 = 0").withColumn("v", -F.col("v")), ["k"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def pending_work(t):
    done = t.read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return tables.pending_work(t.read("customer").select("c_custkey"), done, "c_custkey", "o_orderdate", F.lit("2001-01-01").cast("timestamp"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4))")
def snapshot_subset(t):
    got = tables.snapshot_subset({"orders": t.read("orders"), "lineitem": t.read("lineitem")}, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")], {"customer": t.read("customer").where("c_nationkey = 4")})
    return got["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("SELECT DISTINCT o_custkey AS sequence_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (3, 4)")
def unique_tasks(t):
    rows = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return hits.unique_tasks(rows.select(F.col("o_custkey").alias("sequence_key"), F.col("c_nationkey").alias("experiment")), [3, 4])


@query("SELECT l_orderkey AS protein, l_linenumber AS col, l_linenumber + 1 AS residue, l_partkey AS structure, size AS seqres, size * 2 AS atom FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN parts ON partkey = l_partkey WHERE size % 2 = 0")
def alignment_to_atom(t):
    li = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    residue = (F.col("l_linenumber") + 1).alias("residue")
    cols = li.select(F.col("l_orderkey").alias("protein"), F.col("l_linenumber").alias("col"), residue).distinct()
    seqres = li.join(t.parts, F.col("l_partkey") == F.col("partkey")).select(F.col("l_orderkey").alias("protein"), residue, F.col("partkey").alias("structure"), F.col("size").alias("seqres"))
    atoms = t.parts.where("size % 2 = 0").select(F.col("partkey").alias("structure"), F.col("size").alias("seqres"), (F.col("size") * 2).alias("atom"))
    return hits.alignment_to_atom(cols, seqres, atoms)
