"""Queries of structural classes, similarity, summaries, rankings and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.operators import columns, structure, summary
from foldspark.plans.adapters import draw_sql
from foldspark.plans.queries import query
from foldspark.sources.tables import tasks

SCOP = {"scop": "SELECT l_orderkey * 10 + l_linenumber AS scop, l_partkey AS pdb, l_returnflag AS chain, CASE WHEN l_linestatus = 'O' THEN l_linenumber * 10 - 3 END AS start, CASE WHEN l_linestatus = 'O' THEN l_linenumber * 10 + 12 END AS stop, 40 AS chain_len, code AS sccs FROM lineitem JOIN parts ON partkey = l_partkey"}


def _scop(t):
    rows = t.read("lineitem").join(t.parts, F.col("l_partkey") == F.col("partkey"))
    own = F.col("l_linestatus") == "O"
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scop"), F.col("partkey").alias("pdb"), F.col("l_returnflag").alias("chain"), F.when(own, F.col("l_linenumber") * 10 - 3).alias("start"), F.when(own, F.col("l_linenumber") * 10 + 12).alias("stop"), F.lit(40).alias("chain_len"), F.col("code").alias("sccs"))


@query(
    """SELECT domain, string_agg(DISTINCT sccs, ', ' ORDER BY sccs) AS sccs, count(*) AS size, 1.0::DOUBLE AS confidence FROM (
    SELECT r.domain, s.scop, s.sccs, sum(CASE WHEN s.start IS NULL OR s.start = 0 THEN abs(r.stop - r.start) ELSE greatest(0, least(r.stop, s.stop) - greatest(r.start, s.start)) END) AS common FROM regions r JOIN scop s ON s.pdb = r.pdb AND s.chain = r.chain GROUP BY 1, 2, 3) JOIN
    (SELECT scop, sum(CASE WHEN start IS NULL OR start = 0 THEN chain_len ELSE stop - start + 1 END) AS length FROM scop GROUP BY 1) USING (scop) WHERE common > 0.5 * length GROUP BY 1""",
    SCOP,
)
def assign_scop(t):
    return structure.assign_scop(t.regions, _scop(t))


@query("SELECT scop, sum(CASE WHEN start IS NULL OR start = 0 THEN chain_len ELSE stop - start + 1 END)::BIGINT AS length FROM scop GROUP BY 1", SCOP)
def scop_length(t):
    return structure.scop_length(_scop(t))


ASTRAL = {"ast": "SELECT partkey AS astral, partkey AS pdb, 'R' AS chain, size AS start, size + 25 AS stop FROM parts"}


def _astrals(t):
    return t.parts.select(F.col("partkey").alias("astral"), F.col("partkey").alias("pdb"), F.lit("R").alias("chain"), F.col("size").alias("start"), (F.col("size") + 25).alias("stop"))


@query("SELECT DISTINCT domain, astral, round(ratio, 8) AS ratio FROM (SELECT r.domain, a.astral, greatest(0, least(r.stop, a.stop) - greatest(r.start, a.start) + 1) / (r.stop - r.start + 1) AS ratio FROM regions r JOIN ast a ON a.pdb = r.pdb AND a.chain = r.chain) WHERE ratio > 0", ASTRAL)
def domain_astral_overlap(t):
    return structure.domain_astral_overlap(t.regions, _astrals(t)).withColumn("ratio", F.round("ratio", 8))


@query("SELECT DISTINCT domain, astral, round(ratio, 8) AS ratio FROM (SELECT r.domain, a.astral, greatest(0, least(r.stop, a.stop) - greatest(r.start, a.start) + 1) / (a.stop - a.start + 1) AS ratio FROM regions r JOIN ast a ON a.pdb = r.pdb AND a.chain = r.chain) WHERE ratio >= 0.5", ASTRAL)
def astral_domain_overlap(t):
    return structure.domain_astral_overlap(t.regions, _astrals(t), "astral", 0.5).withColumn("ratio", F.round("ratio", 8))


@query("SELECT domain, max(pdb) AS pdb, max_by(chain, (pdb, chain)) AS chain FROM regions GROUP BY 1")
def domain_structures(t):
    return structure.domain_structures(t.regions.select("domain", F.col("domain").alias("key")).distinct(), t.regions.select(F.col("domain").alias("key"), "pdb", "chain"))


_KIND = "(['psiblast', 'fold_recognition', 'pfam', 'msa', 'unassigned'])[(l_partkey % 5)::INT + 1]"


@query(
    f"""SELECT domain, parent, b.kind AS kind, b.pdb AS pdb, b.chain AS chain, b.start AS start, b.stop AS stop, length FROM (
    SELECT d.sequence AS domain, d.parent AS parent, length(any_value(s.sequence)) AS length, max({{'pdb': i.pdb, 'chain': r.chain, 'kind': d.kind, 'start': n.start, 'stop': n.stop}}) AS b
    FROM (SELECT n_nationkey AS id FROM nation WHERE n_regionkey < 3) e JOIN (SELECT c_nationkey AS experiment, c_custkey AS sequence FROM customer) p ON e.id = p.experiment
    JOIN (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS sequence, o_custkey AS parent, {_KIND} AS kind, 'pdb' || l_suppkey AS parent_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey) d ON p.sequence = d.parent
    JOIN (SELECT p_partkey AS id, p_name AS sequence FROM part) s ON d.sequence = s.id
    JOIN (SELECT DISTINCT l_suppkey AS sequence, l_returnflag AS chain, l_linenumber AS pdb_key FROM lineitem) r ON substr(d.parent_id, 4)::BIGINT = r.sequence
    JOIN (SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber * 10 AS start, (l_linenumber * 10 + l_quantity)::INT AS stop FROM lineitem) n ON d.id = n.id
    JOIN (SELECT r_regionkey AS id, r_name AS pdb FROM region) i ON r.pdb_key = i.id
    WHERE d.kind IN ('psiblast', 'fold_recognition') GROUP BY 1, 2)"""
)
def structures_of_experiments(t):
    li = t.read("lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    kind = F.get(F.array(*map(F.lit, ("psiblast", "fold_recognition", "pfam", "msa", "unassigned"))), (F.col("l_partkey") % 5).cast("int"))
    domains = t.read("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(key.alias("id"), F.col("l_partkey").alias("sequence"), F.col("o_custkey").alias("parent"), kind.alias("kind"), F.concat(F.lit("pdb"), F.col("l_suppkey")).alias("parent_id"))
    return structure.structures_of_experiments(
        t.read("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("id")),
        t.read("customer").select(F.col("c_nationkey").alias("experiment"), F.col("c_custkey").alias("sequence")),
        domains,
        t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence")),
        li.select(F.col("l_suppkey").alias("sequence"), F.col("l_returnflag").alias("chain"), F.col("l_linenumber").alias("pdb_key")),
        li.select(key.alias("domain_id"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("int").alias("stop")),
        t.read("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("pdb")),
    )


@query("SELECT protein AS domain, method AS sccs, size, confidence FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY size DESC, confidence DESC, method) AS r FROM (SELECT DISTINCT protein, method, size, confidence FROM calls)) WHERE r = 1")
def best_call_per_domain(t):
    return structure.best_call_per_domain(t.calls.select(F.col("protein").alias("domain"), F.col("method").alias("sccs"), "size", "confidence").distinct())


@query("SELECT w.a, w.b, coalesce(p.zscore, 0)::DOUBLE AS zscore FROM (SELECT partkey AS a, partkey % 97 AS b FROM parts) w LEFT JOIN pairs p ON p.a = least(w.a, w.b) AND p.b = greatest(w.a, w.b)")
def lookup_pair_score(t):
    return structure.lookup_pair_score(t.parts.select(F.col("partkey").alias("a"), (F.col("partkey") % 97).alias("b")), t.pairs, 0.0)


@query("SELECT partkey AS a, partkey % 97 AS b FROM parts WHERE (least(partkey, partkey % 97), greatest(partkey, partkey % 97)) NOT IN (SELECT (a, b) FROM pairs)")
def missing_pairs(t):
    return structure.missing_pairs(t.parts.select(F.col("partkey").alias("a"), (F.col("partkey") % 97).alias("b")), t.pairs)


DIRECTED = {
    "both_ways": "SELECT a, b, zscore FROM element_pairs UNION ALL SELECT b, a, zscore FROM element_pairs WHERE a <> b",
    "each": "SELECT x.protein AS p, y.protein AS q, x.elem, greatest(max(zscore), 0) AS best FROM both_ways s JOIN elements x ON x.structure = s.a JOIN elements y ON y.structure = s.b WHERE x.protein <> y.protein GROUP BY 1, 2, 3",
    "sizes": "SELECT protein, count(DISTINCT elem) AS n FROM elements GROUP BY 1",
    "sim": "SELECT p1 AS p, q1 AS q, round(total / (a.n + b.n), 8) AS similarity FROM (SELECT least(p, q) AS p1, greatest(p, q) AS q1, sum(best) AS total FROM each GROUP BY 1, 2) JOIN sizes a ON a.protein = p1 JOIN sizes b ON b.protein = q1",
}


@query("SELECT * FROM sim", DIRECTED)
def pairwise_max_avg(t):
    return structure.pairwise_max_avg(t.element_rows, t.element_pairs, is_canonical=True).withColumn("similarity", F.round("similarity", 8))


@query(
    "SELECT source, other, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, other) AS rank FROM (SELECT p AS source, q AS other, similarity FROM sim UNION ALL SELECT q, p, similarity FROM sim)) WHERE rank <= 10",
    DIRECTED,
)
def homolog_all_vs_all(t):
    return structure.homolog_all_vs_all(t.element_rows, t.element_pairs, 10, is_canonical=True).withColumn("similarity", F.round("similarity", 8))


@query("SELECT DISTINCT protein, 'k' || structure AS elem, structure FROM elements UNION ALL SELECT o_custkey, 'd' || o_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY q DESC, l_partkey) AS r FROM (SELECT o_custkey, o_orderkey, l_partkey, max(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)) WHERE r <= 5")
def protein_structure_set(t):
    n = t.tasks("lineitem")  # rows are dealt once by the key on which they meet; joins, distinct rows and ranks follow in place
    rows = t.read("orders").repartition(n, "o_orderkey").join(t.read("lineitem").repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    d = rows.groupBy(F.col("o_custkey").alias("protein"), F.col("o_orderkey").alias("domain"), F.col("l_partkey").alias("structure")).agg(F.max("l_quantity").alias("probability"))
    return structure.protein_structure_set(t.element_rows.select("protein", "structure").repartition(n, "protein"), d)


@query("SELECT least(x.idx, y.idx) AS row, greatest(x.idx, y.idx) AS \"column\", similarity FROM sim JOIN keyed x ON x.protein = p JOIN keyed y ON y.protein = q", DIRECTED | {"keyed": "SELECT protein, row_number() OVER (ORDER BY protein) - 1 AS idx FROM (SELECT DISTINCT protein FROM elements)"})
def similarity_matrix(t):
    return structure.similarity_matrix(t.element_rows, t.element_pairs, is_canonical=True)[0].withColumn("similarity", F.round("similarity", 8))


@query("SELECT structure, row_number() OVER (ORDER BY structure) - 1 AS idx FROM (SELECT DISTINCT structure FROM elements)")
def score_index(t):
    return structure.score_index(t.elements)


@query("SELECT structure, row_number() OVER (ORDER BY structure) - 1 AS idx FROM (SELECT DISTINCT kind || ' ' || code AS structure FROM parts)")
def score_index_names(t):
    return structure.score_index(t.parts.select(F.concat_ws(" ", "kind", "code").alias("structure")))


@query("SELECT least(x.idx, y.idx) AS row, greatest(x.idx, y.idx) AS \"column\", zscore FROM pairs JOIN (SELECT partkey AS k, partkey + 5 AS idx FROM parts) x ON x.k = a JOIN (SELECT partkey AS k, partkey + 5 AS idx FROM parts) y ON y.k = b")
def group_matrix(t):
    return structure.group_matrix(t.parts.select(F.col("partkey").alias("structure"), (F.col("partkey") + 5).alias("idx")), t.pairs)


@query("SELECT a.block AS block_a, b.block AS block_b FROM (SELECT DISTINCT right(lpad(partkey::VARCHAR, greatest(2, len(partkey::VARCHAR))::INT, '0'), 2) AS block FROM parts) a, (SELECT DISTINCT right(lpad(partkey::VARCHAR, greatest(2, len(partkey::VARCHAR))::INT, '0'), 2) AS block FROM parts) b WHERE a.block <= b.block")
def pair_blocks(t):
    return structure.pair_blocks(t.parts.select(F.when(F.col("partkey") < 10, F.concat(F.lit("0"), F.col("partkey"))).otherwise(F.col("partkey").cast("string")).alias("key")).select(F.right("key", F.lit(2)).alias("key")))


CHAINS = {
    "single": "SELECT domain, min(pdb) AS key, start, stop FROM regions GROUP BY domain, start, stop",
    "picked": "SELECT domain, key, min((start, stop)) AS x FROM single GROUP BY domain, key",
    "placed": "SELECT domain, key, x[1] AS start, x[2] AS stop, 900000000::BIGINT * (x[2] - x[1] + 1) AS value, row_number() OVER (PARTITION BY domain ORDER BY x[1], x[2], key) AS i FROM picked",
    "follows": "SELECT a.domain, a.i, b.i AS j FROM placed a JOIN placed b ON a.domain = b.domain AND a.i < b.i WHERE greatest(0, least(a.stop, b.stop) - greatest(a.start, b.start) + 1) / (a.stop - a.start + 1) < 0.1",
    "few": "SELECT domain FROM placed WHERE domain NOT IN (SELECT domain FROM follows GROUP BY domain HAVING count(*) > 50) GROUP BY domain",
    "chains": "WITH RECURSIVE c(domain, i, total, back) AS (SELECT domain, i, value, [i] FROM placed JOIN few USING (domain) UNION ALL SELECT c.domain, f.j, c.total + p.value, list_prepend(f.j, c.back) FROM c JOIN follows f ON f.domain = c.domain AND f.i = c.i JOIN placed p ON p.domain = f.domain AND p.i = f.j) SELECT * FROM c",
    "best": "SELECT domain, unnest(back) AS i FROM chains QUALIFY row_number() OVER (PARTITION BY domain ORDER BY total DESC, back) = 1",
}


@query("SELECT domain, key, start, stop, 0.9::DOUBLE AS ratio FROM best JOIN placed USING (domain, i)", CHAINS)
def representative_path(t):
    c = t.regions.select("domain", F.col("pdb").alias("key"), "start", "stop", F.lit(0.9).alias("ratio"))
    return structure.representative_path(c)


# Summaries.


@query("SELECT class, coalesce(sum(size), 0)::BIGINT AS total, coalesce(sum(size) FILTER (confidence >= 0.05), 0)::BIGINT AS confident FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i']) AS class) LEFT JOIN (SELECT substr(code, 1, 1) AS k, c.size, confidence FROM calls c JOIN parts USING (partkey)) ON k = class GROUP BY 1")
def count_by_class(t):
    return summary.count_by_class(t.calls.join(t.parts.select("partkey", F.col("code").alias("sccs")), "partkey"), 0.05)


@query(
    f"SELECT class, coalesce(sum(size), 0)::BIGINT AS total, coalesce(sum(size) FILTER (confidence > 0.05), 0)::BIGINT AS confident FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i']) AS class) LEFT JOIN (SELECT substr(code, 1, 1) AS k, c.size, confidence FROM calls c JOIN parts USING (partkey) WHERE method IN ('pfam', 'msa') AND confidence > 0 AND protein IN (SELECT protein FROM (SELECT DISTINCT protein FROM calls) ORDER BY {draw_sql(6, 'protein')}, protein LIMIT 500)) ON k = class GROUP BY 1"
)
def class_counts(t):
    return summary.class_counts(t.calls.join(t.parts.select("partkey", F.col("code").alias("sccs")), "partkey"), 0.05, ["pfam", "msa"], 500, 6, "protein")


@query("SELECT p AS p, q AS q, round(total / least(a.n, b.n), 8) AS similarity FROM (SELECT least(p, q) AS p, greatest(p, q) AS q, sum(best) AS total FROM each GROUP BY 1, 2) JOIN sizes a ON a.protein = p JOIN sizes b ON b.protein = q", DIRECTED)
def pairwise_max_by_smaller(t):
    by_smaller = lambda total, n_p, n_q: total / F.least(n_p, n_q)
    return structure.pairwise_max_avg(t.element_rows, t.element_pairs, is_canonical=True, similarity=by_smaller).withColumn("similarity", F.round("similarity", 8))


@query("SELECT experiment, method, sum(size)::BIGINT AS size, round(sum(size) / sum(sum(size)) OVER (PARTITION BY experiment), 8) AS share FROM calls GROUP BY 1, 2")
def domain_yield(t):
    return summary.domain_yield(t.calls).withColumn("share", F.round("share", 8))


@query("SELECT experiment, count(DISTINCT protein) AS proteins, count(*) AS domains, " + ", ".join(f"coalesce(sum(size) FILTER (method = '{m}'), 0)::BIGINT AS {m}" for m in summary.METHODS) + ", coalesce(sum(size) FILTER (confidence >= 0.04), 0)::BIGINT AS medium, coalesce(sum(size) FILTER (confidence >= 0.08), 0)::BIGINT AS high FROM calls GROUP BY 1")
def organism_summary(t):
    return summary.organism_summary(t.calls, 0.04, 0.08)


@query("SELECT size, count(*) AS proteins FROM (SELECT sum(size)::BIGINT AS size FROM calls GROUP BY protein) GROUP BY 1")
def domain_count_histogram(t):
    return summary.domain_count_histogram(t.calls)


@query(
    """SELECT protein, size, round(coverage, 8) AS coverage, sccs, types, CASE WHEN coverage >= 1 THEN 3 WHEN coverage >= 0.5 THEN 2 WHEN coverage > 0 THEN 1 ELSE 0 END AS quality FROM (
    SELECT protein, sum(size)::BIGINT AS size, sum(CASE WHEN method IN ('psiblast', 'fold_recognition') OR confidence >= 0.08 THEN size ELSE 0 END) / sum(size) AS coverage, coalesce(string_agg(DISTINCT brand, ',' ORDER BY brand) FILTER (confidence >= 0.08), '') AS sccs FROM (SELECT c.*, brand FROM calls c JOIN parts USING (partkey)) GROUP BY 1)
    JOIN (SELECT protein, string_agg(method || ':' || n, ',' ORDER BY method || ':' || n) AS types FROM (SELECT protein, method, sum(size)::BIGINT AS n FROM calls GROUP BY 1, 2) GROUP BY 1) USING (protein)"""
)
def protein_structure_summary(t):
    return summary.protein_structure_summary(t.calls.join(t.parts.select("partkey", F.col("brand").alias("sccs")), "partkey"), 0.08).withColumn("coverage", F.round("coverage", 8))


@query("SELECT entity AS protein, max_by(acc, (w, acc)) AS acc, round(max(w), 8) AS weight FROM (SELECT entity, acc, base * 10 / (1 + exp(-(score / 10 - 6.23))) AS w FROM scored) GROUP BY 1")
def best_function(t):
    return summary.best_function(t.scored.select(F.col("entity").alias("protein"), "acc", (-F.col("base") * 10).alias("base"), (F.col("score") / 10).alias("pls"))).withColumn("weight", F.round("weight", 8))


FAM = {"dm": "SELECT c_nationkey AS family, c_custkey AS protein, 500 AS length, l_returnflag AS method, l_quantity AS dlen FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"}


@query("SELECT family, method, round(s / n, 9) AS coverage, round(s / sum(s) OVER (PARTITION BY family), 9) AS share FROM (SELECT family, method, sum(dlen / length) AS s FROM dm GROUP BY 1, 2) JOIN (SELECT c_nationkey AS family, count(*) AS n FROM customer GROUP BY 1) USING (family)", FAM)
def family_coverage(t):
    members = t.read("customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("protein"), F.lit(500).alias("length"))
    d = t.read("orders").join(t.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("protein"), F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("dlen"))
    return summary.family_coverage(members, d).withColumns({c: F.round(c, 9) for c in ("coverage", "share")})


@query("SELECT c_nationkey AS family, l_returnflag AS acc, list_sort(list(DISTINCT c_custkey)) AS proteins FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def family_term_index(t):
    rows = t.read("customer").join(t.read("orders"), F.col("o_custkey") == F.col("c_custkey")).join(t.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return summary.family_term_index(rows.select(F.col("c_nationkey").alias("family"), F.col("l_returnflag").alias("acc"), F.col("c_custkey").alias("protein")))


@query("SELECT entity AS protein, count(DISTINCT domain) AS domains, count(*) AS predictions, count(DISTINCT acc) AS functions, count(DISTINCT acc) FILTER (label > 0) AS terms FROM scored GROUP BY 1")
def protein_stats(t):
    s = t.scored.withColumn("protein", F.col("entity"))
    return summary.protein_stats(s, s, s.where("label > 0"))


@query("SELECT domain AS sequence_key, map_from_entries(list_sort(list((kind, vals)))) AS signature FROM (SELECT domain, grp AS kind, list_sort(list(DISTINCT CASE WHEN label < 0 THEN 'NOT_' || acc ELSE acc::VARCHAR END)) AS vals FROM scored GROUP BY 1, 2) GROUP BY 1")
def gather_signatures(t):
    return summary.gather_signatures(t.scored.select(F.col("domain").alias("sequence_key"), F.col("grp").alias("kind"), F.col("acc").cast("string").alias("value"), (F.col("label") < 0).alias("negated")))


@query("SELECT entity AS sequence, count(*) FILTER (grp = 'O') >= 5 AS enough, avg(score) FILTER (grp = 'O') >= coalesce(avg(score) FILTER (grp = 'F'), 0) AS no_worse, count(DISTINCT label) FILTER (grp = 'O') = 1 AS converged, count(*) >= 25 AS clustered FROM scored GROUP BY 1 HAVING count(*) FILTER (grp = 'O') > 0")
def mcm_audit(t):
    s = t.scored.select(F.col("entity").alias("sequence"), F.col("score").alias("probability"), F.col("label").alias("convergence"), "grp")
    return summary.mcm_audit(s.where("grp = 'O'"), s.where("grp = 'F'"), s)


@query("SELECT query AS cluster, avg(align_len) > 25 AS \"over\" FROM hits GROUP BY 1")
def since_solved_split(t):
    return summary.since_solved_split(t.hits.select(F.col("query").alias("cluster"), F.col("align_len").alias("length")), 25.0)


TRUTH = {"truth": "SELECT DISTINCT cluster, sccs FROM clusters WHERE supplier % 3 = 0"}


@query("SELECT DISTINCT c.cluster, c.sccs, c.probability, t.sccs IS NOT NULL AS correct FROM (SELECT *, max(probability) OVER (PARTITION BY cluster) AS top FROM clusters WHERE probability >= 0.1 AND day >= TIMESTAMP '1996-01-01') c LEFT JOIN truth t ON t.cluster = c.cluster AND t.sccs = c.sccs WHERE probability = top", TRUTH)
def top_per_cluster(t):
    return summary.top_per_cluster(t.clusters, t.clusters.where("supplier % 3 = 0"), F.lit("1996-01-01").cast("timestamp"), 0.1)


@query("SELECT domain AS sequence, acc AS structure, score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, acc) AS r FROM (SELECT DISTINCT domain, acc, score FROM scored)) WHERE r <= 5")
def top_mcm(t):
    rows = t.scored.select(F.col("domain").alias("sequence"), F.col("acc").alias("structure"), "score").distinct()
    return summary.top_n(rows, "sequence", 5, F.col("score").desc(), "structure")


DECOYS = {"dec": "SELECT l_suppkey AS code, l_orderkey * 10 + l_linenumber AS decoy, min(l_extendedprice) AS score, min(l_quantity) AS rg FROM lineitem GROUP BY 1, 2"}


def _decoys(t):
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decoy")).agg(F.min("l_extendedprice").alias("score"), F.min("l_quantity").alias("rg"))


@query("SELECT code, decoy, score, rg FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY rg, decoy) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score, decoy) AS r FROM dec) WHERE r <= 150) WHERE r2 <= 100", DECOYS)
def decoy_filter(t):
    return summary.decoy_filter(_decoys(t), 150, 100)


@query("SELECT code AS file, decoy, score, rg FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY score, decoy) AS r FROM dec) WHERE r <= floor(n * 25 / 100)", DECOYS)
def pare_top_percent(t):
    return summary.pare_top_percent(_decoys(t).withColumnRenamed("code", "file"))


@query("SELECT DISTINCT domain, start, pdb, chain FROM (SELECT *, rank() OVER (PARTITION BY domain ORDER BY start DESC) AS r FROM regions) WHERE r = 1")
def latest_version(t):
    return summary.at_extreme(t.regions, "domain", "start").select("domain", "start", "pdb", "chain").distinct()


@query("SELECT DISTINCT domain, start, pdb, chain FROM (SELECT *, rank() OVER (PARTITION BY domain ORDER BY start) AS r FROM regions) WHERE r = 1")
def oldest_version(t):
    return summary.at_extreme(t.regions, "domain", "start", False).select("domain", "start", "pdb", "chain").distinct()


@query("SELECT o_custkey AS protein, round(avg(coalesce(r, 0)), 8) AS coverage FROM orders LEFT JOIN (SELECT l_orderkey, max(l_discount) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def structure_coverage(t):
    d = t.read("orders").select(F.col("o_custkey").alias("protein"), F.col("o_orderkey").alias("domain"))
    return summary.structure_coverage(d, t.read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("domain"), F.col("l_discount").alias("ratio"))).withColumn("coverage", F.round("coverage", 8))


@query("SELECT domain, acc AS astral, score / 105 AS probability FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, acc) AS r FROM (SELECT DISTINCT domain, acc, score FROM scored)) WHERE r = 1 AND score / 105 >= 0.8")
def best_astral(t):
    return summary.best_astral(t.scored.select("domain", F.col("acc").alias("astral"), (F.col("score") / 105).alias("probability")).distinct())


@query("SELECT domain, entity AS convergence, acc AS center FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, entity, acc) AS r FROM (SELECT DISTINCT domain, entity, acc, score FROM scored)) WHERE r = 1")
def representative_center(t):
    return summary.representative_center(t.scored.select("domain", F.col("entity").alias("convergence"), F.col("acc").alias("center"), F.col("score").alias("size")).distinct())


@query("SELECT cluster, probability, brand AS model FROM (SELECT o_custkey AS cluster, max(o_totalprice) AS probability, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders GROUP BY 1) JOIN parts ON partkey = k")
def cluster_best_model(t):
    calls = t.read("orders").select(F.col("o_custkey").alias("cluster"), F.col("o_totalprice").alias("probability"), F.col("o_orderkey").alias("key"))
    return summary.cluster_best_model(calls, t.parts.select(F.col("partkey").alias("key"), F.col("brand").alias("model")))


@query("SELECT grp, round(regr_slope(score, base), 4) AS slope, round(regr_intercept(score, base), 4) AS intercept FROM scored GROUP BY 1")
def fit_line(t):
    return summary.fit_line(t.scored, "base", "score", "grp").withColumns({c: F.round(c, 4) for c in ("slope", "intercept")})


@query("SELECT cluster, predicted, actual, probability, zscore AS score FROM (SELECT o_custkey AS cluster, l_partkey AS predicted, round(avg(o_totalprice), 4) AS probability FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) JOIN (SELECT c_custkey AS cluster, c_nationkey * 3 AS actual FROM customer) USING (cluster) LEFT JOIN pairs ON a = predicted AND b = actual")
def mean_pair_scores(t):
    calls = t.read("orders").join(t.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("cluster"), F.col("l_partkey").alias("sccs"), F.col("o_totalprice").alias("probability"))
    truth = t.read("customer").select(F.col("c_custkey").alias("cluster"), (F.col("c_nationkey") * 3).alias("actual"))
    scores = t.pairs.select(F.col("a").alias("predicted"), F.col("b").alias("actual"), F.col("zscore").alias("score"))
    return summary.mean_pair_scores(calls, truth, scores).withColumn("probability", F.round("probability", 4))


ERR = {"err": "SELECT l_partkey AS s, l_suppkey * 3 AS a, l_discount AS p, l_quantity AS pz, l_linenumber * 8.0 AS nz FROM lineitem WHERE l_linestatus = 'O'", "near": "SELECT DISTINCT least(l_partkey, l_suppkey * 3) AS x, greatest(l_partkey, l_suppkey * 3) AS y FROM lineitem WHERE l_linestatus = 'F'"}


@query(
    """SELECT bin, count(*) FILTER (isnew) AS new_class, count(*) FILTER (NOT isnew AND isnear) AS continuous, count(*) FILTER (NOT isnew AND NOT isnear AND pz > nz) AS model_error, count(*) FILTER (NOT isnew AND NOT isnear AND NOT pz > nz) AS decoy_error FROM (
    SELECT floor(p / 0.03)::INT AS bin, a % 7 = 0 AS isnew, (least(s, a), greatest(s, a)) IN (SELECT (x, y) FROM near) AS isnear, pz, nz FROM err WHERE s <> a) GROUP BY 1""",
    ERR,
)
def error_categories(t):
    li = t.read("lineitem")
    calls = li.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("sccs"), (F.col("l_suppkey") * 3).alias("actual"), F.col("l_discount").alias("probability"), F.col("l_quantity").alias("pred_z"), (F.col("l_linenumber") * 8.0).alias("native_z"))
    known = calls.select(F.col("actual").alias("sccs")).where("sccs % 7 <> 0").distinct()
    return summary.error_categories(calls, known, li.where("l_linestatus = 'F'").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") * 3).alias("b")), 0.03)


@query("SELECT query, min(o_orderdate) AS \"first\", min(o_orderdate) < TIMESTAMP '1996-01-01' AS contaminated FROM hits JOIN orders ON o_orderkey = hit GROUP BY 1")
def min_date_flag(t):
    return summary.min_date_flag(t.hits, t.read("orders").select(F.col("o_orderkey").alias("hit"), F.col("o_orderdate").alias("day")), F.lit("1996-01-01").cast("timestamp"))


@query("SELECT DISTINCT partkey AS structure FROM calls WHERE experiment = 5")
def structure_keys(t):
    return summary.structure_keys(t.calls.withColumn("structure", F.col("partkey")), 5)


@query("SELECT grp, sum(size)::BIGINT AS size FROM (SELECT CASE method WHEN 'psiblast' THEN 'psi' WHEN 'fold_recognition' THEN 'fr' ELSE 'mcm' END AS grp, size FROM calls) GROUP BY CUBE (grp)")
def yield_cube(t):
    return summary.by_group(t.calls)


# Columns and sites.

ALIGNED = {"al": "SELECT doc_id AS protein, replace(text, ' ', '-') AS aligned FROM documents", "cols": "SELECT protein, pos AS col, ch AS letter, row_number() OVER (PARTITION BY protein ORDER BY pos)::INT AS residue FROM (SELECT protein, unnest(string_split(aligned, '')) AS ch, unnest(range(len(aligned)))::INT AS pos FROM al) WHERE ch NOT IN ('-', '')"}


#: Documents whose letters a task writes out, about.
DOCUMENTS = 5000


def _columns(t):
    docs = t.read("documents")  # dealt by number, since files may have few parts that can be read on their own
    docs = docs.repartition(tasks(t.spark, docs.count(), DOCUMENTS), "doc_id")
    return columns.residue_columns(docs.select(F.col("doc_id").alias("protein"), F.replace("text", F.lit(" "), F.lit("-")).alias("aligned")))


@query("SELECT protein, residue, col, letter FROM cols", ALIGNED)
def residue_columns(t):
    return _columns(t)


@query("SELECT protein AS domain, residue - 4 AS residue, col FROM cols WHERE residue BETWEEN 5 AND 20", ALIGNED)
def domain_residue_columns(t):
    regions = t.read("documents").select(F.col("doc_id").alias("protein"), F.col("doc_id").alias("domain"), F.lit(5).alias("start"), F.lit(20).alias("stop"))
    return columns.domain_residue_columns(_columns(t), regions)


@query("SELECT o_custkey AS alignment, col, row_number() OVER (PARTITION BY o_custkey ORDER BY col) - 1 AS culled_col FROM (SELECT DISTINCT o_custkey FROM orders), range(30) r(col) WHERE (o_custkey, col) NOT IN (SELECT (o_custkey, o_orderkey % 30) FROM orders)")
def culled_columns_map(t):
    o = t.read("orders")
    lengths = o.select(F.col("o_custkey").alias("alignment"), F.lit(30).cast("long").alias("n")).distinct()
    return columns.culled_columns_map(lengths, o.select(F.col("o_custkey").alias("alignment"), (F.col("o_orderkey") % 30).alias("col")))


@query("SELECT alignment, res_no - 1 AS residue, CASE WHEN NOT sg THEN seed_no - 1 END AS seed_col FROM (SELECT alignment, sg, tg, sum((NOT sg)::INT) OVER w AS seed_no, sum((NOT tg)::INT) OVER w AS res_no FROM (SELECT l_orderkey AS alignment, l_linenumber AS col, bool_and(l_discount > 0.03) AS sg, bool_and(l_tax > 0.04) AS tg FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY alignment ORDER BY col)) WHERE NOT tg")
def seed_column_map(t):
    c = t.read("lineitem").groupBy(F.col("l_orderkey").alias("alignment"), F.col("l_linenumber").alias("col")).agg(F.bool_and(F.col("l_discount") > 0.03).alias("seed_gap"), F.bool_and(F.col("l_tax") > 0.04).alias("target_gap"))
    return columns.seed_column_map(c)


COORDS = {"xyz": "SELECT label AS structure, vec_id AS residue, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"}


def _coords(t):
    e = t.read("embeddings")
    return e.select(F.col("label").alias("structure"), F.col("vec_id").alias("residue"), *[F.get("embedding", F.lit(i)).cast("double").alias(k) for i, k in enumerate("xyz")])


@query("SELECT a.structure, 0 AS set_id, round(avg(1 / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 6) AS mean_inverse, count(*) AS pairs FROM xyz a JOIN xyz b ON a.structure = b.structure AND a.residue < b.residue GROUP BY 1", COORDS)
def inverse_distance(t):
    c = _coords(t)
    return columns.inverse_distance(c, c.select("structure", F.lit(0).alias("set_id"), "residue")).withColumn("mean_inverse", F.round("mean_inverse", 6))


INVERSE = "avg(1 / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)))"
SETS = COORDS | {
    "site": "SELECT structure, residue FROM xyz WHERE x > 0.1 AND y > 0",
    "size": "SELECT structure, count(*) AS k FROM site GROUP BY 1",
    "sets": f"SELECT structure, 0 AS set_id, residue FROM site UNION ALL SELECT structure, set_id, residue FROM (SELECT *, row_number() OVER (PARTITION BY structure, set_id ORDER BY {draw_sql(1, 'structure', 'set_id', 'residue')}, residue) AS r FROM (SELECT structure, residue, k, unnest(range(1, 21)) AS set_id FROM xyz JOIN size USING (structure))) WHERE r <= k",
    "placed": "SELECT * FROM sets JOIN xyz USING (structure, residue)",
    "means": f"SELECT a.structure, a.set_id, {INVERSE} AS m FROM placed a JOIN placed b ON a.structure = b.structure AND a.set_id = b.set_id AND a.residue < b.residue GROUP BY 1, 2",
}


@query("SELECT t.structure, round(t.m, 6) AS target, round(avg((s.m <= t.m)::INT), 6) AS percentile FROM means t JOIN means s ON s.structure = t.structure AND s.set_id > 0 WHERE t.set_id = 0 GROUP BY t.structure, t.m", SETS)
def site_clustering(t):
    c = _coords(t)
    out = columns.site_clustering(c, c.where("x > 0.1 and y > 0").select("structure", "residue"), 20, 1)
    return out.withColumns({k: F.round(k, 6) for k in ("target", "percentile")})


MATRIX = {"mat": "SELECT k.x AS known, l.x AS letter, CASE WHEN k.x = l.x THEN 4.0 ELSE 1.0 - abs(ascii(k.x) - ascii(l.x)) END::DOUBLE AS s FROM (SELECT unnest(['A', 'N', 'R']) AS x) k, (SELECT unnest(['F', 'O', 'A']) AS x) l", "sites": "SELECT l_suppkey AS structure, l_orderkey * 10 + l_linenumber AS residue, min(l_returnflag) AS known, min(CASE WHEN l_quantity < 5 THEN '-' ELSE l_linestatus END) AS letter FROM lineitem GROUP BY 1, 2"}


@query(
    "SELECT structure, sum(v) AS score, coalesce(list_sort(list(residue) FILTER (v > 0 AND letter <> known)), []) AS conserved, coalesce(list_sort(list(residue) FILTER (letter = known)), []) AS identical FROM (SELECT *, CASE WHEN letter = '-' THEN -0.5::DOUBLE ELSE coalesce(s, 0.0::DOUBLE) END AS v FROM sites LEFT JOIN mat USING (known, letter)) GROUP BY 1",
    MATRIX,
)
def important_residue_score(t):
    sites = t.read("lineitem").groupBy(F.col("l_suppkey").alias("structure"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("residue")).agg(F.min("l_returnflag").alias("known"), F.min(F.when(F.col("l_quantity") < 5, "-").otherwise(F.col("l_linestatus"))).alias("letter"))
    s = t.spark
    matrix = s.createDataFrame([(k, x, 4.0 if k == x else 1.0 - abs(ord(k) - ord(x))) for k in "ANR" for x in "FOA"], "known string, letter string, s double")
    return columns.important_residue_score(sites, matrix)
