"""Queries of readers and writers: files in the formats' shapes are written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions import scalar
from foldspark.operators import columns, metrics, predict, structure, summary
from foldspark.plans.adapters import Tables
from foldspark.plans.queries import query
from foldspark.sources import readers, tables


def _stored(t: Tables, rows: DataFrame, line: Column) -> str:
    """The path of a text file with a line a row."""
    path = tables.step_path(t.spark)
    rows.select(line.alias("value")).write.text(path)
    return path


def _named(t: Tables) -> DataFrame:
    """id, sequence (letters of the type and the brand)."""
    return t.parts.select(F.concat(F.lit("p"), F.col("partkey")).alias("id"), F.regexp_replace(F.concat("kind", "brand", "kind"), "[^A-Za-z]", "").alias("sequence"))


NAMED = {"named": "SELECT 'p' || partkey AS id, regexp_replace(kind || brand || kind, '[^A-Za-z]', '', 'g') AS sequence FROM parts"}


@query("SELECT id || '|x' AS id, id || '|x a record' AS description, upper(sequence) AS sequence FROM named", NAMED)
def fasta_round_trip(t):
    path = tables.step_path(t.spark)
    readers.write_fasta(_named(t), path, lambda: F.concat("id", F.lit("|x a record")))
    return readers.read_fasta(t.spark, path)


@query("SELECT id, id AS description, sequence FROM named", NAMED)
def fasta_in_parts(t):
    path = tables.step_path(t.spark)
    readers.split_fasta(_named(t), path, 5)
    return readers.read_fasta(t.spark, path)


@query("SELECT partkey, 0::BIGINT AS gi, 'sp' AS db, 'P' || partkey AS ac, 'X_' || size AS ac2, brand AS gene, 'X_' || size || ' ' || kind || ' GN=' || brand AS about, brand AS named FROM parts")
def fasta_headers(t):
    head = F.concat(F.lit("sp|P"), F.col("partkey"), F.lit("|X_"), F.col("size"), F.lit(" "), F.col("kind"), F.lit(" GN="), F.col("brand"))
    rows = readers.parse_fasta_header(t.parts.select("partkey", head.alias("description")), "uniprot")
    return rows.select("partkey", "gi", "db", "ac", "ac2", "gene", "about", scalar.gene_name("description").alias("named"))


@query("SELECT DISTINCT l_partkey::VARCHAR AS source, l_suppkey::VARCHAR AS compared, l_quantity::DOUBLE AS score FROM lineitem")
def score_triples(t):
    rows = t.read("lineitem").select("l_partkey", "l_suppkey", "l_quantity").distinct()
    return readers.read_score_triples(t.spark, _stored(t, rows, F.concat_ws("  ", "l_partkey", "l_suppkey", "l_quantity")))


@query("SELECT DISTINCT l_partkey AS prediction_id, l_suppkey AS experiment_id, l_quantity::DOUBLE AS zscore FROM lineitem")
def score_dump(t):
    rows = t.read("lineitem").select("l_partkey", "l_suppkey", "l_quantity").distinct()
    return readers.read_score_dump(t.spark, _stored(t, rows, F.concat_ws(",", "l_partkey", "l_suppkey", "l_quantity", F.lit("rest"))), "B")


@query("SELECT query::VARCHAR AS query, hit::VARCHAR AS subject, 50.5::DOUBLE AS pct_identity, align_len::INT AS align_len, 1 AS mismatches, 0 AS gaps, line::INT AS q_start, 9 AS q_end, 2 AS s_start, 8 AS s_end, evalue::DOUBLE AS evalue, bits::DOUBLE AS score FROM hits")
def blast_tabular(t):
    line = F.concat_ws("\t", "query", "hit", F.lit("50.5"), F.col("align_len").cast("int"), F.lit("1"), F.lit("0"), "line", F.lit("9"), F.lit("2"), F.lit("8"), "evalue", "bits")
    return readers.read_blast_tabular(t.spark, _stored(t, t.hits, line))


@query(
    "SELECT o_custkey::INT AS cluster_id, (row_number() OVER w - 1)::INT AS entry_num, (o_orderkey % 900 + 100)::INT AS aa_count, 'o' || o_orderkey AS identifier, CASE WHEN row_number() OVER w > 1 THEN 95.5::DOUBLE END AS percent, row_number() OVER w = 1 AS representative FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"
)
def cdhit_clusters(t):
    rows = t.read("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("members"))
    tail = lambda i: F.when(i == 0, F.lit("*")).otherwise(F.lit("at 95.50%"))
    lines = F.transform("members", lambda m, i: F.concat(i, F.lit("\t"), m % 900 + 100, F.lit("aa, >o"), m, F.lit("... "), tail(i)))
    return readers.read_cdhit_clusters(t.spark, _stored(t, rows, F.concat(F.lit(">Cluster "), F.col("o_custkey"), F.lit("\n"), F.array_join(lines, "\n"))))


@query("SELECT brand AS acc, kind AS acc2, size::DOUBLE AS metric FROM parts WHERE size % 3 > 0 AND size % 5 > 0")
def stored_metric(t):
    path = tables.step_path(t.spark)
    name = lambda col, n: F.when(F.col("size") % n == 0, F.concat(F.lit("not "), F.col(col))).otherwise(F.col(col))
    tables.write_metric(t.parts.select(name("brand", 3).alias("acc"), name("kind", 5).alias("acc2"), F.col("size").cast("double").alias("metric")), path)
    return t.spark.read.parquet(path)


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 4 = 1 AND c_custkey % 2 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_stored(t):
    path = tables.step_path(t.spark)
    rows = t.read("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows.write.partitionBy("c_nationkey").parquet(path)
    tables.upsert_stored(t.spark, path, rows.where("c_nationkey % 4 = 1 and c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0).cast(rows.schema["c_acctbal"].dataType)), ["c_custkey"], ["c_nationkey"])
    return t.spark.read.schema(rows.schema).parquet(path)


# Small operators around predictions, clusters and columns.

STRUCTURES = {"st": "SELECT DISTINCT l_orderkey AS domain, brand AS sccs, l_discount AS p FROM lineitem JOIN parts ON l_partkey = partkey"}


def _structures(t: Tables) -> DataFrame:
    return t.read("lineitem").join(t.parts, F.col("l_partkey") == F.col("partkey")).select(F.col("l_orderkey").alias("domain"), F.col("brand").alias("sccs"), F.col("l_discount").alias("p")).distinct()


@query("SELECT domain, 1 AS set_id, sccs, round(1 - product(1 - p), 8) AS p FROM st GROUP BY domain, sccs", STRUCTURES)
def structure_sets_combine(t):
    return predict.structure_sets(_structures(t), "combine").withColumn("p", F.round("p", 8))


@query("SELECT domain, (row_number() OVER (PARTITION BY domain ORDER BY p DESC, sccs))::INT AS set_id, sccs, round(p / 2, 8) AS p FROM st", STRUCTURES)
def structure_sets_split(t):
    return predict.scale_structures(predict.structure_sets(_structures(t), "split").withColumn("scale", F.lit(0.5))).drop("scale").withColumn("p", F.round("p", 8))


@query(
    "SELECT DISTINCT o_custkey AS cluster_id, x.predictor FROM (SELECT o_custkey, l_partkey, l_linenumber = 1 AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey) m JOIN (SELECT partkey, kind AS predictor, FALSE AS of_class FROM parts WHERE partkey % 3 = 0 UNION ALL SELECT partkey, brand, TRUE FROM parts) x ON x.partkey = m.l_partkey AND (NOT of_class OR first) WHERE o_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 3 = 0) AND o_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 7)"
)
def cluster_predictors(t):
    rows = t.read("orders").join(t.read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    members = rows.select(F.col("o_custkey").alias("cluster_id"), F.col("l_partkey").cast("string").alias("identifier"), (F.col("l_linenumber") == 1).alias("representative"))
    p = t.parts.select(F.col("partkey").cast("string").alias("identifier"), "partkey", "kind", "brand")
    return metrics.cluster_predictors(members, p.where("partkey % 3 = 0").select("identifier", F.col("kind").alias("acc")), p.select("identifier", F.col("brand").alias("superfamily")), removed="7")


PREDICTED = {"pred": "SELECT DISTINCT domain, entity AS parent, acc AS func, score - 50 AS pls_llr, score - 30 AS p_llr, -130 * base AS base_llr, grp AS type FROM scored"}


def _predictions(t: Tables) -> DataFrame:
    named = {"pls_llr": F.col("score") - 50, "p_llr": F.col("score") - 30, "base_llr": -130 * F.col("base")}
    rows = t.scored.select("domain", F.col("entity").alias("parent"), F.col("acc").alias("func"), *[v.alias(k) for k, v in named.items()], F.col("grp").alias("type")).distinct()
    return rows.withColumns({s: F.lit(0.0) for s in predict.SCORES if s not in named})


@query("SELECT domain, parent, func, pls_llr, p_llr, base_llr FROM pred WHERE pls_llr >= 5 AND p_llr >= -10 AND base_llr <= -1", PREDICTED)
def filter_predictions(t):
    return predict.filter_predictions(_predictions(t), {"pls_llr": 5.0, "p_llr": -10.0}, -1.0).select("domain", "parent", "func", "pls_llr", "p_llr", "base_llr")


@query("SELECT domain, parent, func, pls_llr, base_llr, brand AS name FROM pred LEFT JOIN (SELECT partkey, brand FROM parts WHERE size > 10) ON partkey = func WHERE base_llr <= -1 AND pls_llr >= 5 AND parent IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9)", PREDICTED)
def prediction_report(t):
    proteins = t.read("supplier").where("s_nationkey < 9").select(F.col("s_suppkey").alias("parent"))
    rows = predict.prediction_report(_predictions(t), proteins, t.parts.where("size > 10").select(F.col("partkey").alias("func"), F.col("brand").alias("name")), -1.0, 5.0)
    return rows.select("domain", "parent", "func", "pls_llr", "base_llr", "name")


@query("SELECT parent, func, type || '_bayes_pls' AS source FROM pred WHERE pls_llr > 0", PREDICTED)
def export_go_rows(t):
    return predict.export_rows(_predictions(t))


@query("SELECT CASE WHEN base_llr > -4 AND base_llr <= 0 THEN 1 WHEN base_llr > -8 AND base_llr <= -4 THEN 2 WHEN base_llr > -13 AND base_llr <= -8 THEN 3 END AS band, count(*) AS n FROM pred GROUP BY 1", PREDICTED)
def bin_specificity(t):
    return _predictions(t).groupBy(predict.specificity().alias("band")).agg(F.count("*").alias("n"))


@query("SELECT domain, sccs, confidence FROM (SELECT l_orderkey AS domain, brand AS sccs, l_discount AS confidence, l_orderkey AS k FROM lineitem JOIN parts ON partkey = l_partkey) LEFT JOIN (SELECT o_orderkey, greatest(0, least(5, 1 + o_custkey % 9) - 2) / 3 AS share FROM orders WHERE o_orderkey % 2 = 0) ON k = o_orderkey WHERE coalesce(share, 1) > 0.75")
def mcm_calls(t):
    calls = t.read("lineitem").join(t.parts, F.col("l_partkey") == F.col("partkey")).select(F.col("l_orderkey").alias("key"), F.col("l_orderkey").alias("domain"), F.col("brand").alias("sccs"), F.col("l_discount").alias("confidence"))
    folds = t.read("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.lit("AHHHB").alias("parent"), F.lit("HHH").alias("folded"), F.lit(0).alias("start"), (F.col("o_custkey") % 9 + 1).alias("stop"))
    return structure.mcm_calls(calls, folds).select("domain", "sccs", "confidence")


@query("SELECT p.l_orderkey AS protein, p.l_linenumber + 5 AS col, p.l_linenumber AS residue, d.domain, s.seqres, s.atom FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) p LEFT JOIN (SELECT o_orderkey, 'd' || o_orderkey AS domain FROM orders WHERE o_orderkey % 2 = 0) d ON d.o_orderkey = p.l_orderkey LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS seqres, max(l_partkey) AS atom FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) s USING (l_orderkey, l_linenumber) WHERE d.domain IS NULL OR p.l_linenumber BETWEEN 2 AND 4")
def column_feature_table(t):
    li = t.read("lineitem")
    cols = li.select(F.col("l_orderkey").alias("protein"), F.col("l_linenumber").alias("residue"), (F.col("l_linenumber") + 5).alias("col")).distinct()
    domains = t.read("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("protein"), F.concat(F.lit("d"), F.col("o_orderkey")).alias("domain"), F.lit(2).alias("start"), F.lit(4).alias("stop"))
    atoms = li.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("protein"), F.col("l_linenumber").alias("residue")).agg(F.min("l_suppkey").alias("seqres"), F.max("l_partkey").alias("atom"))
    return columns.column_features(cols, atoms, domains)


@query("SELECT key, o, CASE WHEN length(replace(s, '-', '')) > 0 THEN 100 * len(list_filter(range(1, length(s) + 1), lambda i: s[i] = f[i] AND s[i] <> '-')) // length(replace(s, '-', '')) END::INT AS identity FROM (SELECT *, first(s) OVER (PARTITION BY key ORDER BY o) AS f FROM (SELECT size AS key, partkey AS o, replace(lpad(brand, 10, '-'), 'r', '-') AS s FROM parts))")
def percent_identity(t):
    rows = t.parts.select(F.col("size").alias("key"), F.col("partkey").alias("o"), F.replace(F.lpad("brand", 10, "-"), F.lit("r"), F.lit("-")).alias("s"))
    return scalar.percent_identity(rows, "key", "o", "s")


@query("SELECT DISTINCT domain, stop, pdb FROM (SELECT *, rank() OVER (PARTITION BY domain ORDER BY stop DESC) AS r FROM regions) WHERE r = 1")
def latest_model(t):
    return summary.at_extreme(t.regions, "domain", "stop").select("domain", "stop", "pdb").distinct()


@query("SELECT sequence, structure, p FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY p DESC, structure) AS r FROM (SELECT l_orderkey AS sequence, l_partkey AS structure, max(l_discount) AS p FROM lineitem GROUP BY 1, 2)) WHERE r <= 2")
def top_structures_per_sequence(t):
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("sequence"), F.col("l_partkey").alias("structure")).agg(F.max("l_discount").alias("p"))
    return summary.top_n(rows, "sequence", 2, F.col("p").desc(), "structure")
