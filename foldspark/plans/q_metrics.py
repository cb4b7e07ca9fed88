"""Queries of the co-occurrence metrics, prediction and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators import enrich, metrics, predict
from foldspark.plans.adapters import Tables, draw_sql
from foldspark.plans.queries import query
from foldspark.sources.tables import settled

T = "1e-7"
FREQ = {
    "freq": "SELECT predictor AS acc, NULL AS acc2, count(*) AS metric FROM predictors GROUP BY 1 UNION ALL SELECT a.predictor, b.predictor, count(*) FROM predictors a JOIN predictors b USING (cluster_id) GROUP BY 1, 2",
    "base": "SELECT acc, metric FROM freq WHERE acc2 IS NULL",
    "total": "SELECT metric AS n FROM base WHERE acc = 'all'",
    "wide": "SELECT f.acc, f.acc2, f.metric, a.metric AS base, b.metric AS base2, n AS total FROM freq f JOIN base a ON a.acc = f.acc JOIN base b ON b.acc = f.acc2, total WHERE f.acc2 IS NOT NULL",
}
PROB = FREQ | {
    "prob": f"SELECT acc, NULL AS acc2, metric / (n + {T}) AS metric FROM base, total UNION ALL SELECT acc, acc2, (metric / (base + {T}) * metric + 2 * base2 / (total + {T})) / (metric + 2 + {T}) FROM wide",
    "pbase": "SELECT acc, metric FROM prob WHERE acc2 IS NULL",
    "pw": f"SELECT acc, acc2, metric, base, base2, CASE WHEN base2 - metric * base <= {T} THEN {T} ELSE (base2 - metric * base) / (1 - base) END AS other FROM (SELECT p.acc, p.acc2, p.metric, a.metric AS base, b.metric AS base2 FROM prob p JOIN pbase a ON a.acc = p.acc JOIN pbase b ON b.acc = p.acc2 WHERE p.acc2 IS NOT NULL)",
}
LR = PROB | {"lr": f"SELECT acc, acc2, ln(metric / (1 - metric + {T}) + {T}) AS metric FROM prob WHERE acc2 IS NULL UNION ALL SELECT acc, acc2, ln(metric / (other + {T}) + {T}) FROM pw"}
MI = LR | {"mi": f"SELECT acc, acc2, base * metric * ln(base * metric / (base * base2 + {T}) + {T}) + other * (1 - base) * ln(other * (1 - base) / ((1 - base) * base2 + {T}) + {T}) AS metric FROM pw"}


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def _prob(t: Tables) -> DataFrame:
    return settled(metrics.probability(metrics.frequency(t.predictor_rows), 2.0))  # a table of its own, used many times


def _r(cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols.split())


@query("SELECT acc, acc2, metric FROM freq", FREQ)
def frequency(t):
    return metrics.frequency(t.predictor_rows)


@query("SELECT acc, acc2, base - metric AS a_not_b, base2 - metric AS not_a_b, total - base - base2 + metric AS not_a_not_b FROM wide", FREQ)
def frequency_not(t):
    return metrics.frequency_not(metrics.frequency(t.predictor_rows))


@query(f"SELECT acc, acc2, {_r('metric')} FROM prob", PROB)
def probability(t):
    return rounded(_prob(t), "metric")


@query("SELECT acc, acc2, round(1 - base, 6) AS p_not_a, round(1 - metric, 6) AS p_not_b_a, round(other, 6) AS p_b_not_a FROM pw", PROB)
def probability_not(t):
    return rounded(metrics.probability_not(_prob(t)), "p_not_a", "p_not_b_a", "p_b_not_a")


@query(f"SELECT acc, acc2, {_r('metric', 5)} FROM lr", LR)
def log_ratio(t):
    return rounded(metrics.log_ratio(_prob(t)), "metric", places=5)


@query(f"SELECT acc, acc2, {_r('metric')} FROM mi", MI)
def mutual_information(t):
    return rounded(metrics.mutual_information(_prob(t)), "metric")


@query(f"SELECT a.predictor AS acc, b.predictor AS acc2, round(coalesce(f.metric, 0), 6) AS metric FROM (SELECT DISTINCT predictor FROM predictors) a, (SELECT DISTINCT predictor FROM predictors) b LEFT JOIN mi f ON f.acc = a.predictor AND f.acc2 = b.predictor", MI)
def metric_lookup(t):
    p = t.predictors.select("predictor").distinct()
    grid = p.withColumnRenamed("predictor", "acc").crossJoin(F.broadcast(p.withColumnRenamed("predictor", "acc2")))  # brands and kinds: 31 at any size
    return rounded(metrics.metric_lookup(grid, metrics.mutual_information(_prob(t)), 0.0), "metric")


@query(f"SELECT acc, acc2, {_r('metric')} FROM prob WHERE acc = 'ECONOMY' AND acc2 IS NOT NULL", PROB)
def metrics_given(t):
    return rounded(metrics.metrics_given(_prob(t), "ECONOMY"), "metric")


@query("SELECT p.acc2, round(p.metric, 6) AS metric FROM prob p JOIN prob q ON q.acc = 'all' AND q.acc2 = p.acc2 AND q.metric <= 0.2 WHERE p.acc = 'ECONOMY'", PROB)
def superfamily_profile(t):
    return rounded(metrics.superfamily_profile(_prob(t), "ECONOMY", 0.2), "metric")


@query(
    """SELECT entity, func, term, round(mi, 6) AS mi FROM (
    SELECT e.cluster_id AS entity, f.func, e.predictor AS term, coalesce(m.metric, 0) AS mi, row_number() OVER (PARTITION BY e.cluster_id, f.func ORDER BY coalesce(m.metric, 0) DESC, e.predictor DESC) AS rn
    FROM (SELECT * FROM predictors WHERE predictor LIKE 'Brand%') e, (SELECT DISTINCT kind AS func FROM parts) f LEFT JOIN mi m ON m.acc = f.func AND m.acc2 = e.predictor) WHERE rn = 1""",
    MI,
)
def featured_term(t):
    entities = t.predictors.where("predictor like 'Brand%'").select(F.col("cluster_id").alias("entity"), F.col("predictor").alias("term"))
    return rounded(metrics.featured_term(entities, t.parts.select(F.col("kind").alias("func")).distinct(), settled(metrics.mutual_information(_prob(t)))), "mi")


@query(
    """SELECT acc, acc_b, CASE WHEN va * vb > 1e-15 THEN round((swpq / sw - ma * mb) / sqrt(va * vb), 4) END AS corr, shared, total FROM (
    SELECT *, swp / sw AS ma, swq / sw AS mb, swpp / sw - (swp / sw) * (swp / sw) AS va, swqq / sw - (swq / sw) * (swq / sw) AS vb FROM (
      SELECT a.acc, b.acc AS acc_b, sum(w) AS sw, sum(w * p) AS swp, sum(w * q) AS swq, sum(w * p * q) AS swpq, sum(w * p * p) AS swpp, sum(w * q * q) AS swqq, count(*) FILTER (p > 0 AND q > 0) AS shared, count(*) FILTER (p > 0 OR q > 0) AS total
      FROM (SELECT DISTINCT brand AS acc FROM parts) a, (SELECT DISTINCT brand AS acc FROM parts) b, (SELECT acc AS f, metric AS w FROM prob WHERE acc2 IS NULL AND acc <> 'all') f,
      LATERAL (SELECT coalesce(max(metric), 0) AS p FROM prob WHERE acc = a.acc AND acc2 = f.f), LATERAL (SELECT coalesce(max(metric), 0) AS q FROM prob WHERE acc = b.acc AND acc2 = f.f)
      WHERE a.acc < b.acc AND (p > 0 OR q > 0) GROUP BY 1, 2)) WHERE shared > 0""",
    PROB,
)
def profile_correlation(t):
    brands = t.parts.select(F.col("brand").alias("acc")).distinct()
    functions = t.predictors.where("predictor <> 'all'").select(F.col("predictor").alias("acc2")).distinct()
    return rounded(metrics.profile_correlation(_prob(t), brands, functions), "corr", places=4)


ENRICHED = {
    "f": "SELECT DISTINCT l_orderkey AS query, brand AS feature, min(kind) OVER (PARTITION BY l_orderkey, brand) AS description, l_orderkey % 10 = 0 AS own FROM lineitem JOIN parts ON l_partkey = partkey",
    "counts": "SELECT feature, count(*) AS background, count(*) FILTER (own) AS foreground, min(description) AS description FROM f GROUP BY 1",
    "sums": "SELECT sum(background) AS total, sum(foreground) AS chosen, count(*) AS features FROM counts",
}


def _features(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.read("lineitem").join(t.parts, F.col("l_partkey") == F.col("partkey")).select(F.col("l_orderkey").alias("query"), F.col("brand").alias("feature"), F.col("kind").alias("description"))
    return rows, t.read("lineitem").where("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("query"))


def _counted(t: Tables) -> DataFrame:
    return enrich.count_features(*_features(t), rows=t.read("lineitem").count())


@query("SELECT * FROM counts", ENRICHED)
def count_features(t):
    return _counted(t)


@query("SELECT method AS superfamily, count(*) AS total, count(*) FILTER (method = 'psiblast') AS psiblast, count(*) FILTER (method = 'fold_recognition') AS fold_recognition, count(*) FILTER (method NOT IN ('psiblast', 'fold_recognition')) AS other FROM calls GROUP BY 1")
def count_by_method(t):
    return enrich.count_by_method(t.calls.withColumn("superfamily", F.col("method")))


@query("SELECT feature, n, round(n / (SELECT sum(n) FROM c), 8) AS share FROM c", ENRICHED | {"c": "SELECT feature, background + CASE WHEN feature = 'Brand#1' THEN 2 ELSE 0 END AS n FROM counts"})
def pseudo_proportion(t):
    counts = settled(_counted(t).select("feature", F.col("background").alias("n")))
    return rounded(enrich.proportion(enrich.pseudo_count(counts, counts.where("feature = 'Brand#1'"), 2)), "share", places=8)


@query("SELECT feature, round(ln((foreground / chosen) / (background / total)), 6) AS score FROM counts, sums", ENRICHED)
def enrichment_score(t):
    counts = settled(_counted(t))  # a row a feature, read twice for each share
    own, back = (enrich.proportion(counts.select("feature", F.col(c).alias("n"))) for c in ("foreground", "background"))
    return rounded(enrich.enrichment_score(own, back), "score")


FISHER = ENRICHED | {
    "cells": "SELECT *, foreground AS a, background - foreground AS b, chosen - foreground AS c, total - (background - foreground) AS d FROM counts, sums",
    "tested": "SELECT feature, background, foreground, description, features, list_sum(list_transform(range(a::BIGINT, (least(a + b, a + c) + 1)::BIGINT), lambda x: exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)))) AS p FROM cells",
}


@query("SELECT feature, background, foreground, description, round(p, 6) AS p, round(p * features, 5) AS corrected FROM tested", FISHER)
def fisher_greater(t):
    return enrich.fisher_greater(settled(_counted(t))).withColumns({"p": F.round("p", 6), "corrected": F.round("corrected", 5)})


@query(
    "SELECT feature, background, foreground, round(p, 6) AS p, round(p * features, 5) AS corrected, round(ln((foreground / chosen) / ((background + 1) / (total + features))), 6) AS score FROM tested, (SELECT chosen, total FROM sums)",
    FISHER,
)
def enrichment(t):
    return enrich.enrichment(*_features(t), rows=t.read("lineitem").count()).withColumns({"p": F.round("p", 6), "corrected": F.round("corrected", 5), "score": F.round("score", 6)})


@query(f"SELECT query, iteration FROM (SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY {draw_sql(0, 'iteration', 'query')}, query) AS r FROM (SELECT o_orderkey AS query, unnest(range(5))::INT AS iteration FROM (SELECT DISTINCT o_orderkey FROM orders))) WHERE r <= 100")
def background_resample(t):
    return enrich.background_resample(t.read("orders").select(F.col("o_orderkey").alias("query")), 100, 5)


STRUCT = {"st": "SELECT DISTINCT l_orderkey AS domain, brand AS sccs, l_discount AS p FROM lineitem JOIN parts ON l_partkey = partkey"}


def _structures(t: Tables) -> DataFrame:
    return t.read("lineitem").join(t.parts, F.col("l_partkey") == F.col("partkey")).select(F.col("l_orderkey").alias("domain"), F.col("brand").alias("sccs"), F.col("l_discount").alias("p")).distinct()


@query("SELECT domain, sccs, round(1 - product(1 - p), 8) AS p FROM st GROUP BY 1, 2", STRUCT)
def combine_superfamily(t):
    return rounded(predict.combine_superfamily(_structures(t)), "p", places=8)


@query("SELECT domain, set_id, sccs, p FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY p DESC, sccs) AS set_id FROM st) WHERE set_id = 1", STRUCT)
def structure_sets_best(t):
    return predict.structure_sets(_structures(t), "best")


PREDICT = MI | STRUCT | {
    "fn": "SELECT acc AS func, metric AS base_llr FROM lr WHERE acc2 IS NULL AND metric < 0 AND acc NOT LIKE 'Brand%'",
    "best_st": "SELECT domain, sccs, p FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY p DESC, sccs) AS r FROM st) WHERE r = 1",
    "dom": "SELECT DISTINCT o_orderkey AS domain, o_custkey AS parent FROM orders JOIN best_st ON domain = o_orderkey",
    "pt": "SELECT DISTINCT o_custkey AS entity, kind AS term FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN parts ON partkey = l_partkey WHERE l_returnflag = 'R'",
    "lt": "SELECT DISTINCT o_custkey AS entity, brand AS term FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN parts ON partkey = l_partkey WHERE l_returnflag = 'A'",
    "lf": "SELECT parent, func, term AS l_acc FROM (SELECT entity AS parent, func, term, row_number() OVER (PARTITION BY entity, func ORDER BY coalesce(m.metric, 0) DESC, term DESC) AS r FROM lt CROSS JOIN fn LEFT JOIN mi m ON m.acc = func AND m.acc2 = term) WHERE r = 1",
    "pf": "SELECT parent, func, term AS p_acc FROM (SELECT entity AS parent, func, term, row_number() OVER (PARTITION BY entity, func ORDER BY coalesce(m.metric, 0) DESC, term DESC) AS r FROM pt CROSS JOIN fn LEFT JOIN mi m ON m.acc = func AND m.acc2 = term) WHERE r = 1",
    "raw": "SELECT d.domain, d.parent, func, base_llr, p_acc, CASE WHEN p_acc IS NULL THEN 0 ELSE coalesce(lp.metric, ln(1e-7)) END AS p, l_acc, CASE WHEN l_acc IS NULL THEN 0 ELSE coalesce(ll.metric, ln(1e-7)) END AS l, s.p * coalesce(ls.metric, ln(1e-7)) AS s FROM dom d JOIN best_st s USING (domain) CROSS JOIN fn LEFT JOIN pf USING (parent, func) LEFT JOIN lf USING (parent, func) LEFT JOIN lr lp ON lp.acc = func AND lp.acc2 = p_acc LEFT JOIN lr ll ON ll.acc = func AND ll.acc2 = l_acc LEFT JOIN lr ls ON ls.acc = func AND ls.acc2 = s.sccs",
}


@query(
    """SELECT domain, parent, 1 AS set_id, func, round(base_llr + p, 4) AS p_llr, round(base_llr + l, 4) AS l_llr, round(base_llr + s, 4) AS s_llr, round(base_llr + p + l, 4) AS pl_llr, round(base_llr + p + s, 4) AS ps_llr,
    round(base_llr + l + s, 4) AS ls_llr, round(base_llr + p + l + s, 4) AS pls_llr, round(base_llr, 4) AS base_llr, p_acc, l_acc FROM raw WHERE base_llr + p + l + s >= -12""",
    PREDICT,
)
def predict_functions(t):
    # The one join of lines with parts, read four times; rows may repeat where they become sets.
    lines = settled(t.read("lineitem").join(t.parts, F.col("l_partkey") == F.col("partkey")).select(F.col("l_orderkey").alias("cluster_id"), "brand", "kind", F.col("l_discount").alias("p"), F.col("l_returnflag").alias("flag")))
    prob = settled(metrics.probability(metrics.frequency(lines.select("cluster_id", F.explode(F.array("brand", "kind", F.lit("all"))).alias("predictor"))), 2.0))
    lr, mi = settled(metrics.log_ratio(prob)), settled(metrics.mutual_information(prob))
    lr = lr.where("acc2 is not null or acc not like 'Brand%'")
    alike = lines.select(F.col("cluster_id").alias("domain"), F.col("brand").alias("sccs"), "p").repartition(t.tasks("lineitem"), "domain").distinct()
    structures = predict.structure_sets(alike, "best")
    domains = t.read("orders").select(F.col("o_orderkey").alias("domain"), F.col("o_custkey").alias("parent"))
    rows = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("entity")).join(lines, F.col("o_orderkey") == F.col("cluster_id"))
    process, localisation = (rows.where(F.col("flag") == flag).select("entity", F.col(c).alias("term")) for flag, c in (("R", "kind"), ("A", "brand")))
    out = predict.predict_functions(domains, structures, process, localisation, lr, mi)
    return rounded(out, *predict.SCORES, places=4)


@query(
    "SELECT domain, acc AS func, score AS pls_llr, entity AS set_id FROM (SELECT *, row_number() OVER (PARTITION BY domain, acc ORDER BY score DESC, entity) AS r FROM (SELECT DISTINCT domain, acc, score, entity FROM scored)) WHERE r = 1"
)
def best_per_function(t):
    rows = t.scored.select("domain", F.col("acc").alias("func"), F.col("score").alias("pls_llr"), F.col("entity").alias("set_id")).distinct()
    return predict.best_per_function(rows)
