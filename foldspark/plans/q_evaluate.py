"""Queries of evaluation: labels, curves, coverage, ranks, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.operators import evaluate
from foldspark.plans.adapters import draw_sql
from foldspark.plans.queries import query

CURVE = {
    "by_score": "SELECT score, count(*) AS n, count(*) FILTER (label > 0) AS hits FROM scored GROUP BY 1",
    "curve": "SELECT score, sum(n) OVER w AS n, sum(hits) OVER w AS hits, sum(n) OVER () AS an, sum(hits) OVER () AS ah FROM by_score WINDOW w AS (ORDER BY score DESC)",
    "pr": "SELECT score, n, hits, hits / n AS precision, hits / ah AS recall, n / an AS rate FROM curve",
    "gcurve": "SELECT grp, score, sum(n) OVER w AS n, sum(hits) OVER w AS hits FROM (SELECT grp, score, count(*) AS n, count(*) FILTER (label > 0) AS hits FROM scored GROUP BY 1, 2) WINDOW w AS (PARTITION BY grp ORDER BY score DESC)",
    "th": "SELECT grp, coalesce(min(score) FILTER (hits / n >= 0.25 AND n > 99), 100.0) AS threshold FROM gcurve GROUP BY 1",
}


@query(
    "WITH tr AS (SELECT DISTINCT o_custkey % 100 AS entity, l_partkey AS acc FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45) SELECT DISTINCT s.entity, s.acc, s.score, CASE WHEN tr.acc IS NULL THEN -1 ELSE 1 END AS label FROM scored s LEFT JOIN tr USING (entity, acc) UNION SELECT entity, acc, -99.0, 1 FROM tr WHERE (entity, acc) NOT IN (SELECT (entity, acc) FROM scored)".replace("WITH tr AS (", "SELECT * FROM (WITH tr AS (", 1)
    + ")"
)
def label_predictions(t):
    truth = t.read("orders").join(t.read("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 100).alias("entity"), F.col("l_partkey").alias("acc"))
    return evaluate.label_predictions(t.scored, truth, unannotated=True)


@query("SELECT score, n::BIGINT AS n, hits::BIGINT AS hits, round(precision, 8) AS precision, round(recall, 8) AS recall, round(rate, 8) AS rate FROM pr", CURVE)
def precision_recall(t):
    return evaluate.precision_recall(t.scored).withColumns({c: F.round(c, 8) for c in ("precision", "recall", "rate")})


@query("SELECT * FROM th", CURVE)
def precision_threshold(t):
    return evaluate.precision_threshold(evaluate.precision_recall(t.scored, ["grp"]), 0.25, ["grp"])


@query("SELECT round(coalesce(max(recall) FILTER (precision >= 0.3), 0), 8) AS recall FROM pr", CURVE)
def recall_at_precision(t):
    return evaluate.recall_at_precision(evaluate.precision_recall(t.scored), 0.3).withColumn("recall", F.round("recall", 8))


@query("SELECT grp, count(*) AS predictions, count(DISTINCT entity) AS proteins, count(DISTINCT domain) AS domains, count(DISTINCT acc) AS functions FROM scored JOIN th USING (grp) WHERE score >= threshold GROUP BY 1", CURVE)
def genome_coverage(t):
    cut = evaluate.precision_threshold(evaluate.precision_recall(t.scored, ["grp"]), 0.25, ["grp"])
    return evaluate.genome_coverage(t.scored.withColumn("protein", F.col("entity")), cut, ["grp"])


@query(
    "SELECT cut_a, cut_b, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b FROM (SELECT cut_a, cut_b, acc, bool_or(score >= cut_a) AS x, bool_or(base >= cut_b) AS y FROM scored, (VALUES (99.0::DOUBLE, 0.1::DOUBLE), (50.0, 0.05)) c(cut_a, cut_b) GROUP BY 1, 2, 3) GROUP BY 1, 2"
)
def orthogonal_predictions(t):
    return evaluate.orthogonal_predictions(t.scored.select("acc", F.col("score").alias("a"), F.col("base").alias("b")), "acc", [(99.0, 0.1), (50.0, 0.05)])


RANKS = {"best": "SELECT entity AS seq, acc, max(score) AS prob, max(base) AS base FROM scored GROUP BY 1, 2"}


@query(
    "SELECT *, rank() OVER (PARTITION BY seq ORDER BY diff DESC) AS diff_rank FROM (SELECT *, base_rank - rank AS diff FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY prob DESC, acc) AS rank, row_number() OVER (PARTITION BY seq ORDER BY base DESC, acc) AS base_rank FROM best) WHERE rank <= 100)",
    RANKS,
)
def rank_against_baseline(t):
    return evaluate.rank_against_baseline(t.scored.groupBy(F.col("entity").alias("seq"), "acc").agg(F.max("score").alias("prob"), F.max("base").alias("base")))


@query(
    "SELECT prob_cut, rank_cut, count(*) AS kept, count(*) FILTER (label > 0) AS right FROM (SELECT CASE WHEN score / 200 = base THEN 0 ELSE (score / 200 - base) / (1 - base) END AS gain, label, (acc % 10)::INT AS r FROM scored), (VALUES (0.1::DOUBLE), (0.3)) p(prob_cut), (VALUES (2), (7)) q(rank_cut) WHERE gain >= prob_cut AND r <= rank_cut GROUP BY 1, 2".replace("AS right", 'AS "right"')
)
def threshold_grid(t):
    rows = t.scored.select((F.col("score") / 200).alias("prob"), "base", "label", (F.col("acc") % 10).cast("int").alias("rank"))
    return evaluate.threshold_grid(rows, [0.1, 0.3], [2, 7])


@query(f"SELECT a.c_custkey, b.c_custkey AS other FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY {draw_sql(3, 'c_custkey')}, c_custkey) AS r FROM customer) b USING (r)")
def shuffle_labels(t):
    return evaluate.shuffle_labels(t.read("customer"), "c_custkey", 3)


@query(f"SELECT partkey, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {draw_sql(5, 'partkey')}, partkey) AS r FROM parts) JOIN (SELECT kind, floor(300 * count(*) / (SELECT count(*) FROM parts WHERE size > 20)) AS take FROM parts WHERE size > 20 GROUP BY 1) USING (kind) WHERE r <= take")
def stratified_like(t):
    return evaluate.stratified_like(t.parts.where("size > 20"), t.parts, "kind", "partkey", 300, 5).select("partkey", "kind")


@query(f"SELECT protein FROM (SELECT DISTINCT protein FROM calls WHERE method = 'psiblast') WHERE protein NOT IN (SELECT protein FROM calls WHERE experiment = 3) ORDER BY {draw_sql(0, 'protein')}, protein LIMIT 200")
def eval_sample(t):
    return evaluate.eval_sample(t.calls, [t.calls.where("method = 'psiblast'")], [t.calls.where("experiment = 3")], 200)


@query("SELECT a, b, c, count(*) AS n FROM (SELECT protein, bool_or(method = 'psiblast') AS a, bool_or(method = 'pfam') AS b, bool_or(method = 'msa') AS c FROM calls GROUP BY 1) GROUP BY 1, 2, 3")
def venn3(t):
    m = F.col("method")
    return evaluate.venn3(t.calls, "protein", {"a": m == "psiblast", "b": m == "pfam", "c": m == "msa"})


@query(
    "SELECT count(*) AS predicted, count(*) FILTER (t) AS \"true\", count(*) FILTER (s) AS stored, count(*) FILTER (t AND s) AS both FROM (SELECT entity, acc, (entity, acc) IN (SELECT (entity, acc) FROM scored WHERE label = 1) AS t, (entity, acc) IN (SELECT (entity, acc) FROM scored WHERE grp = 'O') AS s FROM (SELECT DISTINCT entity, acc FROM scored WHERE score >= 60))"
)
def gold_comparison(t):
    return evaluate.gold_comparison(t.scored, t.scored.where("label = 1"), t.scored.where("grp = 'O'"), 60.0)


@query('SELECT entity AS seq, acc AS mf, max(score / 200) FILTER (grp = \'O\') AS "O", max(score / 200) FILTER (grp = \'F\') AS "F", round(ln((max(base) + 1e-7) / (1 - max(base) + 1e-7)), 6) AS base_llr FROM scored GROUP BY 1, 2')
def pivot_score_sets(t):
    rows = t.scored.select(F.col("entity").alias("seq"), F.col("acc").alias("mf"), F.col("grp").alias("kind"), (F.col("score") / 200).alias("prob"), "base")
    return evaluate.pivot_scores(rows, ["O", "F"]).withColumn("base_llr", F.round("base_llr", 6))


@query("SELECT domain, max(score) AS best, min(base) AS least_base FROM scored GROUP BY 1")
def prediction_extremes(t):
    return evaluate.extremes(t.scored)


@query("SELECT band, count(*) AS domains FROM (SELECT domain, min(CASE WHEN base <= 0.02 THEN 1 WHEN base <= 0.05 THEN 2 WHEN base <= 0.08 THEN 3 END) AS band FROM scored GROUP BY 1) WHERE band IS NOT NULL GROUP BY 1")
def specificity_bins(t):
    b = F.col("base")
    return evaluate.specificity_bins(t.scored, F.when(b <= 0.02, 1).when(b <= 0.05, 2).when(b <= 0.08, 3))


@query(
    "SELECT bin, low, high, count(*) AS n, count(*) FILTER (label > 0) AS correct, count(DISTINCT domain) AS domains FROM scored JOIN (VALUES (0, 0.0::DOUBLE, 20.0::DOUBLE), (1, 20.0, 50.0), (2, 50.0, 90.0)) b(bin, low, high) ON score >= low AND (score < high OR (score = 90 AND high = 90)) GROUP BY 1, 2, 3"
)
def score_histogram(t):
    return evaluate.histogram(t.scored, "score", [0.0, 20.0, 50.0, 90.0], {"n": F.count("*"), "correct": F.count(F.when(F.col("label") > 0, 1)), "domains": F.countDistinct("domain")})


@query(
    """SELECT class, bin, low, high, count(*) AS n, count(*) FILTER (label > 0) AS correct, count(*) FILTER (label > 0) / count(*) AS share FROM (SELECT CASE WHEN substr(code, 1, 1) IN ('a', 'b') THEN substr(code, 1, 1) ELSE 'other' END AS class, score, label FROM scored JOIN parts ON acc = partkey)
    JOIN (VALUES (0, 0.0::DOUBLE, 20.0::DOUBLE), (1, 20.0, 50.0), (2, 50.0, 90.0)) b(bin, low, high) ON score >= low AND (score < high OR (score = 90 AND high = 90)) GROUP BY 1, 2, 3, 4"""
)
def class_histogram(t):
    rows = t.scored.join(t.parts.select(F.col("partkey").alias("acc"), F.col("code").alias("sccs")), "acc")
    return evaluate.class_histogram(rows, [0.0, 20.0, 50.0, 90.0], "ab")


SHUFFLED = {
    "sc": "SELECT entity AS seq, acc, max(score) / 200 AS prob, max(base) AS base, (acc % 10)::INT AS r FROM scored GROUP BY 1, 2",
    "truth": "SELECT DISTINCT entity AS seq, acc FROM scored WHERE label > 0",
    "other": f"SELECT a.seq, b.seq AS other FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM (SELECT DISTINCT seq FROM sc)) a JOIN (SELECT seq, row_number() OVER (ORDER BY {draw_sql(4, 'seq')}, seq) AS k FROM (SELECT DISTINCT seq FROM sc)) b USING (k)",
    "swapped": "SELECT other AS seq, acc FROM truth JOIN other USING (seq)",
}


@query(
    """SELECT prob_cut, rank_cut, count(*) AS kept, count(*) FILTER ((seq, acc) IN (SELECT (seq, acc) FROM truth)) AS "right", count(*) FILTER ((seq, acc) IN (SELECT (seq, acc) FROM swapped)) AS right_shuffled
    FROM (SELECT *, CASE WHEN prob = base THEN 0 ELSE (prob - base) / (1 - base) END AS gain FROM sc), (VALUES (0.1::DOUBLE), (0.3)) p(prob_cut), (VALUES (2), (7)) q(rank_cut) WHERE gain >= prob_cut AND r <= rank_cut GROUP BY 1, 2""",
    SHUFFLED,
)
def shuffled_threshold_grid(t):
    rows = t.scored.groupBy(F.col("entity").alias("seq"), "acc").agg((F.max("score") / 200).alias("prob"), F.max("base").alias("base")).withColumn("rank", (F.col("acc") % 10).cast("int"))
    return evaluate.shuffled_threshold_grid(rows, t.scored.where("label > 0").select(F.col("entity").alias("seq"), "acc"), [0.1, 0.3], [2, 7], 4)


MODEL = {
    "banded": "SELECT *, CASE WHEN base <= 0.02 THEN 1 WHEN base <= 0.05 THEN 2 ELSE 3 END AS band FROM scored",
    "mcurve": "SELECT grp, band, score, sum(n) OVER w AS n, sum(hits) OVER w AS hits FROM (SELECT grp, band, score, count(*) AS n, count(*) FILTER (label > 0) AS hits FROM banded GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY grp, band ORDER BY score DESC)",
    "scurve": "SELECT entity, kind, s, sum(n) OVER w AS n, sum(hits) OVER w AS hits, sum(hits) OVER (PARTITION BY entity, kind) AS ah FROM (SELECT entity, kind, s, count(*) AS n, count(*) FILTER (label > 0) AS hits FROM (SELECT entity, 'score' AS kind, score AS s, label FROM scored UNION ALL SELECT entity, 'base', base, label FROM scored) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY entity, kind ORDER BY s DESC)",
}


@query("SELECT grp, band, coalesce(min(score) FILTER (hits / n >= 0.25 AND n > 99), 100.0) AS threshold FROM mcurve GROUP BY 1, 2", MODEL)
def genome_model(t):
    b = F.col("base")
    return evaluate.genome_model(t.scored.withColumn("band", F.when(b <= 0.02, 1).when(b <= 0.05, 2).otherwise(3)), 0.25, ["grp", "band"])


@query("SELECT entity AS superfamily, kind, round(coalesce(max(hits / ah) FILTER (hits / n >= 0.3), 0), 8) AS recall FROM scurve GROUP BY 1, 2", MODEL)
def superfamily_recall(t):
    rows = t.scored.select(F.col("entity").alias("superfamily"), "label", "score", "base")
    return evaluate.superfamily_recall(rows, ["score", "base"], 0.3).withColumn("recall", F.round("recall", 8))


@query(
    "SELECT bin, low, high, count(*) AS annotations, count(*) FILTER (label > 0) AS correct_annotations, count(DISTINCT domain) AS domains, count(DISTINCT domain) FILTER (label > 0) AS correct_domains, count(DISTINCT entity) AS proteins, count(DISTINCT entity) FILTER (label > 0) AS correct_proteins FROM scored JOIN (VALUES (0, 0.0::DOUBLE, 30.0::DOUBLE), (1, 30.0, 60.0), (2, 60.0, 200.0)) b(bin, low, high) ON score >= low AND (score < high OR (score = 200 AND high = 200)) GROUP BY 1, 2, 3"
)
def llr_histogram(t):
    return evaluate.llr_histogram(t.scored.withColumn("protein", F.col("entity")), [0.0, 30.0, 60.0, 200.0], "score")


@query("SELECT *, round(correct_high / correct, 8) AS share, round(exp(lgamma(high + 1) - lgamma(correct_high + 1) - lgamma(high - correct_high + 1) + lgamma(calls - high + 1) - lgamma(correct - correct_high + 1) - lgamma(calls - high - correct + correct_high + 1) - lgamma(calls + 1) + lgamma(correct + 1) + lgamma(calls - correct + 1)), 8) AS p FROM (SELECT count(*) FILTER (label > 0) AS correct, count(*) FILTER (score >= 90) AS high, count(*) FILTER (score >= 90 AND label > 0) AS correct_high, count(*) AS calls FROM scored)")
def identity_enrichment(t):
    rows = t.scored.select(F.col("score").alias("identity"), (F.col("label") > 0).alias("correct"))
    return evaluate.identity_enrichment(rows, 90.0).withColumns({c: F.round(c, 8) for c in ("share", "p")})


@query("SELECT sequence_key FROM annotations JOIN parts ON partkey = acc WHERE evidence_code IN ('1', '2') AND brand IN ('Brand#1', 'Brand#2') GROUP BY 1 HAVING count(DISTINCT brand) = 2")
def benchmark_sequences(t):
    return evaluate.benchmark_sequences(t.annotations, t.parts.select(F.col("partkey").alias("acc"), F.col("brand").alias("term_type")), ["Brand#1", "Brand#2"], ["1", "2"])
