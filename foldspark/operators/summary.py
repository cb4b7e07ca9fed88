"""Per-organism, per-protein and per-cluster summaries, and rankings inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalar import draw, model_group

METHODS = ["psiblast", "fold_recognition", "pfam", "msa", "unassigned"]


def class_counts(calls: DataFrame, high: float, methods: list[str] | None = None, sample: int | None = None, seed: int = 0, key: str = "domain") -> DataFrame:
    """class, total, confident: ``count_by_class`` over calls with confidence above 0, of the methods if given, and of a
    seeded sample of so many keys if given; confident ones are above ``high``."""
    kept = calls.where(F.col("sccs").isNotNull() & (F.col("confidence") > 0))
    if sample is not None:
        # The sample is of all keys, before any filter.
        kept = kept.join(calls.select(key).distinct().orderBy(draw(seed, key), key).limit(sample), key, "left_semi")
    if methods is not None:
        kept = kept.where(F.col("method").isin(*methods))
    return count_by_class(kept.withColumn("confidence", (F.col("confidence") > high).cast("int")), 1)


def count_by_class(calls: DataFrame, high: float, classes: str = "abcdefghi") -> DataFrame:
    """class, total, confident: summed sizes of each class letter, absent ones 0."""
    letters = calls.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    own = calls.groupBy(F.substring_index("sccs", ".", 1).alias("class")).agg(
        F.sum("size").alias("total"), F.sum(F.when(F.col("confidence") >= high, F.col("size"))).alias("confident"),
    )
    zero = F.lit(0)
    return letters.join(own, "class", "left").select("class", F.coalesce("total", zero).alias("total"), F.coalesce("confident", zero).alias("confident"))


def domain_yield(calls: DataFrame) -> DataFrame:
    """experiment, method, size, share: summed sizes and their share of the experiment."""
    own = calls.groupBy("experiment", "method").agg(F.sum("size").alias("size"))
    return own.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy("experiment")))


def organism_summary(calls: DataFrame, medium: float, high: float) -> DataFrame:
    """experiment, proteins, domains, a column for each method, medium, high."""
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0))
    return calls.groupBy("experiment").agg(
        F.countDistinct("protein").alias("proteins"), F.count("*").alias("domains"), *[s(F.col("method") == m).alias(m) for m in METHODS],
        s(F.col("confidence") >= medium).alias("medium"), s(F.col("confidence") >= high).alias("high"),
    )


def domain_count_histogram(calls: DataFrame) -> DataFrame:
    """size, proteins: summed size per protein, then proteins of each size."""
    return calls.groupBy("protein").agg(F.sum("size").alias("size")).groupBy("size").agg(F.count("*").alias("proteins"))


def weighted_mean(histogram: DataFrame, value: str, weight: str) -> DataFrame:
    return histogram.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def protein_structure_summary(calls: DataFrame, confident: float = 0.8) -> DataFrame:
    """protein, size, coverage, quality, sccs, types ('type:n', sorted, comma-joined)."""
    known, sure = F.col("method").isin("psiblast", "fold_recognition"), F.col("confidence") >= confident
    per = calls.groupBy("protein", "method").agg(
        F.sum("size").alias("n"), F.sum(F.when(known | sure, F.col("size")).otherwise(0)).alias("covered"),
        F.collect_set(F.when(sure, F.col("sccs"))).alias("codes"),
    )
    out = per.groupBy("protein").agg(
        F.sum("n").alias("size"), (F.sum("covered") / F.sum("n")).alias("coverage"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))), ",").alias("sccs"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "method", "n"))), ",").alias("types"),
    )
    cov = F.col("coverage")
    return out.withColumn("quality", F.when(cov >= 1, 3).when(cov >= 0.5, 2).when(cov > 0, 1).otherwise(0))


def best_function(predictions: DataFrame, confident: float = 6.23) -> DataFrame:
    """protein, acc, weight: the greatest -base / (1 + e^-(pls - confident)); ties to the greatest acc."""
    w = -F.col("base") / (1 + F.exp(-(F.col("pls") - confident)))
    return predictions.groupBy("protein").agg(F.max(F.struct(w.alias("weight"), "acc")).alias("b")).select(
        "protein", F.col("b.acc").alias("acc"), F.col("b.weight").alias("weight"),
    )


def family_coverage(members: DataFrame, domains: DataFrame) -> DataFrame:
    """family, method, coverage, share: mean over the family's proteins of domain length over protein length."""
    n = members.groupBy("family").agg(F.countDistinct("protein").alias("n"))
    per = members.join(domains, "protein").groupBy("family", "protein", "method", "length").agg(F.sum("dlen").alias("covered"))
    out = per.groupBy("family", "method").agg(F.sum(F.col("covered") / F.col("length")).alias("s")).join(n, "family").select(
        "family", "method", (F.col("s") / F.col("n")).alias("coverage"),
    )
    return out.withColumn("share", F.col("coverage") / F.sum("coverage").over(Window.partitionBy("family")))


def family_term_index(terms: DataFrame) -> DataFrame:
    """family, acc, proteins (sorted)."""
    return terms.groupBy("family", "acc").agg(F.array_sort(F.collect_set("protein")).alias("proteins"))


def protein_stats(domains: DataFrame, predictions: DataFrame, terms: DataFrame) -> DataFrame:
    """protein, domains, predictions, functions, terms."""
    d = domains.groupBy("protein").agg(F.countDistinct("domain").alias("domains"))
    p = predictions.groupBy("protein").agg(F.count("*").alias("predictions"), F.countDistinct("acc").alias("functions"))
    t = terms.groupBy("protein").agg(F.countDistinct("acc").alias("terms"))
    return d.join(p, "protein", "left").join(t, "protein", "left").fillna(0)


def gather_signatures(features: DataFrame) -> DataFrame:
    """sequence_key and a sorted array for each kind: ``features`` (sequence_key, kind, value, negated)."""
    value = F.when(F.col("negated"), F.concat(F.lit("NOT_"), F.col("value"))).otherwise(F.col("value"))
    per = features.where("value is not null").groupBy("sequence_key", "kind").agg(F.array_sort(F.collect_set(value)).alias("values"))
    return per.groupBy("sequence_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "values")))).alias("signature"))


def mcm_audit(new: DataFrame, old: DataFrame, clusters: DataFrame, rows: int = 5, least: int = 25) -> DataFrame:
    """sequence, enough, no_worse, converged, clustered: the four checks of a rerun."""
    n = new.groupBy("sequence").agg(F.count("*").alias("n"), F.avg("probability").alias("avg_new"), F.countDistinct("convergence").alias("conv"))
    o = old.groupBy("sequence").agg(F.avg("probability").alias("avg_old"))
    k = clusters.groupBy("sequence").agg(F.count("*").alias("k"))
    out = n.join(o, "sequence", "left").join(k, "sequence", "left")
    return out.select(
        "sequence", (F.col("n") >= rows).alias("enough"), (F.col("avg_new") >= F.coalesce("avg_old", F.lit(0.0))).alias("no_worse"),
        (F.col("conv") == 1).alias("converged"), (F.coalesce("k", F.lit(0)) >= least).alias("clustered"),
    )


def since_solved_split(hits: DataFrame, average: float) -> DataFrame:
    """cluster, over: whether its mean length is over the average."""
    return hits.groupBy("cluster").agg((F.avg("length") > average).alias("over"))


def top_per_cluster(calls: DataFrame, truth: DataFrame, since=None, least: float = 0.0) -> DataFrame:
    """cluster, sccs, probability, correct: rows at the greatest probability of a cluster, ties kept."""
    rows = calls.where(F.col("probability") >= least)
    rows = rows if since is None else rows.where(F.col("day") >= since)
    top = rows.withColumn("top", F.max("probability").over(Window.partitionBy("cluster"))).where("probability = top").drop("top")
    t = truth.select("cluster", "sccs").distinct().withColumn("correct", F.lit(True))
    return top.select("cluster", "sccs", "probability").distinct().join(t, ["cluster", "sccs"], "left").fillna(False, ["correct"])


def top_n(df: DataFrame, group: str | list[str], n: int | Column, *order) -> DataFrame:
    """The first ``n`` rows of each group by the order."""
    group = [group] if isinstance(group, str) else group
    return df.withColumn("row__no", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("row__no") <= n).drop("row__no")


def decoy_filter(decoys: DataFrame, by_score: int = 15_000, by_radius: int = 10_000) -> DataFrame:
    """Of each code the best scores, then the least radii of gyration."""
    return top_n(top_n(decoys, "code", by_score, "score", "decoy"), "code", by_radius, "rg", "decoy")


def pare_top_percent(decoys: DataFrame, percent: float = 25) -> DataFrame:
    """The int(n * percent / 100) lowest scores of each file."""
    w = Window.partitionBy("file")
    rows = decoys.withColumn("rows__", F.count("*").over(w)).withColumn("row__no", F.row_number().over(w.orderBy("score", "decoy")))
    return rows.where(F.col("row__no") <= F.floor(F.col("rows__") * percent / 100)).drop("rows__", "row__no")


def at_extreme(df: DataFrame, group: str, col: str, greatest: bool = True) -> DataFrame:
    """Rows at the greatest (least) value of each group, ties kept: latest or oldest versions."""
    order = F.col(col).desc() if greatest else F.col(col).asc()
    return df.withColumn("rank__", F.rank().over(Window.partitionBy(group).orderBy(order))).where("rank__ = 1").drop("rank__")


def structure_coverage(domains: DataFrame, overlaps: DataFrame) -> DataFrame:
    """protein, coverage: mean over its domains of the best overlap, 0 if none."""
    best = overlaps.groupBy("domain").agg(F.max("ratio").alias("ratio"))
    return domains.join(best, "domain", "left").groupBy("protein").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("coverage"))


def best_astral(mcm: DataFrame, least: float = 0.8) -> DataFrame:
    """domain, astral, probability: the likeliest, if likely enough; ties to the least."""
    return top_n(mcm, "domain", 1, F.col("probability").desc(), "astral").where(F.col("probability") >= least).select("domain", "astral", "probability")


def representative_center(centers: DataFrame) -> DataFrame:
    """domain, convergence, center: the first centre of the convergence with most decoys."""
    return top_n(centers, "domain", 1, F.col("size").desc(), "convergence", "center").select("domain", "convergence", "center")


def cluster_best_model(calls: DataFrame, models: DataFrame) -> DataFrame:
    """cluster, probability, model: the likeliest call of a cluster with its model."""
    best = calls.groupBy("cluster").agg(F.max(F.struct("probability", "key")).alias("b")).select(
        "cluster", F.col("b.probability").alias("probability"), F.col("b.key").alias("key"),
    )
    return best.join(models, "key").select("cluster", "probability", "model")


def fit_line(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """group, slope, intercept by least squares."""
    return df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def mean_pair_scores(calls: DataFrame, truth: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """cluster, predicted, probability, score: mean probability of a predicted class, with its score against the true one."""
    mean = calls.groupBy("cluster", F.col("sccs").alias("predicted")).agg(F.avg("probability").alias("probability"))
    return mean.join(truth, "cluster").join(pair_scores, ["predicted", "actual"], "left").select("cluster", "predicted", "actual", "probability", "score")


def error_categories(calls: DataFrame, known: DataFrame, scores: DataFrame, width: float = 0.1) -> DataFrame:
    """bin, new_class, continuous, model_error, decoy_error of wrong calls.

    A true class that isn't known is new; a stored score between the classes is continuous space; else
    the predicted z-score is over the native one (model error) or not (decoy error).
    """
    wrong = calls.where("sccs <> actual").withColumn("bin", F.floor(F.col("probability") / width).cast("int"))
    k = known.select(F.col("sccs").alias("actual")).distinct().withColumn("known", F.lit(True))
    s = scores.select(F.col("a").alias("sccs"), F.col("b").alias("actual")).distinct().withColumn("near", F.lit(True))
    both = s.unionByName(s.select(F.col("actual").alias("sccs"), F.col("sccs").alias("actual"), "near")).distinct()
    rows = wrong.join(k, "actual", "left").join(both, ["sccs", "actual"], "left")
    new, near = F.col("known").isNull(), F.col("near").isNotNull()
    n = lambda cond: F.count(F.when(cond, 1))
    more = F.col("pred_z") > F.col("native_z")
    return rows.groupBy("bin").agg(
        n(new).alias("new_class"), n(~new & near).alias("continuous"), n(~new & ~near & more).alias("model_error"),
        n(~new & ~near & ~more).alias("decoy_error"),
    )


def min_date_flag(hits: DataFrame, dates: DataFrame, cutoff) -> DataFrame:
    """query, first, contaminated: the earliest release of its hits and whether it is before the cutoff."""
    first = hits.join(dates, "hit").groupBy("query").agg(F.min("day").alias("first"))
    return first.withColumn("contaminated", F.col("first") < cutoff)


def structure_keys(models: DataFrame, experiment: int) -> DataFrame:
    return models.where(F.col("experiment") == experiment).select("structure").distinct()


def by_group(calls: DataFrame) -> DataFrame:
    """grp, size: summed sizes by model group, all groups together as null: one cube."""
    return calls.withColumn("grp", model_group("method")).cube("grp").agg(F.sum("size").alias("size"))
