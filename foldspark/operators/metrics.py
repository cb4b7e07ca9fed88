"""Co-occurrence of predictors in clusters: counts, probabilities, log ratios, mutual information.

A metric table is (acc, acc2, metric); a base value has a null ``acc2``, which is a value of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.scalar import TINY, UNIVERSAL
from foldspark.operators.pairs import pairs_within
from foldspark.sources.tables import settled, tasks


def cluster_predictors(clusters: DataFrame, terms: DataFrame, classes: DataFrame, keep_without_terms: bool = False, removed: str = "remove") -> DataFrame:
    """cluster_id, predictor: the terms of a cluster's members and the class of its representative.

    ``clusters`` (cluster_id, identifier, representative), ``terms`` (identifier, acc), ``classes``
    (identifier, superfamily). Clusters that hold the id ``removed``, and those without terms unless
    kept, give none.
    """
    out = clusters.join(clusters.where(F.col("identifier") == removed).select("cluster_id").distinct(), "cluster_id", "left_anti")
    by_term = out.join(terms, "identifier").select("cluster_id", F.col("acc").alias("predictor")).distinct()
    by_class = out.where("representative").join(classes, "identifier").select("cluster_id", F.col("superfamily").alias("predictor"))
    if not keep_without_terms:
        by_class = by_class.join(by_term.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return by_term.unionByName(by_class).distinct()


#: Predictor rows of a cluster from which it is split into blocks of about this size.
BLOCK = 1000


def frequency(predictors: DataFrame) -> DataFrame:
    """acc, acc2, metric: clusters with acc (acc2 null), and with both, for every ordered pair and itself.

    Rows of ``predictors`` may repeat. They move once, by cluster, to tasks that follow their number; a cluster becomes its set of
    predictors, equal sets are counted, and pairs are formed once for each set, mirrored when they are summed. Clusters of more than
    ``BLOCK`` rows are never gathered: they are split into blocks, each joined with the whole. The universal predictor stands in every
    cluster; its pairs are the base counts.
    """
    rows = predictors.select("cluster_id", "predictor")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("c"))
    total, most = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    heavy = settled(sizes.where(F.col("c") > BLOCK).select("cluster_id")) if most > BLOCK else None
    light = rows if heavy is None else rows.join(heavy, rows["cluster_id"].eqNullSafe(heavy["cluster_id"]), "left_anti")
    p, universal, link = F.col("predictor"), F.lit(UNIVERSAL), F.col("cluster_id").isNotNull()
    one = light.repartition(tasks(rows.sparkSession, total), "cluster_id").groupBy("cluster_id").agg(
        F.array_sort(F.collect_set("predictor")).alias("held"), F.bool_or(p.isNull()).alias("gap"),
    )
    sets = settled(one.groupBy("held", "gap", link.alias("link")).agg(F.count("*").alias("n")))
    every = F.when(F.col("gap"), F.concat("held", F.array(F.lit(None).cast("string")))).otherwise(F.col("held"))
    base = sets.select(F.explode(every).alias("predictor"), "n", F.when(F.array_contains("held", universal) & F.col("link"), F.col("n")).otherwise(0).alias("with_all"))
    plain = sets.where("link").select("n", F.array_remove("held", UNIVERSAL).alias("held"))
    pairs = plain.select("n", "held", F.explode("held").alias("acc")).select("n", "acc", F.explode("held").alias("acc2")).where("acc <= acc2")
    if heavy is not None:
        more = settled(rows.join(heavy, rows["cluster_id"].eqNullSafe(heavy["cluster_id"]), "left_semi").distinct())
        has = more.where(p == UNIVERSAL).select("cluster_id", F.lit(1).alias("with_all"))
        base = base.unionByName(more.join(has, "cluster_id", "left").select("predictor", F.lit(1).alias("n"), F.coalesce("with_all", F.lit(0)).alias("with_all")))
        pairs = pairs.unionByName(_pairs_in_blocks(more.where(p != UNIVERSAL)))
    base = settled(base.groupBy("predictor").agg(F.sum("n").alias("metric"), F.sum("with_all").alias("with_all")))
    pairs = pairs.groupBy("acc", "acc2").agg(F.sum("n").alias("metric"))
    both = F.when(F.col("acc") == F.col("acc2"), F.array(F.struct("acc", "acc2"))).otherwise(F.array(
        F.struct("acc", "acc2"), F.struct(F.col("acc2").alias("acc"), F.col("acc").alias("acc2")),
    ))
    # What stands with the universal predictor: everything, in clusters that have it.
    named = F.array(
        F.struct(p.alias("acc"), F.lit(None).cast("string").alias("acc2"), F.col("metric").alias("n")),
        F.struct(universal.alias("acc"), p.alias("acc2"), F.col("with_all").alias("n")),
        F.struct(p.alias("acc"), universal.alias("acc2"), F.when(p != UNIVERSAL, F.col("with_all")).otherwise(0).alias("n")),
    )
    own = base.select(F.explode(named).alias("x")).select("x.acc", "x.acc2", F.col("x.n").alias("metric")).where("acc2 is null or metric > 0")
    return own.unionByName(pairs.select(F.explode(both).alias("x"), "metric").select("x.acc", "x.acc2", "metric"))


def _pairs_in_blocks(rows: DataFrame) -> DataFrame:
    """acc <= acc2, n: a row for each pair of distinct (cluster_id, predictor) rows of a cluster, which meet in blocks of it."""
    sizes = rows.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sized = rows.join(sizes, "cluster_id")
    a = sized.select("cluster_id", F.col("predictor").alias("acc"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = sized.select("cluster_id", F.col("predictor").alias("acc2"), F.pmod(F.xxhash64("predictor"), F.col("blocks")).cast("int").alias("block"))
    return a.join(b, ["cluster_id", "block"]).where("acc <= acc2").select("acc", "acc2", F.lit(1).alias("n"))


def with_base(metric: DataFrame) -> DataFrame:
    """Pair rows with the base values of both: acc, acc2, metric, base, base2, total."""
    base = metric.where("acc2 is null")
    total = base.where(F.col("acc") == UNIVERSAL).select(F.col("metric").alias("total"))
    pairs = metric.where("acc2 is not null")
    pairs = pairs.join(base.select("acc", F.col("metric").alias("base")), "acc", "left").join(
        base.select(F.col("acc").alias("acc2"), F.col("metric").alias("base2")), "acc2", "left",
    )
    return pairs.crossJoin(F.broadcast(total)).select("acc", "acc2", "metric", "base", "base2", "total")  # one row


def frequency_not(freq: DataFrame) -> DataFrame:
    """acc, acc2, with the counts of (acc, not acc2), (not acc, acc2) and (not acc, not acc2)."""
    n = with_base(freq).fillna(0, ["base", "base2"])
    return n.select(
        "acc", "acc2", (F.col("base") - F.col("metric")).alias("a_not_b"), (F.col("base2") - F.col("metric")).alias("not_a_b"),
        (F.col("total") - F.col("base") - F.col("base2") + F.col("metric")).alias("not_a_not_b"),
    )


def probability(freq: DataFrame, pseudo: float | None = None) -> DataFrame:
    """acc, acc2, metric: P(acc), and P(acc2 given acc); ``pseudo`` shrinks it towards P(acc2)."""
    n = with_base(freq)
    plain = F.col("metric") / (F.col("base") + TINY)
    if pseudo is not None:
        plain = (plain * F.col("metric") + pseudo * F.col("base2") / (F.col("total") + TINY)) / (F.col("metric") + pseudo + TINY)
    base = freq.where("acc2 is null")
    total = base.where(F.col("acc") == UNIVERSAL).select(F.col("metric").alias("total"))
    own = base.crossJoin(F.broadcast(total)).select("acc", "acc2", (F.col("metric") / (F.col("total") + TINY)).alias("metric"))  # one row
    return own.unionByName(n.select("acc", "acc2", plain.alias("metric")))


def given_not(p_b: Column, p_b_a: Column, p_a: Column) -> Column:
    """P(b given not a)."""
    top = p_b - p_b_a * p_a
    return F.when(top <= TINY, F.lit(TINY)).otherwise(top / (1 - p_a))


def probability_not(prob: DataFrame) -> DataFrame:
    """acc, acc2, P(not acc), P(not acc2 given acc), P(acc2 given not acc)."""
    return with_base(prob).select(
        "acc", "acc2", (1 - F.col("base")).alias("p_not_a"), (1 - F.col("metric")).alias("p_not_b_a"),
        given_not(F.col("base2"), F.col("metric"), F.col("base")).alias("p_b_not_a"),
    )


def log_ratio(prob: DataFrame) -> DataFrame:
    """acc, acc2, metric: ln(P(b|a) / (P(b|not a) + t) + t); base rows ln(P / (1 - P + t) + t)."""
    other = given_not(F.col("base2"), F.col("metric"), F.col("base"))
    pairs = with_base(prob).select("acc", "acc2", F.ln(F.col("metric") / (other + TINY) + TINY).alias("metric"))
    base = prob.where("acc2 is null").select("acc", "acc2", F.ln(F.col("metric") / (1 - F.col("metric") + TINY) + TINY).alias("metric"))
    return base.unionByName(pairs)


def mutual_information(prob: DataFrame, include_base: bool = False) -> DataFrame:
    """acc, acc2, metric over the two terms with acc2; its absence is left out on purpose."""
    p_a, p_b, p_ba = F.col("base"), F.col("base2"), F.col("metric")

    def term(joint: Column, share: Column) -> Column:
        return joint * F.ln(joint / (share * p_b + TINY) + TINY)

    pairs = with_base(prob).select("acc", "acc2", (term(p_ba * p_a, p_a) + term(given_not(p_b, p_ba, p_a) * (1 - p_a), 1 - p_a)).alias("metric"))
    if not include_base:
        return pairs
    p = F.col("metric")
    return pairs.unionByName(prob.where("acc2 is null").select("acc", "acc2", (p * F.ln(p / (p * TINY + TINY) + TINY)).alias("metric")))


def metric_lookup(pairs: DataFrame, metric: DataFrame, default: float) -> DataFrame:
    """Pairs with their metric, or the default; a null acc2 finds the base value."""
    m = metric.select(F.col("acc").alias("m_acc"), F.col("acc2").alias("m_acc2"), "metric")
    found = pairs.join(m, (pairs["acc"] == F.col("m_acc")) & pairs["acc2"].eqNullSafe(F.col("m_acc2")), "left")
    return found.drop("m_acc", "m_acc2").withColumn("metric", F.coalesce("metric", F.lit(default)))


def metrics_given(metric: DataFrame, acc: str) -> DataFrame:
    return metric.where((F.col("acc") == acc) & F.col("acc2").isNotNull())


def featured_term(entities: DataFrame, functions: DataFrame, mi: DataFrame) -> DataFrame:
    """entity, func, term, mi: the entity's term of greatest MI with each function; a missing MI is 0.

    ``entities`` (entity, term), ``functions`` (func). Ties go to the greatest term. Entities with one set of terms have one result,
    found once for the set: stored values join first, and a function without a stored value for a set, or with none above 0, takes the
    set's greatest term of MI 0, so defaults are never expanded. An entity meets its set's functions, as one array, in the last join.
    """
    functions = functions.select("func").distinct()
    m = mi.select(F.col("acc").alias("func"), F.col("acc2").alias("term"), "metric").where("term is not null").join(functions, "func", "left_semi")
    own = settled(entities.groupBy("entity").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    sets = settled(own.select("terms").distinct())
    stored = sets.select("terms", F.explode("terms").alias("term")).join(m, "term").groupBy("terms", "func").agg(F.max(F.struct("metric", "term")).alias("best"), F.collect_set("term").alias("known"))
    unknown = F.array_max(F.array_except("terms", "known"))
    zero = F.when(unknown.isNotNull(), F.struct(F.lit(0.0).alias("metric"), unknown.alias("term")))
    stored = stored.select("terms", "func", F.greatest(F.col("best"), zero).alias("best"))
    # A row a (entity, function) is what is asked for; of a set's terms only the greatest stands for those without a stored value.
    joined = sets.crossJoin(functions).join(stored, ["terms", "func"], "left")
    one = F.struct("func", F.coalesce(F.col("best")["term"], F.array_max("terms")).alias("term"), F.coalesce(F.col("best")["metric"], F.lit(0.0)).alias("mi"))
    found = joined.groupBy("terms").agg(F.collect_list(one).alias("found"))
    return own.join(found, "terms").select("entity", F.inline("found"))


def superfamily_profile(prob: DataFrame, superfamily: str, common: float = 0.1) -> DataFrame:
    """acc2, metric: P(function given the superfamily) of functions no commoner than ``common`` overall."""
    rare = prob.where((F.col("acc") == UNIVERSAL) & (F.col("metric") <= common)).select("acc2")
    return metrics_given(prob, superfamily).join(rare, "acc2", "left_semi").select("acc2", "metric")


def profile_correlation(prob: DataFrame, superfamilies: DataFrame, functions: DataFrame) -> DataFrame:
    """acc, acc_b, corr, shared, total: weighted Pearson correlation of two profiles, acc < acc_b.

    The weight of a function is its base probability, over functions where not both are 0. Functions of
    one profile alone enter sums only: they come from each profile's totals, less the matched part.
    """
    weight = prob.where("acc2 is null").select(F.col("acc").alias("acc2"), F.col("metric").alias("w")).join(functions, "acc2", "left_semi")
    rows = prob.where("acc2 is not null and metric > 0").join(superfamilies, "acc", "left_semi").join(weight, "acc2").select("acc", "acc2", F.col("metric").alias("p"), "w")
    own = rows.groupBy("acc").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("p")).alias("swp"), F.sum(F.col("w") * F.col("p") ** 2).alias("swpp"))
    met = pairs_within(rows, "acc2", "acc", ("p", "w"))
    both = met.groupBy(F.col("a").alias("acc"), F.col("b").alias("acc_b")).agg(
        F.count("*").alias("shared"), F.sum("w_a").alias("mw"), F.sum(F.col("w_a") * F.col("p_a") * F.col("p_b")).alias("cross"),
    )
    x = own.select("acc", *[F.col(c).alias(f"{c}_a") for c in ("n", "sw", "swp", "swpp")])
    y = own.select(F.col("acc").alias("acc_b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "sw", "swp", "swpp")])
    t = both.join(x, "acc").join(y, "acc_b").withColumn("sw", F.col("sw_a") + F.col("sw_b") - F.col("mw"))
    mean_a, mean_b = F.col("swp_a") / F.col("sw"), F.col("swp_b") / F.col("sw")
    cov = F.col("cross") / F.col("sw") - mean_a * mean_b
    var = (F.col("swpp_a") / F.col("sw") - mean_a**2) * (F.col("swpp_b") / F.col("sw") - mean_b**2)
    return t.select("acc", "acc_b", F.when(var > 1e-15, cov / F.sqrt(var)).alias("corr"), "shared", (F.col("n_a") + F.col("n_b") - F.col("shared")).alias("total"))
