"""Bayesian prediction of molecular functions for domains."""

from __future__ import annotations

from math import floor, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalar import TINY
from foldspark.sources.tables import settled, tasks

SCORES = ("p_llr", "l_llr", "s_llr", "pl_llr", "ps_llr", "ls_llr", "pls_llr", "base_llr")
#: The log ratio of a pair that isn't stored.
MISSING = log(TINY)
#: Kinds of values of a function, in the order in which they are met.
LINKED, STORED, BARE = range(3)
#: Functions of one whole number that stand in one row, about.
FUNCTIONS = 1000


def combine_superfamily(df: DataFrame) -> DataFrame:
    """domain, sccs, p: 1 - product of (1 - p) over a domain's structures of one superfamily."""
    return df.groupBy("domain", "sccs").agg((1 - F.product(1 - F.col("p"))).alias("p"))


def scale_structures(df: DataFrame, scale: str = "scale") -> DataFrame:
    return df.withColumn("p", F.col("p") * F.col(scale))


def structure_sets(df: DataFrame, mode: str) -> DataFrame:
    """domain, set_id, sccs, p: one set (``combine``), the likeliest structure (``best``; ties to the least
    code), or a set for each structure (``split``)."""
    if mode == "combine":
        return combine_superfamily(df).select("domain", F.lit(1).alias("set_id"), "sccs", "p")
    ranked = df.withColumn("set_id", F.row_number().over(Window.partitionBy("domain").orderBy(F.col("p").desc(), "sccs")))
    if mode == "best":
        ranked = ranked.where("set_id = 1")
    elif mode != "split":
        raise ValueError(mode)
    return ranked.select("domain", "set_id", "sccs", "p")


def _told(funcs: DataFrame, pair: DataFrame, mi: DataFrame) -> DataFrame:
    """term, func, base_llr, most, mi, lr: what is stored of terms with functions ``funcs`` (func, base_llr, most), of either kind."""
    m = mi.select(F.col("acc").alias("func"), F.col("acc2").alias("term"), F.col("metric").alias("mi")).where("term is not null")
    both = m.join(pair.select("func", F.col("given").alias("term"), F.col("metric").alias("lr")), ["func", "term"], "full")
    return both.join(funcs, "func").select("term", "func", "base_llr", "most", F.coalesce("mi", F.lit(0.0)).alias("mi"), "lr")


def _linked_terms(terms: DataFrame, told: DataFrame, lower: float, parts: int) -> DataFrame:
    """parent, p_top, l_top, links (array of func, base_llr, p_acc, p_part, l_acc, l_part) of each parent with terms.

    ``terms`` (entity, kind: p or l, term). A link has the parent's term of greatest MI with the function, of each kind, and its log
    ratio. Only functions for which a term of the parent has a stored value of either kind, and which may reach ``lower``. Of the
    other terms, whose MI is 0, the greatest stands for all; ties go to the greatest term. Terms move once, by parent.
    """
    # The filter stands before the exchange, so that both uses of it are one.
    met = terms.where("entity is not null and term is not null").repartition(parts, "entity").distinct()
    of = lambda name, what: F.when(F.col("kind") == name, what)
    own = met.groupBy("entity").agg(*[F.collect_list(of(x, F.col("term"))).alias(f"{x}_terms") for x in "pl"])
    best = [F.max(of(x, F.struct("mi", "term", "lr"))).alias(f"{x}_best") for x in "pl"]
    known = [F.collect_list(of(x, F.col("term"))).alias(f"{x}_known") for x in "pl"]
    rows = met.join(told, "term").groupBy("entity", "func").agg(F.max("base_llr").alias("base_llr"), F.max("most").alias("most"), *best, *known).join(own, "entity")
    zero = lambda x: F.when(F.size(f"{x}_known") < F.size(f"{x}_terms"), F.struct(
        F.lit(0.0).alias("mi"), F.array_max(F.array_except(f"{x}_terms", f"{x}_known")).alias("term"), F.lit(None).cast("double").alias("lr"),
    ))
    rows = rows.select("entity", "func", "base_llr", "most", *[F.greatest(f"{x}_best", zero(x)).alias(x) for x in "pl"])
    part = lambda x: F.when(F.col(x).isNotNull(), F.coalesce(F.col(x)["lr"], F.lit(MISSING))).otherwise(0.0)
    rows = rows.where(F.col("base_llr") + part("p") + part("l") + F.greatest("most", F.lit(0.0)) >= lower)
    link = F.struct("func", "base_llr", *[y for x in "pl" for y in (F.col(x)["term"].alias(f"{x}_acc"), part(x).alias(f"{x}_part"))])
    links = rows.groupBy("entity").agg(F.collect_list(link).alias("links"))
    return own.join(links, "entity", "left").select(F.col("entity").alias("parent"), *[F.array_max(f"{x}_terms").alias(f"{x}_top") for x in "pl"], "links")


def predict_functions(
    domains: DataFrame, structures: DataFrame, process: DataFrame, localisation: DataFrame, lr: DataFrame, mi: DataFrame, lower: float = -12.0,
    upper: float = 0.0,
) -> DataFrame:
    """domain, parent, set_id, func, the eight scores, p_acc, l_acc.

    ``domains`` (domain, parent), ``structures`` (domain, set_id, sccs, p), ``process`` and
    ``localisation`` (entity, term: of the parent), ``lr`` and ``mi`` metric tables. Functions are those
    with a base log ratio below ``upper``. A null parent has no terms.

    Rows of (domain, function) or (parent, function) never move. Structures move by domain, where their stored log ratios add to the
    default and become one array; terms move by parent and become one array of links with functions, of those that can reach ``lower`` with
    the best that structures add. A domain's row meets its parent's there, and rows are formed from the two arrays, sorted by function,
    where they stand. What has no stored value at all has the same default parts for all parents with terms of the same kinds, so it
    depends on the base alone: a domain meets those functions by whole numbers of their base, from its own bound upwards.
    """
    spark = structures.sparkSession
    base = settled(lr.where(F.col("acc2").isNull() & (F.col("metric") < upper)).select(F.col("acc").alias("func"), F.col("metric").alias("base_llr")))
    pair = settled(lr.where("acc2 is not null").select(F.col("acc").alias("func"), F.col("acc2").alias("given"), "metric").join(base, "func"))
    # sum p * lr = MISSING * sum p + sum p * (lr - MISSING) over the stored pairs; the sum of p stands as that of a null function.
    structures = settled(structures.select("domain", "set_id", "sccs", "p"))
    of_code = settled(pair.groupBy(F.col("given").alias("sccs")).agg(F.collect_list(F.struct("func", "base_llr", (F.col("metric") - MISSING).alias("more"))).alias("stored")))
    name, term = base.schema["func"].dataType.simpleString(), process.schema["term"].dataType.simpleString()
    mass = F.array(F.struct(F.lit(None).cast(name).alias("func"), F.lit(None).cast("double").alias("base_llr"), F.lit(1.0).alias("more")))
    each = pair.count() // max(of_code.count(), 1) + 1  # rows of a structure where they are added
    rows = structures.repartition(tasks(spark, structures.count() * each), "domain").join(of_code, "sccs", "left")
    rows = rows.select("domain", "set_id", "p", F.inline(F.concat(mass, F.coalesce("stored", F.array().cast(of_code.schema["stored"].dataType)))))
    sums = rows.groupBy("domain", "set_id", "func").agg(F.max("base_llr").alias("base_llr"), F.sum(F.col("p") * F.col("more")).alias("extra"))
    sums = sums.groupBy("domain", "set_id").agg(
        F.max(F.when(F.col("func").isNull(), F.col("extra"))).alias("mass"), F.collect_list(F.when(F.col("func").isNotNull(), F.struct("func", "base_llr", "extra"))).alias("stored"),
    )
    held = settled(domains.select("domain", "parent").join(sums, "domain").select("domain", "parent", "set_id", "mass", "stored"))
    reach = held.select("mass", F.inline("stored")).groupBy("func").agg(F.max(F.col("extra") + F.col("mass") * MISSING).alias("most"))
    told = settled(_told(base.join(reach, "func", "left"), pair, mi))
    terms = [df.select("entity", F.lit(kind).alias("kind"), "term") for kind, df in (("p", process), ("l", localisation))]
    terms = settled(terms[0].unionByName(terms[1]))
    parts = tasks(spark, terms.count() + held.count())
    linked = _linked_terms(terms, told, lower, parts)
    rows = held.where("parent is not null").repartition(parts, "parent").join(linked, "parent", "left").unionByName(held.where("parent is null"), allowMissingColumns=True)
    # Without any stored value: from the whole number below the domain's bound up to the greatest base.
    bound = lower - F.col("mass") * MISSING - MISSING * (F.col("p_top").isNotNull().cast("int") + F.col("l_top").isNotNull().cast("int"))
    low, high = (floor(x) if x is not None else 0 for x in base.agg(F.min("base_llr"), F.max("base_llr")).first())
    start = F.greatest(F.floor(bound), F.lit(low))
    wholes = F.when(start <= high, F.sequence(start.cast("int"), F.lit(high))).otherwise(F.array().cast("array<int>"))
    entry = lambda kind, x: F.struct(
        x["func"].alias("func"), F.lit(kind).alias("kind"), x["base_llr"].alias("base_llr"),
        *[(x[c] if kind == LINKED else F.lit(None).cast(t)).alias(c) for c, t in (("p_acc", term), ("p_part", "double"), ("l_acc", term), ("l_part", "double"))],
        (x["extra"] if kind == STORED else F.lit(None).cast("double")).alias("extra"),
    )
    chunk = F.pmod(F.xxhash64("func"), F.lit(base.count() // FUNCTIONS + 1))
    bare = settled(base.groupBy(F.floor("base_llr").cast("int").alias("whole"), chunk.alias("chunk")).agg(F.collect_list(F.struct("func", "base_llr")).alias("bare")).drop("chunk"))
    kept = f"struct<func:{name},kind:int,base_llr:double,p_acc:{term},p_part:double,l_acc:{term},l_part:double,extra:double>"
    or_none = lambda x: F.coalesce(x, F.array().cast(f"array<{kept}>"))
    known = F.concat(or_none(F.transform("links", lambda x: entry(LINKED, x))), or_none(F.transform("stored", lambda x: entry(STORED, x))))
    rows = rows.select("domain", "parent", "set_id", "mass", "p_top", "l_top", known.alias("known"), bound.alias("bound"), wholes.alias("wholes"))
    rows = rows.withColumn("whole", F.explode(F.concat(F.array(F.lit(None).cast("int")), "wholes"))).drop("wholes").join(bare, "whole", "left")
    free = F.transform(F.filter("bare", lambda x: x["base_llr"] >= F.col("bound")), lambda x: entry(BARE, x))
    rows = rows.withColumn("all", F.array_sort(F.concat("known", or_none(free))))
    # Of one function stand, in this order: link, stored, bare. The first gives the row, with the sum of the second.
    rows = rows.select("domain", "parent", "set_id", "mass", "p_top", "l_top", "whole", F.inline(F.arrays_zip(
        F.col("all").alias("one"), F.slice("all", 2, F.size("all")).alias("next"), F.concat(F.array(F.lit(None).cast(kept)), "all").alias("last"),
    )))
    one, after = F.col("one"), F.col("next")
    rows = rows.where(one.isNotNull() & (F.col("last").isNull() | ~F.col("last")["func"].eqNullSafe(one["func"])) & (F.col("whole").isNull() | (one["kind"] == BARE)))
    extra = F.coalesce(one["extra"], F.when((after["func"] == one["func"]) & (one["kind"] == LINKED), after["extra"]), F.lit(0.0))
    default = lambda x: F.when(F.col(f"{x}_top").isNotNull(), F.lit(MISSING)).otherwise(F.lit(0.0))
    rows = rows.select(
        "domain", "parent", "set_id", one["func"].alias("func"), one["base_llr"].alias("base_llr"), (F.col("mass") * MISSING + extra).alias("s"),
        *[F.coalesce(one[f"{x}_part"], default(x)).alias(x) for x in "pl"], *[F.coalesce(one[f"{x}_acc"], f"{x}_top").alias(f"{x}_acc") for x in "pl"],
    )
    scores = [sum((F.col(x) for x in name), start=F.col("base_llr")).alias(f"{name}_llr") for name in ("p", "l", "s", "pl", "ps", "ls", "pls")]
    return rows.select("domain", "parent", "set_id", "func", *scores, "base_llr", "p_acc", "l_acc").where(F.col("pls_llr") >= lower)


def best_per_function(predictions: DataFrame) -> DataFrame:
    """Of each (domain, func) the row of highest pls_llr; ties to the least set_id."""
    w = Window.partitionBy("domain", "func").orderBy(F.col("pls_llr").desc(), "set_id")
    return predictions.withColumn("row__no", F.row_number().over(w)).where("row__no = 1").drop("row__no")


def filter_predictions(predictions: DataFrame, least: dict[str, float] | None = None, most_base: float = 99.0) -> DataFrame:
    """Rows at or over the least of each score (default -99), and at or below ``most_base``."""
    least = {s: -99.0 for s in SCORES if s != "base_llr"} | (least or {})
    cond = F.col("base_llr") <= most_base
    for s, v in least.items():
        cond = cond & (F.col(s) >= v)
    return predictions.where(cond)


def prediction_report(predictions: DataFrame, proteins: DataFrame, names: DataFrame, base_max: float, pls_min: float) -> DataFrame:
    """Predictions of the proteins (parent) with names (func, name), best first."""
    rows = predictions.where((F.col("base_llr") <= base_max) & (F.col("pls_llr") >= pls_min)).join(proteins.select("parent").distinct(), "parent", "left_semi")
    return rows.join(names, "func", "left").orderBy(F.col("pls_llr").desc(), "domain", "func")


def export_rows(predictions: DataFrame, source: str = "bayes_pls") -> DataFrame:
    """parent, func, source of predictions with pls_llr over 0; the source begins with the domain's ``type``."""
    return predictions.where("pls_llr > 0").select("parent", "func", F.concat_ws("_", "type", F.lit(source)).alias("source"))


def specificity(base: str = "base_llr"):
    """1, 2, 3 for base log ratios in (-4, 0], (-8, -4], (-13, -8]; else null."""
    b = F.col(base)
    return F.when((b > -4) & (b <= 0), 1).when((b > -8) & (b <= -4), 2).when((b > -13) & (b <= -8), 3)
