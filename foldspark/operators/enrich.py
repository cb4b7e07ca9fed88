"""Enrichment of features in a set of proteins against a background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalar import ENRICH_TINY, draw, fisher_greater_p
from foldspark.sources.tables import settled, tasks


def count_features(hits: DataFrame, subset: DataFrame, repeats: bool = False, rows: int | None = None) -> DataFrame:
    """feature, background, foreground, description of (query, feature, description) rows.

    Rows of the queries in ``subset`` (query) are the foreground. A (query, feature) counts once unless
    ``repeats``; the description is the least. Hits and subset are dealt once, by query and into tasks that follow the number of hits
    (``rows``, counted if not given).
    """
    n = tasks(hits.sparkSession, hits.count() if rows is None else rows)
    own = subset.select("query").repartition(n, "query").distinct().withColumn("own", F.lit(1))
    rows = hits.repartition(n, "query").join(own, "query", "left")
    if not repeats:
        rows = rows.groupBy("query", "feature").agg(F.max("own").alias("own"), F.min("description").alias("description"))
    return rows.groupBy("feature").agg(F.count("*").alias("background"), F.count("own").alias("foreground"), F.min("description").alias("description"))


def count_by_method(calls: DataFrame) -> DataFrame:
    """superfamily, total, psiblast, fold_recognition, other."""
    known = F.col("method").isin("psiblast", "fold_recognition")
    n = lambda cond: F.count(F.when(cond, 1))
    return calls.groupBy("superfamily").agg(
        F.count("*").alias("total"), n(F.col("method") == "psiblast").alias("psiblast"),
        n(F.col("method") == "fold_recognition").alias("fold_recognition"), n(~known).alias("other"),
    )


def filter_count(counts: DataFrame, least: int, col: str = "foreground") -> DataFrame:
    return counts.where(F.col(col) >= least)


def pseudo_count(background: DataFrame, ids: DataFrame, extra: int = 1) -> DataFrame:
    """feature, n: ``extra`` more for the features in ``ids``, which are added if missing."""
    own = ids.select("feature", F.lit(extra).alias("extra")).distinct()
    return background.join(own, "feature", "full").select("feature", (F.coalesce("n", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n"))


def proportion(counts: DataFrame) -> DataFrame:
    """feature, n, share of all."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("feature", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def enrichment_score(own: DataFrame, background: DataFrame, log: bool = True) -> DataFrame:
    """feature, score: share in the set over share in the background; a missing one counts as 1e-10."""
    joined = own.select("feature", F.col("share").alias("p")).join(background.select("feature", F.col("share").alias("q")), "feature", "left")
    ratio = F.col("p") / F.coalesce("q", F.lit(ENRICH_TINY))
    return joined.select("feature", (F.ln(ratio) if log else ratio).alias("score"))


def fisher_greater(counts: DataFrame, bonferroni: bool = True, corrected_cell: bool = False) -> DataFrame:
    """feature, p, corrected of (feature, background, foreground): one-sided, [[k, bg-k], [set-k, total-(bg-k)]].

    The lower right cell leaves the set in, as published; ``corrected_cell`` takes it out. The
    correction multiplies by the number of features and is not capped.
    """
    total = counts.agg(F.sum("background").alias("total"), F.sum("foreground").alias("chosen"), F.count("*").alias("features"))
    rows = counts.crossJoin(F.broadcast(total))  # one row
    k, bg = F.col("foreground"), F.col("background")
    rest = F.col("total") - (bg - k)
    rest = rest - F.col("chosen") if corrected_cell else rest
    p = fisher_greater_p(k, bg - k, F.col("chosen") - k, rest)
    out = rows.withColumn("p", p)
    return out.select(*counts.columns, "p", (F.col("p") * (F.col("features") if bonferroni else F.lit(1))).alias("corrected"))


def enrichment(hits: DataFrame, subset: DataFrame, least: int = 1, extra: int = 1, rows: int | None = None) -> DataFrame:
    """feature, background, foreground, score, p, corrected, by p: the whole test. The counts, a row a feature, are settled and read again."""
    counts = filter_count(settled(count_features(hits, subset, rows=rows)), least)
    fore = proportion(counts.select("feature", F.col("foreground").alias("n")))
    back = proportion(pseudo_count(counts.select("feature", F.col("background").alias("n")), counts.select("feature"), extra))
    tested = fisher_greater(counts.select("feature", "background", "foreground"))
    return tested.join(enrichment_score(fore, back), "feature").orderBy("p", "feature")


def background_resample(background: DataFrame, n: int, iterations: int, seed: int = 0, key: str = "query") -> DataFrame:
    """iteration, key: ``n`` rows of the background drawn anew for each iteration, by a seeded hash.

    Draws are even over 52 bits, so all but about ``n`` rows of an iteration are cut by their draw before any exchange: the cut lies
    12 deviations and 50 rows above ``n``, beyond any chance that it takes one of the ``n`` least.
    """
    rows = background.select(key).distinct()
    share = min(1.0, (n + 12 * n**0.5 + 50) / max(rows.count(), 1))
    order: Column = draw(seed, "iteration", key)
    drawn = rows.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).where(order < int(share * (1 << 52)))
    return drawn.withColumn("row__no", F.row_number().over(Window.partitionBy("iteration").orderBy(order, key))).where(F.col("row__no") <= n).drop("row__no")
