"""Predictions against truth: labels, precision and recall, thresholds, coverage, ranks, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalar import draw, hypergeom_point
from foldspark.operators.structure import ranked
from foldspark.sources.tables import settled


def label_predictions(predictions: DataFrame, truth: DataFrame, unannotated: bool = False, score: str = "score") -> DataFrame:
    """entity, acc, score, label: 1 if (entity, acc) is true, else -1; with the true rows that weren't
    predicted, at score -99, if ``unannotated``."""
    t = truth.select("entity", "acc").distinct().withColumn("t", F.lit(1))
    out = predictions.join(t, ["entity", "acc"], "left").select("entity", "acc", F.col(score).alias("score"), F.coalesce("t", F.lit(-1)).alias("label"))
    if unannotated:
        missed = t.join(predictions, ["entity", "acc"], "left_anti").select("entity", "acc", F.lit(-99.0).alias("score"), F.lit(1).alias("label"))
        out = out.unionByName(missed).distinct()
    return out


def precision_recall(scored: DataFrame, groups: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """[groups,] score, n, hits, precision, recall, rate at each distinct cutoff, score >= it.

    Rows are counted by score first. The prefix sums are made in two levels: inside ranges of (groups, score),
    then, for each group, over a row a range that it reaches into. A group of any size is spread over ranges.
    """
    groups = groups or []
    by_score = scored.groupBy(*groups, "score").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") > 0, 1)).alias("hits"))
    n = parts or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(by_score.repartitionByRange(n, *groups, F.col("score").desc()).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(*groups, "part").agg(F.sum("n").alias("pn"), F.sum("hits").alias("ph"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    names = [F.col(g).alias(f"{g}__") for g in groups]
    sums = sums.select(
        *names, F.col("part").alias("part__"), F.coalesce(F.sum("pn").over(before), zero).alias("bn"),
        F.coalesce(F.sum("ph").over(before), zero).alias("bh"), F.sum("pn").over(every).alias("all_n"), F.sum("ph").over(every).alias("all_hits"),
    )
    down = Window.partitionBy("part", *groups).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col("part") == F.col("part__"), *[F.col(g).eqNullSafe(F.col(f"{g}__")) for g in groups]]
    rows = dealt.withColumn("cn", F.sum("n").over(down)).withColumn("ch", F.sum("hits").over(down)).join(sums, same)
    rows = rows.withColumn("cn", F.col("bn") + F.col("cn")).withColumn("ch", F.col("bh") + F.col("ch"))
    return rows.select(
        *groups, "score", F.col("cn").alias("n"), F.col("ch").alias("hits"), (F.col("ch") / F.col("cn")).alias("precision"),
        F.when(F.col("all_hits") > 0, F.col("ch") / F.col("all_hits")).alias("recall"), (F.col("cn") / F.col("all_n")).alias("rate"),
    )


def precision_threshold(curve: DataFrame, least: float, groups: list[str] | None = None, skip: int = 99) -> DataFrame:
    """[groups,] threshold: the lowest cutoff with enough precision, past the first ``skip`` predictions; 100 if none."""
    ok = F.min(F.when((F.col("precision") >= least) & (F.col("n") > skip), F.col("score")))
    return curve.groupBy(*(groups or [])).agg(F.coalesce(ok, F.lit(100.0)).alias("threshold"))


def recall_at_precision(curve: DataFrame, least: float, groups: list[str] | None = None) -> DataFrame:
    """[groups,] recall: the highest with enough precision; 0 if none."""
    return curve.groupBy(*(groups or [])).agg(F.coalesce(F.max(F.when(F.col("precision") >= least, F.col("recall"))), F.lit(0.0)).alias("recall"))


def genome_model(predictions: DataFrame, least: float, groups: list[str]) -> DataFrame:
    """groups, threshold: of each combination, as of method group and specificity band, the lowest score from which
    precision reaches ``least``."""
    return precision_threshold(precision_recall(predictions, groups), least, groups)


def superfamily_recall(predictions: DataFrame, scores: list[str], least: float, group: str = "superfamily") -> DataFrame:
    """group, kind, recall: the highest recall with precision of ``least`` for each kind of score; 0 where none has it.

    ``predictions`` (group, label, and a column a score) are read once for each score.
    """
    out = None
    for kind in scores:
        rows = predictions.select(group, "label", F.col(kind).alias("score")).where("score is not null")
        found = precision_recall(rows, [group]).groupBy(group).agg(F.coalesce(F.max(F.when(F.col("precision") >= least, F.col("recall"))), F.lit(0.0)).alias("recall"))
        found = found.select(group, F.lit(kind).alias("kind"), "recall")
        out = found if out is None else out.unionByName(found)
    return out


def llr_histogram(predictions: DataFrame, edges: list[float], score: str = "pls_llr") -> DataFrame:
    """bin, low, high, then annotations, domains and proteins in it, and how many of each are correct (label over 0)."""
    right = F.col("label") > 0
    counts = {"annotations": F.count("*"), "correct_annotations": F.count(F.when(right, 1))}
    for name, col in (("domains", "domain"), ("proteins", "protein")):
        counts |= {name: F.countDistinct(col), f"correct_{name}": F.countDistinct(F.when(right, F.col(col)))}
    return histogram(predictions, score, edges, counts)


def identity_enrichment(calls: DataFrame, identity: float) -> DataFrame:
    """correct, high, correct_high, calls, share, p: the share of hits of high identity among the correct calls, and the
    hypergeometric point value of that number. ``calls`` (identity, correct)."""
    high = F.col("identity") >= identity
    n = lambda cond: F.count(F.when(cond, 1))
    sums = calls.agg(n(F.col("correct")).alias("correct"), n(high).alias("high"), n(high & F.col("correct")).alias("correct_high"), F.count("*").alias("calls"))
    p = hypergeom_point("correct_high", "high", F.col("calls") - F.col("high"), "correct")
    return sums.select("*", (F.col("correct_high") / F.col("correct")).alias("share"), p.alias("p"))


def benchmark_sequences(annotations: DataFrame, terms: DataFrame, types: list[str], codes: list[str], key: str = "sequence_key") -> DataFrame:
    """key: sequences with an annotation of every type, by the evidence codes. ``terms`` (acc, term_type)."""
    rows = annotations.where(F.col("evidence_code").isin(codes)).join(terms.where(F.col("term_type").isin(types)).select("acc", "term_type"), "acc")
    return rows.groupBy(key).agg(F.countDistinct("term_type").alias("types__")).where(F.col("types__") == len(set(types))).select(key)


def genome_coverage(predictions: DataFrame, thresholds: DataFrame, groups: list[str]) -> DataFrame:
    """groups, predictions, proteins, domains, functions kept at the groups' thresholds.

    Thresholds, a row a group, are settled, so that Spark sees whether they are small and need no exchange of the predictions. Each
    kind of id is made distinct on its own, so that no row is repeated for another kind and no task holds the ids of all kinds.
    """
    kept = predictions.join(settled(thresholds), groups).where("score >= threshold")
    out = kept.groupBy(*groups).agg(F.count("*").alias("predictions"))
    for name, col in (("proteins", "protein"), ("domains", "domain"), ("functions", "acc")):
        out = out.join(kept.groupBy(*groups).agg(F.countDistinct(col).alias(name)), groups)
    return out


def orthogonal_predictions(scores: DataFrame, key: str, cuts: list[tuple[float, float]]) -> DataFrame:
    """cut_a, cut_b, both, only_a, only_b: keys over the cutoffs of two scores (a, b)."""
    grid = scores.sparkSession.createDataFrame(cuts, "cut_a double, cut_b double")
    flags = scores.crossJoin(F.broadcast(grid)).groupBy("cut_a", "cut_b", key).agg(
        F.bool_or(F.col("a") >= F.col("cut_a")).alias("x"), F.bool_or(F.col("b") >= F.col("cut_b")).alias("y"),
    )  # a short list of cutoffs
    n = lambda cond: F.count(F.when(cond, 1))
    return flags.groupBy("cut_a", "cut_b").agg(n(F.col("x") & F.col("y")).alias("both"), n(F.col("x") & ~F.col("y")).alias("only_a"), n(~F.col("x") & F.col("y")).alias("only_b"))


def rank_against_baseline(df: DataFrame, most: int = 100) -> DataFrame:
    """seq, acc, prob, base, rank, base_rank, diff, diff_rank: ranks of prob within a sequence up to ``most``
    and how far they are off the ranks of the base."""
    own = Window.partitionBy("seq").orderBy(F.col("prob").desc(), "acc")
    low = Window.partitionBy("seq").orderBy(F.col("base").desc(), "acc")
    rows = df.withColumn("rank", F.row_number().over(own)).withColumn("base_rank", F.row_number().over(low)).withColumn("diff", F.col("base_rank") - F.col("rank"))
    return rows.where(F.col("rank") <= most).withColumn("diff_rank", F.rank().over(Window.partitionBy("seq").orderBy(F.col("diff").desc())))


def threshold_grid(scores: DataFrame, prob_cuts: list[float], rank_cuts: list[int]) -> DataFrame:
    """prob_cut, rank_cut, kept, right: (prob - base)/(1 - base), 0 where equal, over the cut, at the rank or better."""
    gain = F.when(F.col("prob") == F.col("base"), 0.0).otherwise((F.col("prob") - F.col("base")) / (1 - F.col("base")))
    grid = scores.sparkSession.createDataFrame([(p, r) for p in prob_cuts for r in rank_cuts], "prob_cut double, rank_cut int")
    rows = scores.withColumn("gain", gain).crossJoin(F.broadcast(grid)).where((F.col("gain") >= F.col("prob_cut")) & (F.col("rank") <= F.col("rank_cut")))  # a short grid
    return rows.groupBy("prob_cut", "rank_cut").agg(F.count("*").alias("kept"), F.count(F.when(F.col("label") > 0, 1)).alias("right"))


def shuffled_threshold_grid(scores: DataFrame, truth: DataFrame, prob_cuts: list[float], rank_cuts: list[int], seed: int = 0) -> DataFrame:
    """prob_cut, rank_cut, kept, right, right_shuffled: ``threshold_grid`` with the labels of truth, and with those of the
    truth of another sequence, by a seeded permutation of the predicted sequences.

    ``scores`` (seq, acc, prob, base, rank), ``truth`` (seq, acc).
    """
    true = truth.select("seq", "acc").distinct()
    other = shuffle_labels(scores, "seq", seed)
    swapped = true.join(other, "seq").select(F.col("other").alias("seq"), "acc", F.lit(1).alias("swapped"))
    rows = scores.join(true.withColumn("true", F.lit(1)), ["seq", "acc"], "left").join(swapped, ["seq", "acc"], "left")
    real = threshold_grid(rows.withColumn("label", F.coalesce("true", F.lit(-1))), prob_cuts, rank_cuts)
    mixed = threshold_grid(rows.withColumn("label", F.coalesce("swapped", F.lit(-1))), prob_cuts, rank_cuts)
    return real.join(mixed.select("prob_cut", "rank_cut", F.col("right").alias("right_shuffled")), ["prob_cut", "rank_cut"])


def class_histogram(calls: DataFrame, edges: list[float], classes: str = "abcd", score: str = "score") -> DataFrame:
    """class, bin, low, high, n, correct, share: calls (sccs, label, a score) of each class letter, 'other' for the rest, by
    score; share is that of the correct ones (label over 0)."""
    letter = F.substring_index("sccs", ".", 1)
    rows = calls.withColumn("class", F.when(letter.isin(*classes), letter).otherwise("other"))
    out = histogram(rows, score, edges, {"n": F.count("*"), "correct": F.count(F.when(F.col("label") > 0, 1))}, ["class"])
    return out.withColumn("share", F.col("correct") / F.col("n"))


def shuffle_labels(ids: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """key, other: a seeded permutation of all distinct ids (numbers): each takes the id whose draw has its own rank."""
    rows = ids.select(key).distinct()
    drawn = ranked(rows.withColumn("draw__", draw(seed, key)), "draw__", key)
    return ranked(rows, key).join(drawn.select(F.col(key).alias("other"), "idx"), "idx").select(key, "other")


def stratified_like(reference: DataFrame, pool: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Rows of the pool, int(n * share) of each group by the reference's shares, in seeded order."""
    total = reference.agg(F.count("*").alias("total"))
    share = reference.groupBy(group).agg(F.count("*").alias("k")).crossJoin(F.broadcast(total)).select(group, F.floor(n * F.col("k") / F.col("total")).alias("take__"))  # one row
    w = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return pool.join(share, group).withColumn("row__no", F.row_number().over(w)).where("row__no <= take__").drop("row__no", "take__")


def eval_sample(proteins: DataFrame, keep: list[DataFrame], drop: list[DataFrame], n: int, key: str = "protein", seed: int = 0) -> DataFrame:
    """``n`` proteins that occur in all of ``keep`` and none of ``drop``, in seeded order."""
    out = proteins.select(key).distinct()
    for k in keep:
        out = out.join(k.select(key).distinct(), key, "left_semi")
    for d in drop:
        out = out.join(d.select(key).distinct(), key, "left_anti")
    return out.orderBy(draw(seed, key), key).limit(n)


def venn3(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """The flags' names, n: keys by which of the three sets hold them."""
    own = df.groupBy(key).agg(*[F.bool_or(cond).alias(name) for name, cond in flags.items()])
    return own.groupBy(*flags).agg(F.count("*").alias("n"))


def gold_comparison(predictions: DataFrame, truth: DataFrame, stored: DataFrame, cut: float) -> DataFrame:
    """predicted, true, stored, both: pairs (entity, acc) over the cut, and those in the other tables."""
    keys = ["entity", "acc"]
    kept = predictions.where(F.col("score") >= cut).select(*keys).distinct()
    t, s = (x.select(*keys).distinct().withColumn(n, F.lit(1)) for x, n in ((truth, "t"), (stored, "s")))
    return kept.join(t, keys, "left").join(s, keys, "left").agg(
        F.count("*").alias("predicted"), F.count("t").alias("true"), F.count("s").alias("stored"),
        F.count(F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), 1)).alias("both"),
    )


def pivot_scores(scores: DataFrame, names: list[str], tiny: float = 1e-7) -> DataFrame:
    """seq, mf, a column for each score set, base_llr = ln((p + t)/(1 - p + t))."""
    rows = scores.groupBy("seq", "mf").pivot("kind", names).agg(F.max("prob"))
    base = scores.groupBy("seq", "mf").agg(F.max("base").alias("b"))
    return rows.join(base, ["seq", "mf"]).withColumn("base_llr", F.ln((F.col("b") + tiny) / (1 - F.col("b") + tiny))).drop("b")


def extremes(predictions: DataFrame) -> DataFrame:
    """domain, best, least_base."""
    return predictions.groupBy("domain").agg(F.max("score").alias("best"), F.min("base").alias("least_base"))


def specificity_bins(predictions: DataFrame, band: Column) -> DataFrame:
    """band, domains: each domain counted in its first band."""
    own = predictions.groupBy("domain").agg(F.min(band).alias("band"))
    return own.where("band is not null").groupBy("band").agg(F.count("*").alias("domains"))


def histogram(df: DataFrame, value: str, edges: list[float], measures: dict[str, Column], groups: list[str] | None = None) -> DataFrame:
    """[groups,] bin, low, high, measures: values by edges, the last bin closed; values outside are left out."""
    v = F.col(value)
    last = len(edges) - 2
    at = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        inside = (v >= edges[i]) & ((v < edges[i + 1]) | ((v == edges[i + 1]) if i == last else F.lit(False)))
        at = F.when(inside, i).otherwise(at)
    rows = df.withColumn("bin", at).where("bin is not null")
    out = rows.groupBy(*(groups or []), "bin").agg(*[m.alias(n) for n, m in measures.items()])
    low, high = (F.array(*map(F.lit, e)) for e in (edges[:-1], edges[1:]))
    return out.withColumn("low", F.get(low, F.col("bin"))).withColumn("high", F.get(high, F.col("bin")))
