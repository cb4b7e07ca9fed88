"""Alignment columns, residues and three-dimensional sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalar import draw
from foldspark.operators.pairs import pairs_within


def residue_columns(alignment: DataFrame) -> DataFrame:
    """protein, residue (from 1), col (from 0), letter: columns that hold a residue, of each row's sequence. Narrow.

    Residues are the letters without gaps; a residue's column is its number and the gaps before it, which are told by stretch between
    gaps, so that nothing is interpreted for each letter.
    """
    gaps = F.flatten(F.transform(F.split("aligned", "-"), lambda x, i: F.array_repeat(i, F.length(x))))
    letters = F.split(F.replace("aligned", F.lit("-"), F.lit("")), "")
    rows = alignment.select("protein", gaps.alias("gaps__"), letters.alias("letters__")).select("protein", "gaps__", F.posexplode("letters__").alias("at", "letter"))
    return rows.where("letter <> ''").select("protein", (F.col("at") + 1).alias("residue"), (F.col("at") + F.get("gaps__", F.col("at"))).alias("col"), "letter")


def domain_residue_columns(columns: DataFrame, regions: DataFrame) -> DataFrame:
    """domain, residue (from 1 inside the domain), col."""
    return columns.join(regions, "protein").where("residue between start and stop").select("domain", (F.col("residue") - F.col("start") + 1).alias("residue"), "col")


def culled_columns_map(lengths: DataFrame, culled: DataFrame) -> DataFrame:
    """alignment, col, culled_col: columns that are left, and their number among those."""
    every = lengths.select("alignment", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("col"))
    left = every.join(culled, ["alignment", "col"], "left_anti")
    return left.withColumn("culled_col", F.row_number().over(Window.partitionBy("alignment").orderBy("col")) - 1)


def seed_column_map(columns: DataFrame) -> DataFrame:
    """alignment, residue (from 0), seed_col: of ``columns`` (alignment, col, seed_gap, target_gap) the target's
    residues with the number of their seed column, null where all seeds have a gap."""
    w = Window.partitionBy("alignment").orderBy("col")
    rows = columns.withColumn("seed_no", F.sum((~F.col("seed_gap")).cast("int")).over(w)).withColumn("res_no", F.sum((~F.col("target_gap")).cast("int")).over(w))
    return rows.where("not target_gap").select("alignment", (F.col("res_no") - 1).alias("residue"), F.when(~F.col("seed_gap"), F.col("seed_no") - 1).alias("seed_col"))


def column_features(columns: DataFrame, structure: DataFrame, domains: DataFrame) -> DataFrame:
    """protein, col, residue, domain, seqres, atom: a long table of what stands in each column."""
    return columns.join(domains, "protein", "left").where("domain is null or residue between start and stop").join(structure, ["protein", "residue"], "left").select("protein", "col", "residue", "domain", "seqres", "atom")


def inverse_distance(coords: DataFrame, sites: DataFrame) -> DataFrame:
    """structure, set_id, mean_inverse, pairs: mean of 1/d over the pairs of residues of each set.

    ``coords`` (structure, residue, x, y, z), ``sites`` (structure, set_id, residue).
    """
    at = sites.join(coords, ["structure", "residue"])
    a, b = at.alias("a"), at.alias("b")
    d2 = sum((F.col(f"a.{k}") - F.col(f"b.{k}")) ** 2 for k in "xyz")
    met = a.join(b, (F.col("a.structure") == F.col("b.structure")) & (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.residue") < F.col("b.residue")))
    return met.groupBy(F.col("a.structure").alias("structure"), F.col("a.set_id").alias("set_id")).agg(F.avg(1 / F.sqrt(d2)).alias("mean_inverse"), F.count("*").alias("pairs"))


def site_clustering(coords: DataFrame, sites: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """structure, target, percentile: the sites' mean 1/d and the share of random sets of that size not above it.

    Each residue is drawn for every sample by a hash; the pairs of a sample, and those of the sites, meet in blocks, so no task or row holds
    a structure's pairs and their sums are spread over all tasks. The pairs themselves grow with the square of the sites. Rows of
    ``coords`` are distinct in (structure, residue). Structures with fewer than two sites give no row.
    """
    own = sites.select("structure", "residue").distinct()
    size = own.groupBy("structure").agg(F.count("residue").cast("int").alias("k"))
    drawn = coords.join(size, "structure").withColumn("set_id", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    first = Window.partitionBy("structure", "set_id").orderBy(draw(seed, "structure", "set_id", "residue"), "residue")
    chosen = drawn.withColumn("row__no", F.row_number().over(first)).where("row__no <= k")
    names = ["structure", "set_id", "residue", "x", "y", "z"]
    every = chosen.select(*names).unionByName(coords.join(own, ["structure", "residue"]).withColumn("set_id", F.lit(0)).select(*names))
    met = pairs_within(every.withColumn("key", F.struct("structure", "set_id")), "key", "residue", ("x", "y", "z"))
    inverse = 1 / F.sqrt(sum((F.col(f"{k}_a") - F.col(f"{k}_b")) ** 2 for k in "xyz"))
    means = met.groupBy("key").agg(F.avg(inverse).alias("mean"), F.count(inverse).alias("n"), F.count("*").alias("pairs")).where("n = pairs").select("key.*", "mean")
    targets = means.where("set_id = 0").select("structure", F.col("mean").alias("target"))
    means = means.where("set_id > 0").join(targets, "structure")
    return means.groupBy("structure", "target").agg(F.avg((F.col("mean") <= F.col("target")).cast("int")).alias("percentile"))


def important_residue_score(sites: DataFrame, matrix: DataFrame, gap: float = -0.5) -> DataFrame:
    """structure, score, conserved, identical: ``sites`` (structure, residue, known, letter) scored by a
    substitution matrix (known, letter, s)."""
    rows = sites.join(matrix, ["known", "letter"], "left")
    s = F.when(F.col("letter") == "-", F.lit(gap)).otherwise(F.coalesce("s", F.lit(0.0)))
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("residue"))))
    return rows.groupBy("structure").agg(
        F.sum(s).alias("score"), pick((s > 0) & (F.col("letter") != F.col("known"))).alias("conserved"),
        pick(F.col("letter") == F.col("known")).alias("identical"),
    )
