"""Mixing sources to target weights with Efraimidis-Spirakis keys, in DataFrame operations only.

Every document draws an exponential key scaled by its quality weight, from a hash of its id. A source's
budget is spent on complete epochs first; what is left goes to the documents of least keys. The prefix
sums that find where a budget ends run over a source's key buckets, then over buckets inside the two where
it ends, until few documents are left: the choice is one cut key a source, and the documents are never
sorted or shuffled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import written

WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: Key buckets of a source, and documents left from which no further ones are made.
BUCKETS, FEW = 1024, 4096
#: Weight of a document whose given quality is null or not above 0.
LEAST = 1e-6
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(id_col: str | Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight, with u in (0, 1) from a hash of the id: least keys are chosen first."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row a source.

    Sources in code-point order, null last, take ``weights`` in turn and share the total size by them;
    a target stops at ``max_epochs`` times its source's size and the excess is shared again by weight.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("long")
    each = each.withColumn("w", share).withColumn("cap", F.col("source_size") * max_epochs)
    # Filling up: the sources of least cap for their weight stop first.
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    # The level rises while the next source would stop below it and falls afterwards.
    filled = each.withColumn("level", level)
    common = F.max("level").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.coalesce(common, F.lit(0.0)) * F.col("w"))
    return filled.select("source", "source_size", target.alias("target"))


def cuts(sized: DataFrame, targets: DataFrame, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """source, source_size, target, epochs, cut (struct of key and id, or null): what each source takes.

    Each round deals a source's open documents to equal ranges of keys and keeps the two ranges where the
    budget ends: at most ``buckets`` sums a source, and far fewer documents each time. It ends when every
    source has few left, or only equal keys, which are in the order of id and size.
    """
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    span = sized.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    p = plan.select(F.col("source").alias("p_source"), "rest").join(
        span.withColumnRenamed("source", "s_source"), F.col("p_source").eqNullSafe(F.col("s_source")),
    ).drop("s_source").withColumn("base", F.lit(0).cast("long"))
    p = written(p, "ranges")  # a table: Spark knows its size, and broadcasts it if it is small
    here = sized.select("source", "doc_id", "size", "key")
    while True:
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
        dealt = here.join(p, F.col("source").eqNullSafe(F.col("p_source"))).where("key between lo and hi").withColumn("bucket", place)
        sums = dealt.groupBy("source", "bucket").agg(
            F.sum("size").alias("n"), F.count("*").alias("docs"), F.min("key").alias("least"), F.max("key").alias("greatest"),
            *(F.first(c).alias(c) for c in ("rest", "base", "lo", "hi")),
        )
        before = F.col("base") + F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = sums.withColumn("before", before).where("before <= rest").withColumn(
            "back", F.row_number().over(Window.partitionBy("source").orderBy(F.col("bucket").desc())),
        ).where("back <= 2")
        narrow = last.groupBy(F.col("source").alias("p_source")).agg(
            F.first("rest").alias("rest"), F.min("least").alias("lo"), F.max("greatest").alias("hi"), F.min("before").alias("base"),
            F.sum("docs").alias("docs"), F.first("lo").alias("was_lo"), F.first("hi").alias("was_hi"),
        )
        narrow = written(narrow, "ranges")
        p = narrow.drop("docs", "was_lo", "was_hi")
        if narrow.where(f"docs > {few} and hi > lo and (lo > was_lo or hi < was_hi)").isEmpty():
            break
    near = here.join(p, F.col("source").eqNullSafe(F.col("p_source"))).where("key between lo and hi")
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    fits = near.withColumn("start", start).where(F.col("start") + F.col("size") / 2 <= F.col("rest"))
    cut = fits.groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cut")).withColumnRenamed("source", "c_source")
    return plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", "source_size", "target", "epochs", "cut")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    quality: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row.

    ``taken`` is the words the mix takes of a document: its size times the complete epochs of its source,
    once more if its key is up to the source's cut. The cut is the last document, by key, of which half
    or more still fits the rest of the target. ``quality`` is a weight from any columns of ``docs`` (default: the
    square root of the size); greater weights come earlier, null and those not above 0 last. Null and empty texts have size 0 and take
    0; a null source is one of its own, last in order; rows with the same id are taken alike; an empty
    table gives none. Runs agree.
    """
    sized = written(_sized(docs, id_col, text_col, source_col, quality), "sized")  # one pass over the texts
    return _taken(sized, written(cuts(sized, source_targets(sized, weights)), "cuts"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        size_of(F.col(text_col).cast("string")).alias("size"), _given(quality),
    )
    return rows.withColumn("weight", _weight()).drop("quality").withColumn("key", exponential_key("doc_id", F.col("weight")))


def _given(quality: Column | None) -> Column:
    return (F.lit(None) if quality is None else F.coalesce(F.greatest(quality.cast("double"), F.lit(LEAST)), F.lit(LEAST))).cast("double").alias("quality")


def _weight() -> Column:
    return F.coalesce("quality", F.sqrt(F.greatest(F.col("size"), F.lit(1))).cast("double"))


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    again = F.coalesce(F.struct("key", "doc_id") <= F.col("cut"), F.lit(False)).cast("long")
    joined = sized.join(plan.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + again)).alias("taken"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    quality: Column | None = None,
) -> DataFrame:
    """The rows of the mix with all their columns: each as many times as it is taken, 0 to 3. Null, empty and blank
    texts are never taken; otherwise as ``mix``."""
    sized = written(_sized(docs, id_col, text_col, source_col, quality), "sized")
    plan = written(cuts(sized, source_targets(sized, weights)), "cuts").select(F.col("source").alias("mix__source"), "epochs", "cut")
    drawn = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        size_of(F.col(text_col).cast("string")).alias("size"), _given(quality),
    )
    drawn = drawn.withColumn("key", exponential_key("doc_id", _weight()))
    again = F.coalesce(F.struct("key", "doc_id") <= F.col("cut"), F.lit(False)).cast("long")
    joined = drawn.join(plan, F.col("source").eqNullSafe(F.col("mix__source"))).where("size > 0")
    times = (F.col("epochs") + again).cast("int")
    return joined.where(times > 0).select("doc", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("doc.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / sqrt(greatest(size, 1)) AS key FROM sized),
each AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM each),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(max(level) OVER (), 0.0) * w) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.size, k.source, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, (size * (epochs + CASE WHEN start + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""
