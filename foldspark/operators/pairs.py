"""Pairs of items that share a key, with keys of any number of rows split into blocks on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.sources.tables import settled

#: Items of a key from which it is split into blocks of about this size.
BLOCK = 1000


def pairs_within(rows: DataFrame, key: str, item: str, carry: tuple[str, ...] = (), block: int | None = None, tasks: int | None = None) -> DataFrame:
    """``key``, a < b: each unordered pair of a key's items once, with columns c_a and c_b of those carried along.

    ``rows`` are distinct in (key, item); a null key or item has no pairs. A light key is one block. A heavy one is a triangle
    of cells, each with two blocks of its items, so no task needs a whole key: a block goes to as many cells as
    the key has blocks, and each pair meets in one. ``tasks``: how many the cells are dealt to, if not the session's number.
    """
    block = block or BLOCK
    rows = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item, *carry)
    # Settled: where few or no keys are heavy, Spark sees that, and rows stay in place until they are dealt.
    heavy = settled(rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks__")).where("blocks__ > 1"))
    dealt = rows.join(heavy, key, "left").withColumn("blocks__", F.coalesce("blocks__", F.lit(1)))
    dealt = dealt.withColumn("own__", F.pmod(F.xxhash64(item), F.col("blocks__")).cast("int"))
    side = lambda s: [F.col(item).alias(f"{s}__"), *[F.col(c).alias(f"{c}__{s}") for c in carry]]
    x = dealt.select(key, F.col("own__").alias("i__"), F.explode(F.sequence(F.col("own__"), F.col("blocks__") - 1)).alias("j__"), *side("x"))
    y = dealt.select(key, F.explode(F.sequence(F.lit(0), F.col("own__"))).alias("i__"), F.col("own__").alias("j__"), *side("y"))
    if tasks:
        x, y = (s.repartition(tasks, key, "i__", "j__") for s in (x, y))
    met = x.join(y, [key, "i__", "j__"]).where("x__ < y__ or (i__ < j__ and x__ > y__)")
    first = F.col("x__") < F.col("y__")
    carried = [F.when(first, F.col(f"{c}__{s}")).otherwise(F.col(f"{c}__{t}")).alias(f"{c}_{n}") for c in carry for n, s, t in (("a", "x", "y"), ("b", "y", "x"))]
    return met.select(key, F.least("x__", "y__").alias("a"), F.greatest("x__", "y__").alias("b"), *carried)
