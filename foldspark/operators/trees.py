"""Trees as (parent, child) tables: walks up in doubling steps, and partition into sub-trees of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.sources.tables import settled


def walk_up(up: DataFrame, arrived: Column) -> DataFrame:
    """node, at: the first place on the way up from each node where ``arrived`` (of ``at``) holds; nodes that reach none are left out.

    ``up`` (node, at) has the next place of each node. Every round joins the table with itself and so doubles the
    steps: rounds grow with the logarithm of the longest way. Those that have arrived move no more. A cycle is an error.
    """
    table = settled(up.select("node", "at").where("node is not null and at is not null"))
    most = table.count().bit_length() + 1
    for _ in range(most):
        going = table.where(~arrived)
        if going.isEmpty():
            return table
        step = going.join(table.select(F.col("node").alias("at"), F.col("at").alias("next")), "at").select("node", F.col("next").alias("at"))
        table = settled(table.where(arrived).unionByName(step.distinct()))
    if table.where(~arrived).isEmpty():
        return table
    raise ValueError("the parents have a cycle")


#: Shares that a node's children are dealt to before their smallest meet.
SHARES = 64


def _flagged(flag: Column, node: Column | str) -> Column:
    return F.struct(flag.alias("flag"), (F.col(node) if isinstance(node, str) else node).alias("id"))


def _branching(edges: DataFrame) -> DataFrame:
    """node, up: of each node that has a parent, and is a leaf or branches, the next node above that branches or is at the top."""
    kids = edges.groupBy(F.col("parent").alias("node")).agg((F.count("*") == 1).alias("one"))
    below = edges.select(F.col("child").alias("node"), F.col("parent").alias("at")).join(kids, "node", "left").withColumn("one", F.coalesce("one", F.lit(False)))
    below = settled(below)
    passed = below.where("one").select(F.col("node").alias("at"), F.lit(True).alias("passed"))
    steps = below.join(passed, "at", "left").select(_flagged(F.col("one"), "node").alias("node"), _flagged(F.coalesce("passed", F.lit(False)), "at").alias("at"))
    return walk_up(steps, ~F.col("at.flag")).where("not node.flag").select(F.col("node.id").alias("node"), F.col("at.id").alias("up"))


def _stays(held: DataFrame, most: int) -> DataFrame:
    """``held`` (node, up, size) with stays: true for the smallest children of each node whose sum is at most ``most``.

    A child that is too many in its share of them is too many in all, so what meets is bounded.
    """
    fits = []
    for keys in (["up", "share"], ["up"]):
        w = Window.partitionBy(*keys).orderBy("size", F.desc("node"))
        fits.append((F.row_number().over(w) <= most) & (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= most))
    first = held.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES))).withColumn("fits", fits[0])
    kept = first.where("fits").withColumn("fits", fits[1])
    return first.where("not fits").unionByName(kept).select("node", "up", "size", F.col("fits").alias("stays"))


def split_tree(edges: DataFrame, most: int = 40) -> DataFrame:
    """leaf, root: a partition of all leaves of a forest into sub-trees of at most ``most`` leaves, named by their root.

    ``edges`` (parent, child), one parent a child. From the leaves up, a node takes what its children have left; if that is over
    ``most``, the largest remainders (ties: the least of the nodes that branch or are leaves first) are cut off as sub-trees until the rest fits. What the topmost
    node has left is a sub-tree too. Rows without a parent or child are left out; an empty table gives none; a
    second parent of a child, or a cycle, is an error.

    Ways through nodes with one child are passed by doubling steps; then each round handles all nodes whose children are
    known, so rounds grow with the branchings above a leaf. A child that can't stay is cut as soon as it is known; a node that waits
    for others carries ``most`` children at most.
    """
    edges = settled(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    if edges.isEmpty():
        return edges.select(F.col("child").alias("leaf"), F.col("parent").alias("root"))
    if not edges.groupBy("child").count().where("count > 1").isEmpty():
        raise ValueError("a node has two parents")
    up = settled(_branching(edges))
    waiting = settled(up.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("open")))
    leaves = up.join(waiting, "node", "left_anti").select("node")
    held, cut = settled(leaves.join(up, "node").withColumn("size", F.lit(1).cast("long"))), []
    while not held.isEmpty():
        placed = settled(_stays(held, most))
        cut.append(placed.where("not stays").select("node"))
        done = placed.groupBy(F.col("up").alias("node")).agg(
            F.count("*").alias("told"), F.count_if("stays").alias("again"), F.sum(F.when(F.col("stays"), F.col("size"))).alias("size"),
        )
        told = settled(waiting.join(done, "node", "left").select(
            "node", "size", (F.col("open") - F.coalesce("told", F.lit(0))).alias("open"), F.coalesce("again", F.lit(0)).alias("again"),
        ))
        tops = told.where("open = 0").join(up, "node", "left").select("node", "up", "size")
        cut.append(tops.where("up is null").select("node"))
        still = told.where("open > 0").select("node", (F.col("open") + F.col("again")).alias("open"))
        if told.where("open = 0").isEmpty():
            break
        waits = placed.where("stays").join(still.select(F.col("node").alias("up")), "up", "left_semi").select("node", "up", "size")
        held = settled(tops.where("up is not null").unionByName(waits))
        waiting = still
    if not waiting.isEmpty():
        raise ValueError("the parents have a cycle")
    roots = settled(reduce(DataFrame.unionByName, cut).withColumn("root", F.lit(True)))
    own = _flagged(F.lit(True), "node")
    steps = up.join(roots, "node", "left").select("node", F.when(F.col("root"), own).otherwise(_flagged(F.lit(False), "up")).alias("at"))
    every = steps.unionByName(roots.join(up, "node", "left_anti").select("node", own.alias("at")))
    found = walk_up(every.select(_flagged(F.lit(False), "node").alias("node"), "at"), F.col("at.flag"))
    return found.select(F.col("node.id").alias("node"), F.col("at.id").alias("root")).join(leaves, "node", "left_semi").select(F.col("node").alias("leaf"), "root")
