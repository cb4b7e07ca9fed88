"""Tables between steps, JDBC tables, upserts, snapshots, metric tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def step_path(spark: SparkSession) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Only on a ``local`` master may the setting be absent: a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/step-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to and read from the shared folder: lineage ends there, and lost executors cost nothing."""
    at = step_path(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows that a task takes, about, where rows of a key meet.
ROWS = 500_000


def tasks(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """The session's shuffle partitions, or more: one for ``each`` (``ROWS``) rows, so that a task's memory doesn't follow the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (each or ROWS) + 1)


def read_jdbc_tables(spark: SparkSession, url: str, tables: dict[str, tuple[str, int, int, int]], **options) -> dict[str, DataFrame]:
    """Tables read in ranges: name -> (partition column, lower bound, upper bound, partitions)."""
    return {t: spark.read.jdbc(url, t, column=c, lowerBound=lo, upperBound=hi, numPartitions=n, properties=options) for t, (c, lo, hi, n) in tables.items()}


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``updates``, and those of ``target`` with other keys."""
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def upsert_stored(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], partition: list[str]) -> None:
    """Upserts into a Parquet table stored by ``partition``: only the partitions that ``updates`` touch are read and written.

    ``keys`` tell rows apart inside their partition; a key that ``updates`` hold twice is an error. The new partitions
    are made and settled first, beside the table, and then swapped in by one overwrite of just these partitions: other
    files stay as they are, and a run that fails before the swap leaves the table unchanged. A path without a table gets one.
    """
    new = settled(updates)
    if not new.groupBy(*partition, *keys).count().where("count > 1").isEmpty():
        raise ValueError("updates hold a key twice")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        touched = new.select(*partition).distinct()
        # A semi join on partition columns reads the touched folders only.
        old = spark.read.parquet(path).select(*new.columns).join(touched, partition, "left_semi")
        new = settled(upsert(old, new, [*partition, *keys]).select(*new.columns))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def insert_ignore(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target``, and those of ``updates`` with new keys."""
    return target.unionByName(updates.join(target.select(*keys).distinct(), keys, "left_anti"))


def pending_work(tasks: DataFrame, results: DataFrame, key: str, stamp: str, older_than) -> DataFrame:
    """Tasks without a result at ``older_than`` or later."""
    return tasks.join(results.where(F.col(stamp) >= older_than).select(key).distinct(), key, "left_anti")


def write_metric(metric: DataFrame, path: str, marker: str = "not") -> None:
    """The metric table without negated ids."""
    kept = metric.where(~F.col("acc").contains(marker) & ~F.coalesce(F.col("acc2"), F.lit("")).contains(marker))
    kept.write.mode("overwrite").parquet(path)


def snapshot_subset(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], roots: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The part of ``tables`` that follows from ``roots``: each link (table, column, of, column) keeps the
    rows of ``table`` whose column occurs in the kept rows of ``of``."""
    kept = dict(roots)
    for table, col, of, other in links:
        base = kept.get(table, tables[table])
        kept[table] = base.join(kept[of].select(F.col(other).alias(col)).distinct(), col, "left_semi")
    return kept


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
