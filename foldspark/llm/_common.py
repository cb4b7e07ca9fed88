"""Helpers shared by the operators: shared folders, bounded slices of Arrow batches, folds."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one vectorised step holds at a time.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a session on one machine (a ``local`` master), as in tests, may lack the setting: a fresh temporary
    folder is set. Elsewhere executors would write to their own disks, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def made_tables() -> Iterator[list[str]]:
    """The paths of the tables that are written inside, for ``remove`` once what reads them is written too."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables in the shared folder."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's shuffle setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def sampled(col: str, rate: Column) -> Column:
    """A repeatable sample: true for about ``rate`` of the ids."""
    return (F.pmod(F.xxhash64(F.col(col), F.lit("sample")), F.lit(1 << 20)) < rate * (1 << 20))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of rows with at most ``limit`` bytes of text, one row at least."""
    sizes = np.asarray([0] * batch.num_rows if batch.num_rows == 0 else _bytes(batch[column]), dtype=np.int64)
    at, n = 0, batch.num_rows
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _bytes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def filled(texts: pa.Array) -> pa.Array:
    """Texts with '' for null."""
    import pyarrow.compute as pc

    return pc.fill_null(texts, "")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back to the system at its end what its task held: Python workers outlive their tasks."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets (one more than rows) of rows of these lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets; empty runs give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def keep_rows(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], np.ndarray]], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows, with all their columns, for whose texts (null: '') a function says true.

    ``make`` builds the function once in each task. Narrow: rows stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch, text_col, limit):
                yield part.filter(pa.array(keep(filled(part[text_col])).astype(bool)))

    return docs.mapInArrow(lean(run), docs.schema)
