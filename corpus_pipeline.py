"""Training-corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage works on what the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import decontaminate, langid, mixing, resemblance, token_output
from foldspark.llm._common import made_tables, remove, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters that a learned language or a mixture explains.

    Null and letterless texts go; if no row has a language, all with letters stay. Repeated rows fare alike.
    """
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that shares four fifths of its runs of five words.

    Null, empty and blank texts are one group; a null id is the greatest; of rows that share id and text one stays.
    """
    return resemblance.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, as it is or with other values. Null texts hold none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0 to 3 times, null and blank texts never.

    A null source is a source; rows that share an id are taken alike.
    """
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids, read back from the token files: a row for each row, in order of id and text."""
    return token_output.token_files(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]

#: No SQL expresses the mixtures, fingerprints and ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage has written beside its result, and the result before it, are deleted once it is written: of the
    corpus two copies stand in the folder at most. The tables that the returned rows are read from stay.

    An empty table gives no rows; columns beside those of ``documents`` are carried along up to the last stage.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with made_tables() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        remove(spark, [*read, *made[:-1]])
        read = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
