"""Registered queries of the operators, over whole tables, and their SQL.

What nulls, ties, repeated rows and empty tables give is said by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import decontaminate, filter_audit, langid, lexical, license_index, mixing, neighbours, simhash, syncmers, token_counts, token_output, toxicity, url_tree
from foldspark.llm._common import fold


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, benchmark item) rows of ``documents`` against ``benchmark``: see ``decontaminate.contaminated``."""
    return decontaminate.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``; learned from those whose id's crc32 modulo 3 isn't 1: see ``langid``."""
    docs = _docs(spark, sf_dir)
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    return langid.identify(docs, model).withColumn("held_out", fold("doc_id", 3) == 1)


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts: see ``syncmers.edit_comparison``."""
    return syncmers.edit_comparison(_docs(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as token files, read back, one digest row each: see ``token_output``."""
    return token_output.token_digest(token_output.token_files(_docs(spark, sf_dir)))


def op5_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``: see ``url_tree.filter_urls``."""
    return url_tree.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``; learned from labels whose id's crc32 modulo 4 isn't 2: see ``toxicity``."""
    docs = _docs(spark, sf_dir)
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 4) != 2)
    return toxicity.score(docs, machine).withColumn("held_out", fold("doc_id", 4) == 2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``: see ``token_counts.count_tokens``."""
    return token_counts.count_tokens(_docs(spark, sf_dir))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each of ``documents``: see ``mixing.mix``."""
    return mixing.mix(_docs(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all ``documents``: see ``license_index.scan_licenses``."""
    return license_index.scan_licenses(_docs(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all ``documents``, three words and three bits: see ``simhash.near_duplicates``."""
    found = simhash.near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters interact on all ``documents``, by source: see ``filter_audit.audit``."""
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``documents`` for each ``benchmark`` item: see ``lexical.search``."""
    return lexical.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` for each whose id is divisible by 20: see ``neighbours.nearest``."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OPERATORS = (
    op1_template_decontamination, op2_language_mixture, op3_syncmer_fingerprints, op4_token_files, op5_url_template_tree, op6_toxicity_fm, op7_token_counts,
    op8_source_mix, op9_license_scan, op10_simhash, op11_filter_audit, op12_lexical_search, op13_nearest_neighbours,
)
QUERIES = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {"op5_url_template_tree": url_tree.sql(), "op8_source_mix": mixing.SQL, "op9_license_scan": license_index.sql(), "op11_filter_audit": filter_audit.SQL, "op12_lexical_search": lexical.SQL}
