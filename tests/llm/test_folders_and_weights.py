"""Quality weights of the mix, and what runs leave in the shared folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F


def test_quality_from_any_column(spark):
    from foldspark.llm import mixing

    rows = [(i, "one two three four", "s", float(i % 2) if i % 5 else None, 3) for i in range(400)] + [(1000 + i, "w " * 100, "t", 1.0, 3) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, good double, size int")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weights=(1, 14), quality=F.col("good") * F.col("size") + 0.001).collect()}
    again = [r["doc_id"] for r in mixing.mixed(docs, weights=(1, 14), quality=F.col("good") * F.col("size") + 0.001).collect()]
    assert {i: again.count(i) * (4 if i < 1000 else 100) for i in taken} == taken
    share = lambda good: sum(taken[i] > 0 for i, *_, q, _s in rows[:400] if (q or 0) == good) / sum((q or 0) == good for *_, q, _s in rows[:400])
    assert share(1.0) > 3 * share(0.0)


def test_tables_of_a_run_are_removed(spark, tmp_path):
    import corpus_pipeline
    from foldspark.llm._common import made_tables, remove, shared_dir, written

    with made_tables() as made:
        written(spark.range(3), "gone")
    assert len(made) == 1 and spark.read.parquet(made[0]).count() == 3
    remove(spark, made)
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    assert not any(p.name.startswith("gone-") for p in before)
    rows = [(i, f"some words of document {i} that are its own {'x' * i}", "en", "s", 30) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "source_mix" in left and "tokens" in left and not left & {"language_id", "near_duplicates", "decontamination", "near", "gone"}
