"""Readers and writers that stand beside those of test_sources: decoys, reports, domain hits, parts of files, metric tables."""

from __future__ import annotations

import pytest

from foldspark.sources import readers, tables

DECOY = "SCORE:  {score} {terms} {rg} 20.5 -3.1 0.25 {name}\n{lines}"


def _decoy(score: str, n: int, name: str) -> str:
    lines = "".join(f"  {i + 1} {'LHE'[i % 3]}  -60.123  140.500  180.000    1.0    2.0    3.0 {name}\n" for i in range(n))
    return DECOY.format(score=score, terms=" ".join(["0.5"] * 11), rg="12.25", name=name, lines=lines)


def test_silent_decoys_of_several_files(spark, tmp_path):
    head = "SCORE:     score env pair vdw hs ss sheet cb rsigma hb_srbb hb_lrbb rms rg co contact rama description\n"
    (tmp_path / "a.out").write_text("SEQUENCE: MKVLA\n" + head + _decoy("-10.5", 5, "S_1") + _decoy("nan", 5, "S_2") + _decoy("-3.0", 4, "S_cut"))
    (tmp_path / "b.out").write_text("SEQUENCE: MKV\n" + head + _decoy("7.25", 3, "S_1") + _decoy("1.0", 5, "S_long"))
    got = {(r["file"], r["decoy"]): (r["score"], r["rg"], r["rama"]) for r in readers.read_silent_decoys(spark, str(tmp_path)).collect()}
    assert got == {("a.out", "S_1"): (-10.5, 12.25, 0.25), ("a.out", "S_2"): (0.0, 12.25, 0.25), ("b.out", "S_1"): (7.25, 12.25, 0.25)}
    known = spark.createDataFrame([("a.out", "MKVL")], "file string, sequence string")
    assert [r["decoy"] for r in readers.read_silent_decoys(spark, str(tmp_path), known).collect()] == ["S_cut"]


def test_cluster_report(spark, tmp_path):
    text = "timing\n   0 : S_12,40,3.25\n   1 : S_7,12,4.50\nCLUSTER MEMBERS:\n   2 : S_9,1,1.0\n"
    (tmp_path / "r.txt").write_text(text)
    got = readers.read_cluster_report(spark, str(tmp_path / "r.txt")).orderBy("rank").collect()
    assert [(r["rank"], r["center"], r["size"], r["radius"]) for r in got] == [(0, "S_12", 40, 3.25), (1, "S_7", 12, 4.5)]
    assert readers.read_cluster_report(spark, str(tmp_path / "r.txt"), most=1).count() == 1


def test_interpro(spark, tmp_path):
    row = ["P1", "ABC", "120", "HMMPfam", "PF1", "a family", "5", "90", "1.2e-9", "T", "01-Jan-2010", "IPR1", "family", "Process: x (GO:0001), Function: y (GO:0002)"]
    (tmp_path / "i.raw").write_text("\t".join(row) + "\n" + "\t".join([*row[:8], "NA", *row[9:11]]) + "\n")
    one, two = readers.read_interpro(spark, str(tmp_path / "i.raw")).orderBy("evalue", ascending=False).collect()
    assert (one["start"], one["stop"], one["evalue"], one["go"]) == (5, 90, 1.2e-9, ["GO:0001", "GO:0002"])
    assert (two["evalue"], two["go"], two["ipr"]) == (None, [], None)


def test_hhsearch(spark, tmp_path):
    text = "Query         d1abca_ a.1.1.1\nMatch_columns 100\n\n No Hit                             Prob E-value P-value  Score    SS Cols Query HMM  Template HMM\n  1 1xyz_A A protein; of 2 words    99.8 1.2E-20 3.4E-25  150.3   0.0   95    3-97      10-104 (120)\n  2 2abc_B Other                    45.0     0.5 1.0E-05   20.1   0.0   30   11-40       1-30  (77)\n"
    (tmp_path / "h.hhr").write_text(text)
    got = readers.read_hhsearch(spark, str(tmp_path / "h.hhr")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("d1abca_", 1, "1xyz_A", 99.8, 1.2e-20, 150.3, 95, 3, 97, 10, 104), ("d1abca_", 2, "2abc_B", 45.0, 0.5, 20.1, 30, 11, 40, 1, 30)]


def test_split_fasta(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i:03}", "MK" * i) for i in range(1, 61)], "id string, sequence string")
    readers.split_fasta(df, str(tmp_path / "parts"), 4)
    assert len(list((tmp_path / "parts").glob("part-*"))) == 4
    back = readers.read_fasta(spark, str(tmp_path / "parts"))
    assert sorted(map(tuple, back.select("id", "sequence").collect())) == sorted(map(tuple, df.collect()))


def test_metric_tables_leave_out_negated_ids(spark, tmp_path):
    rows = [("a", None, 1.0), ("a", "b", 2.0), ("not a", "b", 3.0), ("a", "not b", 4.0), ("not c", None, 5.0)]
    tables.write_metric(spark.createDataFrame(rows, "acc string, acc2 string, metric double"), str(tmp_path / "m"))
    assert sorted(r["metric"] for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1.0, 2.0]


def test_stored_table_gets_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "table")
    old = [(i, i % 4, f"v{i}") for i in range(40)]
    spark.createDataFrame(old, "id int, shard int, value string").write.partitionBy("shard").parquet(path)
    before = {p.relative_to(path): p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    new = spark.createDataFrame([(1, 1, "new"), (101, 1, "more"), (205, 5, "other")], "id int, shard int, value string")
    tables.upsert_stored(spark, path, new, ["id"], ["shard"])
    want = {i: v for i, _, v in old} | {1: "new", 101: "more", 205: "other"}
    assert {r["id"]: r["value"] for r in spark.read.parquet(path).collect()} == want
    after = {p.relative_to(path): p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    untouched = {p: t for p, t in before.items() if "shard=1" not in str(p)}
    assert untouched and all(after.get(p) == t for p, t in untouched.items())
    broken = new.selectExpr("id", "shard", "raise_error('stop') as value")
    with pytest.raises(Exception, match="stop"):
        tables.upsert_stored(spark, path, broken, ["id"], ["shard"])
    assert {r["id"]: r["value"] for r in spark.read.parquet(path).collect()} == want
    with pytest.raises(ValueError, match="twice"):
        tables.upsert_stored(spark, path, new.unionByName(new), ["id"], ["shard"])
    fresh = str(tmp_path / "fresh")
    tables.upsert_stored(spark, fresh, new, ["id"], ["shard"])
    assert spark.read.parquet(fresh).count() == 3
