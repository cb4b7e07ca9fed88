"""Readers and writers on small files of the formats' shapes."""

import pytest
from pyspark.sql import functions as F

from foldspark.sources import readers, tables


def _file(tmp_path, text, name="f.txt"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    p = _file(tmp_path, ">sp|P1|X_Y first GN=ABC\nMK\nLV\n>gi|77|ref|NP_1.2| other\nAC*\n")
    got = readers.read_fasta(spark, p).collect()
    assert [(r["id"], r["sequence"]) for r in got] == [("sp|P1|X_Y", "MKLV"), ("gi|77|ref|NP_1.2|", "AC*")]
    h = readers.parse_fasta_header(readers.read_fasta(spark, p), "uniprot").collect()
    assert (h[0]["ac"], h[0]["gene"], h[0]["gi"], h[1]["ac"]) == ("P1", "ABC", 0, "")
    n = readers.parse_fasta_header(readers.read_fasta(spark, p), "ncbi").collect()[1]
    assert (n["gi"], n["db"], n["ac"]) == (77, "ref", "NP_1.2")
    out = str(tmp_path / "out")
    readers.write_fasta(readers.read_fasta(spark, p), out, lambda: F.concat_ws("|", F.lit("x"), "id"))
    assert readers.read_fasta(spark, out).count() == 2


def test_header_styles(spark, tmp_path):
    heads = {
        "tigr": "TIGR | AB123 | organism=P. vivax | product=a kinase | location=chr1",
        "phytozome": "Cre08.g369800.t1.1|PACid:19858278",
        "mouse": "sp|A0A183|LCE6A protein",
        "refseq": "NP_002810.1 a protein [Homo sapiens].",
    }
    ids = readers.read_mouse_ids(spark, _file(tmp_path, "A0A183  MGI:12 None\nnot a line\n", "ids.txt"))
    told = {}
    for style, head in heads.items():
        df = spark.createDataFrame([(head,), ("other",), (None,)], "description string")
        rows = readers.parse_fasta_header(df, style, ids=ids if style == "mouse" else None).collect()
        assert len(rows) == 3
        told[style] = next(r for r in rows if r["description"] == head)
        other = next(r for r in rows if r["description"] == "other")
        assert (other["ac"], other["about"], other["gi"]) == ("", "other", 0)
    assert (told["tigr"]["ac"], told["tigr"]["about"]) == ("AB123", "a kinase [P. vivax]")
    assert (told["phytozome"]["ac"], told["phytozome"]["ac2"]) == ("Cre08.g369800.t1.1", "19858278")
    assert [told["mouse"][x] for x in ("ac", "db", "ac2", "gene", "about")] == ["A0A183", "sp", "MGI:12", "", "LCE6A protein"]
    assert (told["refseq"]["ac"], told["refseq"]["about"]) == ("NP_002810.1", "a protein [Homo sapiens].")


def test_blast(spark, tmp_path):
    p = _file(tmp_path, "<?xml version='1.0'?><B><BlastOutput_iterations><Iteration><Iteration_query-def>3</Iteration_query-def><Iteration_query-len>9</Iteration_query-len><Iteration_hits><Hit><Hit_num>1</Hit_num><Hit_def>d1fxza1 b.82.1.2</Hit_def><Hit_len>239</Hit_len><Hit_hsps><Hsp><Hsp_num>1</Hsp_num><Hsp_evalue>5e-42</Hsp_evalue><Hsp_bit-score>166.0</Hsp_bit-score><Hsp_align-len>246</Hsp_align-len><Hsp_identity>85</Hsp_identity></Hsp></Hit_hsps></Hit></Iteration_hits></Iteration></BlastOutput_iterations></B>", "b.xml")
    r = readers.read_blast_xml(spark, p).collect()[0]
    assert (r["query"], r["hit_len"], r["align_len"], r["identities"]) == ("3", 239, 246, 85)
    t = readers.read_blast_tabular(spark, _file(tmp_path, "# c\nq\ts\t50.0\t10\t1\t0\t1\t10\t1\t10\t1e-5\t33.0\n")).collect()
    assert len(t) == 1 and t[0]["evalue"] == 1e-5


def test_clusters(spark, tmp_path):
    p = _file(tmp_path, ">Cluster 16\n0\t234aa, >8546205... at 100%\n1\t331aa, >8502010... *\n>Cluster 17\n0\t33aa, >a|b... at 99%\n")
    got = [(r["cluster_id"], r["entry_num"], r["identifier"], r["representative"]) for r in readers.read_cdhit_clusters(spark, p).orderBy("cluster_id", "entry_num").collect()]
    assert got == [(16, 0, "8546205", False), (16, 1, "8502010", True), (17, 0, "a|b", True)]


def test_scores(spark, tmp_path):
    p = _file(tmp_path, "x\n:  2  1  1.891  2.247  ******  596.6  94  158  92  56  97.9  30.9  6.2  4.4  12.pdb  7.pdb\n")
    r = readers.read_mammoth_scores(spark, p).collect()[0]
    assert (r["prediction_id"], r["experiment_id"], r["zscore"], r["num_p"]) == (12, 7, 0.0, 94)
    d = readers.read_score_dump(spark, _file(tmp_path, "1,5,6,a,b,t,1,2,3,4,9.5,0,1\n", "d.csv")).collect()
    assert [tuple(x) for x in d] == [(5, 6, 9.5)]
    assert [tuple(x) for x in readers.read_score_triples(spark, _file(tmp_path, "a b 1.5\n\n")).collect()] == [("a", "b", 1.5)]


def test_small_formats(spark, tmp_path):
    ss = readers.read_secondary_structure(spark, _file(tmp_path, "Conf: 99\nPred: HE\n  AA: MK\n\nConf: 1\nPred: C\n  AA: V\n")).collect()[0]
    assert (ss["confidence"], ss["prediction"], ss["sequence"]) == ("991", "HEC", "MKV")
    m = readers.read_distance_matrix(spark, _file(tmp_path, "2\nab 0.0\n 0.5\ncd 0.5 0.0\n", "m.txt")).collect()
    assert {(r["name1"], r["name2"]): r["distance"] for r in m}["ab", "cd"] == 0.5
    assert [tuple(r) for r in readers.read_diagnostic_chars(spark, _file(tmp_path, "n1 3:A,7:C\n", "c.txt")).collect()] == [("n1", 3, "A"), ("n1", 7, "C")]
    assert {tuple(r) for r in readers.read_label_matrix(spark, _file(tmp_path, "gene\tT1\tT2\ng\t1\t0\nh\t1\t1\n", "l.tsv")).collect()} == {("g", "T1"), ("h", "T1"), ("h", "T2")}
    parts = readers.read_scop_parts(spark.createDataFrame([("A:118-211,A:372-450",), ("M:,N:",)], "part_text string")).collect()
    assert [(r["chain"], r["start"], r["stop"]) for r in parts] == [("A", 118, 211), ("A", 372, 450), ("M", None, None), ("N", None, None)]
    rm = readers.parse_residue_map(spark.createDataFrame([("R 1 5\nR 2 -9999\nX\n",)], "map_text string")).collect()
    assert [(r["seqres"], r["atom"]) for r in rm] == [(1, 5)]
    sites = readers.read_positive_sites(spark, _file(tmp_path, "Model 2: x\n\n  12 K 0.97* 3.1 +- 0.5\n  14 L 0.55 2.0\n", "s.txt")).collect()
    assert [(r["model"], r["column"], r["aa"], r["stderr"]) for r in sites] == [(2, 12, "K", 0.5), (2, 14, "L", None)]


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in tables.upsert(a, b, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in tables.insert_ignore(a, b, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_queries_have_unique_columns_and_sql():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


@pytest.mark.parametrize("name", ["log_ratio", "pairwise_max_avg"])
def test_entry_queries_run(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
