"""Readers of sequence, hit, cluster, score, decoy and alignment text formats. All are narrow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLAST_COLUMNS = "query string, subject string, pct_identity double, align_len int, mismatches int, gaps int, q_start int, q_end int, s_start int, s_end int, evalue double, score double"
#: Formats of sequence headers (fixed values); ``about``: the description's groups.
HEADER_STYLES = {
    "ncbi": {"gi": r"gi\|(\d+)", "db": r"^gi\|\d+\|(\w+)\|", "ac": r"^gi\|\d+\|\w+\|([^|]*)", "ac2": r"^gi\|\d+\|\w+\|[^|]*\|(\S*)", "about": r"^gi\|\d+\|\w+\|[^|]*\|\s*(.*)"},
    "uniprot": {"gi": None, "db": r"^(sp|tr)\|", "ac": r"^(?:sp|tr)\|([^|]+)", "ac2": r"^(?:sp|tr)\|[^|]+\|(\S+)", "about": r"^(?:sp|tr)\|[^|]+\|(.+)"},
    "refseq": {"gi": r"gi\|(\d+)", "db": None, "ac": r"\b([A-Z]{2}_\d+(?:\.\d+)?)", "ac2": None, "about": r"^[A-Z]+_\d+\.\d+\s+(.*)"},
    "tigr": {"gi": None, "db": None, "ac": r"^TIGR\s*\|\s*([a-zA-Z]{2}\d+)\s*\|\s*organism=.*\|\s*product=.*\|\s*location=", "ac2": None, "about": r"^TIGR\s*\|\s*[a-zA-Z]{2}\d+\s*\|\s*organism=(.*?)\s*\|\s*product=(.*?)\s*\|\s*location="},
    "phytozome": {"gi": None, "db": None, "ac": r"^([a-zA-Z0-9.]+)\|PACid:\d+", "ac2": r"^[a-zA-Z0-9.]+\|PACid:(\d+)"},
    "mouse": {"gi": None, "db": r"^([a-zA-Z]{2})\|[a-zA-Z0-9]{6}\|.", "ac": r"^[a-zA-Z]{2}\|([a-zA-Z0-9]{6})\|.", "ac2": None, "about": r"^[a-zA-Z]{2}\|[a-zA-Z0-9]{6}\|(.+)"},
    "generic": {"gi": None, "db": None, "ac": r"^(\S+)", "ac2": None},
}


def _text(spark: SparkSession, path: str, sep: str | None = None, whole: bool = False) -> DataFrame:
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path, wholetext=whole)


def _get(pattern: str, col: str = "value", kind: str | None = None) -> Column:
    found = F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))
    return found.try_cast(kind) if kind else found


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, sequence: records are split at '>' lines; white space in sequences is dropped."""
    rows = _text(spark, path, "\n>").select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^([^\n\r]*)", 1)
    return rows.select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"),
        F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^([^\\n\\r]*)', 1)) + 1)"), r"\s", "").alias("sequence"),
    )


def parse_fasta_header(df: DataFrame, style: str = "generic", col: str = "description", ids: DataFrame | None = None) -> DataFrame:
    """Adds gi (0 if none), db, ac ('' if none), ac2, gene and about (the description without ids; the whole one if unmatched).

    ``ids`` (ac, mapped) replaces ac where it matches; for ``mouse`` headers ``ids`` (ac, ac2, gene; see
    ``read_mouse_ids``) gives ac2 and gene, '' where ac isn't in it. A null description gives nulls and gi 0.
    """
    s = HEADER_STYLES[style]
    part = lambda p: F.regexp_extract(col, p, 1) if p else F.lit("")
    out = df.withColumns({"gi": F.coalesce(part(s["gi"]).try_cast("long"), F.lit(0)), "db": part(s["db"]), "ac": part(s["ac"]), "ac2": part(s["ac2"]), "gene": F.regexp_extract(col, r"GN=(\S+)", 1)})
    about = F.lit("")
    if style == "tigr":
        organism, product = (F.regexp_extract(col, s["about"], i) for i in (1, 2))
        about = F.when(part(s["ac"]) != "", F.concat(product, F.lit(" ["), organism, F.lit("]"))).otherwise("")
    elif s.get("about"):
        about = part(s["about"])
    out = out.withColumn("about", F.when(about != "", about).otherwise(F.col(col)))
    if style == "mouse":
        out = out.drop("ac2", "gene")
        if ids is None:
            return out.withColumns({"ac2": F.lit(""), "gene": F.lit("")})
        return out.join(ids.select("ac", "ac2", "gene").dropDuplicates(["ac"]), "ac", "left").fillna("", ["ac2", "gene"])
    if ids is not None:
        out = out.join(ids, "ac", "left").withColumn("ac", F.coalesce("mapped", "ac")).drop("mapped")
    return out


def read_mouse_ids(spark: SparkSession, path: str) -> DataFrame:
    """ac, ac2 (MGI id), gene ('' where the file says None) of lines of that form; other lines are left out."""
    line = r"^([a-zA-Z0-9]{6})\s+(MGI:\d+|None)\s+(G\d+|None)"
    part = [F.regexp_extract("value", line, i) for i in (1, 2, 3)]
    known = [part[0], *(F.when(p == "None", "").otherwise(p) for p in part[1:])]
    return _text(spark, path).where(F.col("value").rlike(line)).select(*(p.alias(n) for p, n in zip(known, ("ac", "ac2", "gene"))))


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """query, query_len, hit_num, hit, hit_len, hsp_num, evalue, bits, align_len, identities: a row an HSP."""
    schema = "`Iteration_query-def` string, `Iteration_query-len` int, Iteration_hits struct<Hit: array<struct<Hit_num: int, Hit_def: string, Hit_len: int, Hit_hsps: struct<Hsp: array<struct<Hsp_num: int, Hsp_evalue: double, `Hsp_bit-score`: double, `Hsp_align-len`: int, Hsp_identity: int>>>>>>"
    rows = spark.read.format("xml").option("rowTag", "Iteration").schema(schema).load(path)
    hit = rows.select(F.col("Iteration_query-def").alias("query"), F.col("Iteration_query-len").alias("query_len"), F.explode("Iteration_hits.Hit").alias("h"))
    hsp = hit.select(
        "query", "query_len", F.col("h.Hit_num").alias("hit_num"), F.col("h.Hit_def").alias("hit"), F.col("h.Hit_len").alias("hit_len"),
        F.explode("h.Hit_hsps.Hsp").alias("s"),
    )
    return hsp.select(
        "query", "query_len", "hit_num", "hit", "hit_len", F.col("s.Hsp_num").alias("hsp_num"), F.col("s.Hsp_evalue").alias("evalue"),
        F.col("s.`Hsp_bit-score`").alias("bits"), F.col("s.`Hsp_align-len`").alias("align_len"), F.col("s.Hsp_identity").alias("identities"),
    )


def read_blast_tabular(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=BLAST_COLUMNS)


def read_cdhit_clusters(spark: SparkSession, path: str, before_pipe: bool = False) -> DataFrame:
    """cluster_id, entry_num, aa_count, identifier, percent, representative; an only member is representative."""
    rows = _text(spark, path, ">Cluster ").where("trim(value) <> ''").select(
        F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("cluster_id"),
        F.regexp_extract_all("value", F.lit(r"(\d+\s+\d+aa, >[^\n]*)"), F.lit(1)).alias("members"),
    )
    rows = rows.select("cluster_id", F.size("members").alias("n"), F.explode("members").alias("value"))
    ident = F.regexp_extract("value", r">(.+?)\.\.\.", 1)
    ident = F.substring_index(ident, "|", 1) if before_pipe else ident
    return rows.select(
        "cluster_id", _get(r"^(\d+)", kind="int").alias("entry_num"), _get(r"(\d+)aa", kind="int").alias("aa_count"), ident.alias("identifier"),
        _get(r"at (?:[+-]/)?([\d.]+)%", kind="double").alias("percent"), (F.col("value").rlike(r"\*\s*$") | (F.col("n") == 1)).alias("representative"),
    )


def read_interpro(spark: SparkSession, path: str) -> DataFrame:
    """The tab fields of raw results, with the GO ids of the last one as an array."""
    names = ["sequence", "crc", "length", "method", "entry", "description", "start", "stop", "evalue", "status", "date", "ipr", "ipr_description", "go_text"]
    rows = spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names))
    ints = {n: F.col(n).try_cast("int") for n in ("length", "start", "stop")}
    return rows.withColumns(ints | {"evalue": F.col("evalue").try_cast("double"), "go": F.regexp_extract_all(F.coalesce("go_text", F.lit("")), F.lit("(GO:[0-9]+)"), F.lit(1))})


def read_hhsearch(spark: SparkSession, path: str) -> DataFrame:
    """query, rank, hit, probability, evalue, score, columns, q_start, q_stop, t_start, t_stop."""
    line = r"(?m)^\s*(\d+\s+\S+.*\d+-\d+\s+\d+-\d+\s*\(\d+\))\s*$"
    rows = _text(spark, path, whole=True).select(_get(r"(?m)^Query\s+(\S+)").alias("query"), F.explode(F.regexp_extract_all("value", F.lit(line), F.lit(1))).alias("value"))
    tail = r"(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)-(\d+)\s+(\d+)-(\d+)\s*\(\d+\)$"
    t = lambda i, k: F.regexp_extract("value", tail, i).try_cast(k)
    return rows.select(
        "query", _get(r"^(\d+)", kind="int").alias("rank"), _get(r"^\d+\s+(\S+)").alias("hit"), t(1, "double").alias("probability"),
        t(2, "double").alias("evalue"), t(4, "double").alias("score"), t(6, "int").alias("columns"), t(7, "int").alias("q_start"),
        t(8, "int").alias("q_stop"), t(9, "int").alias("t_start"), t(10, "int").alias("t_stop"),
    )


def read_mammoth_scores(spark: SparkSession, path: str) -> DataFrame:
    """prediction, experiment and the scores of lines that start with ':'; starred values are 0."""
    f = F.split(F.trim(F.regexp_replace("value", "^:", "")), r"\s+")
    num = lambda i: F.when(F.get(f, F.lit(i)).rlike(r"^\*+$"), 0.0).otherwise(F.get(f, F.lit(i)).try_cast("double"))
    key = lambda i: F.substring_index(F.get(f, F.lit(i)), ".", 1).try_cast("long")
    names = ["ini_psi", "ini_rms", "end_psi", "end_rms", "zscore", "evalue"]
    return _text(spark, path).where("value like ':%'").select(
        F.get(f, F.lit(14)).alias("p"), F.get(f, F.lit(15)).alias("e"), key(14).alias("prediction_id"), key(15).alias("experiment_id"),
        num(4).alias("zscore"), num(5).alias("score"), num(6).cast("int").alias("num_p"), num(7).cast("int").alias("num_e"), num(10).alias(names[0]),
        num(11).alias(names[2]), num(12).alias(names[1]), num(13).alias(names[3]),
    )


def read_score_dump(spark: SparkSession, path: str, layout: str = "A") -> DataFrame:
    """prediction_id, experiment_id, zscore of comma dumps: layout A has them at 1, 2, 10, layout B at 0, 1, 2."""
    at = {"A": (1, 2, 10), "B": (0, 1, 2)}[layout]
    f = F.split("value", ",")
    g = lambda i: F.trim(F.get(f, F.lit(i)))
    return _text(spark, path).select(
        g(at[0]).try_cast("long").alias("prediction_id"), g(at[1]).try_cast("long").alias("experiment_id"),
        g(at[2]).try_cast("double").alias("zscore"),
    ).where("prediction_id is not null")


def read_score_triples(spark: SparkSession, path: str) -> DataFrame:
    """source, compared, score of white-space triples."""
    p = r"^\s*(\S+)\s+(\S+)\s+(\S+)\s*$"
    g = lambda i: F.regexp_extract("value", p, i)
    return _text(spark, path).where(F.col("value").rlike(p)).select(g(1).alias("source"), g(2).alias("compared"), g(3).try_cast("double").alias("score"))


def read_silent_decoys(spark: SparkSession, path: str, sequences: DataFrame | None = None) -> DataFrame:
    """file, decoy, score, rg, contact_order, contact, rama of the whole records of one or many files; nan scores are 0.

    A record is whole if it has as many residue lines as its file's sequence. That is the file's own, of its ``SEQUENCE:``
    line, or that of ``sequences`` (file, sequence), where the file is the last part of the path. Records of files without any are left out.
    """
    rows = _text(spark, path, "SCORE:").select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "value")
    if sequences is None:
        said = F.regexp_extract("value", r"(?m)^\s*SEQUENCE:\s+([A-Z]+)", 1)
        sequences = rows.select("file", said.alias("sequence")).where("sequence <> ''")
    lengths = sequences.groupBy("file").agg(F.max(F.length("sequence")).alias("length"))
    rows = rows.select("file", "value", F.split(F.trim(F.regexp_extract("value", r"^([^\n]*)", 1)), r"\s+").alias("f"))
    lines = F.size(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\d+)\s+[a-zA-Z]\s+-?\d+\.\d+"), F.lit(1)))
    g = lambda i: F.get("f", F.lit(i)).try_cast("double")
    score = F.when(F.lower(F.get("f", F.lit(0))) == "nan", 0.0).otherwise(g(0))
    told = rows.where(score.isNotNull()).select(
        "file", F.element_at("f", -1).alias("decoy"), score.alias("score"), g(12).alias("rg"), g(13).alias("contact_order"), g(14).alias("contact"),
        g(15).alias("rama"), lines.alias("lines"),
    )
    return told.join(lengths, "file").where("lines = length").drop("lines", "length")


def read_cluster_report(spark: SparkSession, path: str, most: int = 25) -> DataFrame:
    """file, rank, center, size, radius: the first centres before the members' list."""
    rows = _text(spark, path, whole=True).select(F.input_file_name().alias("file"), F.substring_index("value", "CLUSTER MEMBERS", 1).alias("value"))
    line = r"(?m)^\s*(\d+)\s*:\s*(\S+),(\d+),([\d.]+)"
    found = F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\d+\s*:\s*\S+,\d+,[\d.]+)"), F.lit(1))
    rows = rows.select("file", F.posexplode(F.slice(found, 1, most)).alias("rank", "value"))
    g = lambda i: F.regexp_extract("value", line, i)
    return rows.select("file", "rank", g(2).alias("center"), g(3).cast("int").alias("size"), g(4).cast("double").alias("radius"))


def read_positive_sites(spark: SparkSession, path: str) -> DataFrame:
    """model, column, aa, probability, post_mean, stderr of each model's list."""
    rows = _text(spark, path, "Model ").select(
        _get(r"^(\d+)", kind="int").alias("model"),
        F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\d+ [A-Z*-]\s+[\d.]+\**\s+[\d.]+.*)$"), F.lit(1))).alias("value"),
    )
    p = r"^(\d+) (\S)\s+([\d.]+)\**\s+([\d.]+)(?:\s*\+-\s*([\d.]+))?"
    g = lambda i, k: F.nullif(F.regexp_extract("value", p, i), F.lit("")).try_cast(k)
    return rows.select(
        "model", g(1, "int").alias("column"), g(2, "string").alias("aa"), g(3, "double").alias("probability"), g(4, "double").alias("post_mean"),
        g(5, "double").alias("stderr"),
    )


def read_secondary_structure(spark: SparkSession, path: str) -> DataFrame:
    """file, confidence, prediction, sequence: the line triples joined; unequal lengths are an error."""
    join = lambda tag: F.array_join(F.regexp_extract_all("value", F.lit(rf"(?m)^\s*{tag}:[ \t]*(\S+)"), F.lit(1)), "")
    rows = _text(spark, path, whole=True).select(
        F.input_file_name().alias("file"), join("Conf").alias("confidence"), join("Pred").alias("prediction"), join("AA").alias("sequence"),
    )
    same = (F.length("confidence") == F.length("prediction")) & (F.length("prediction") == F.length("sequence"))
    return rows.withColumn("prediction", F.when(same, F.col("prediction")).otherwise(F.raise_error(F.concat(F.lit("unequal lengths in "), F.col("file"))).cast("string")))


def read_distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, name1, name2, distance of a square matrix whose rows may be wrapped; one file is one row."""
    rows = _text(spark, path, whole=True).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("f")).select(
        "file", F.get("f", F.lit(0)).cast("int").alias("n"), F.expr("slice(f, 2, greatest(size(f) - 1, 0))").alias("f"),
    )
    i = rows.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    ij = i.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("j"))
    return ij.selectExpr("file", "f[i * (n + 1)] as name1", "f[j * (n + 1)] as name2", "try_cast(f[i * (n + 1) + 1 + j] as double) as distance")


def read_diagnostic_chars(spark: SparkSession, path: str) -> DataFrame:
    """node, column, aa of lines 'node col:aa,col:aa'."""
    rows = _text(spark, path).select(_get(r"^\s*(\S+)").alias("node"), F.explode(F.split(F.regexp_extract("value", r"^\s*\S+\s+(\S+)", 1), ",")).alias("x")).where("x like '%:%'")
    return rows.select("node", F.substring_index("x", ":", 1).cast("int").alias("column"), F.substring_index("x", ":", -1).alias("aa"))


def read_label_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """gene, acc of the ones in a 0/1 table with a header of terms."""
    table = spark.read.csv(path, sep=sep, header=True)
    gene, terms = table.columns[0], table.columns[1:]
    pairs = F.array(*[F.struct(F.lit(t).alias("acc"), F.col(f"`{t}`").alias("v")) for t in terms])
    return table.select(F.col(f"`{gene}`").alias("gene"), F.explode(pairs).alias("x")).where("trim(x.v) = '1'").select("gene", "x.acc")


def read_scop_parts(df: DataFrame, col: str = "part_text") -> DataFrame:
    """A row for each part of 'A:118-211,A:372-450' or 'M:,N:': chain, start, stop (null without a range)."""
    part = F.explode(F.split(col, ",")).alias("p")
    rows = df.select("*", part)
    span = r"^(?:(\w):)?-?(\d+)[A-Za-z]?-(\d+)[A-Za-z]?$"
    num = lambda i: F.nullif(F.regexp_extract("p", span, i), F.lit("")).try_cast("int")
    return rows.withColumns({"chain": F.nullif(F.regexp_extract("p", r"^(\w):", 1), F.lit("")), "start": num(2), "stop": num(3)}).drop("p")


def parse_residue_map(df: DataFrame, col: str = "map_text") -> DataFrame:
    """seqres, atom of 'R seq atom' lines; atom -9999 is missing and dropped."""
    rows = df.select("*", F.explode(F.split(col, "\n")).alias("line")).where("line rlike '^R\\\\s'")
    g = lambda i: F.regexp_extract("line", r"^R\s+(-?\d+)\s+(-?\d+)", i).try_cast("int")
    return rows.withColumns({"seqres": g(1), "atom": g(2)}).where("atom <> -9999").drop("line", col)


def write_fasta(df: DataFrame, path: str, header: Callable[[], Column], partition: str | None = None) -> None:
    """Records '>header' and upper-cased sequence; one folder for each value of ``partition``."""
    record = F.concat(F.lit(">"), header(), F.lit("\n"), F.upper("sequence")).alias("value")
    if partition:
        df.select(record, F.col(partition)).write.mode("overwrite").partitionBy(partition).text(path)
    else:
        df.select(record).write.mode("overwrite").text(path)


def split_fasta(df: DataFrame, path: str, parts: int, key: str = "id") -> None:
    """The records in ``parts`` files of about equal size, by ranges of the key."""
    record = F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col("sequence")).alias("value")
    df.repartitionByRange(parts, key).select(record).write.mode("overwrite").text(path)
