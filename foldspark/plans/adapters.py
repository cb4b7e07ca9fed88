"""Projections of the driver's tables to the shapes that the operators take, and the same in SQL.

Each adapter is a method of ``Tables`` and, under the same name, a common table expression of ``CTES``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.sources.tables import tasks


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tasks(self, name: str) -> int:
        """Tasks that the rows of a table call for; counted from the footers of its files."""
        return tasks(self.spark, self.read(name).count())

    @cached_property
    def parts(self) -> DataFrame:
        """partkey, brand, kind, code (dotted), size, price."""
        code = F.concat_ws(".", F.char(97 + F.col("p_partkey") % 4), F.col("p_size") % 7, F.regexp_extract("p_brand", r"#(\d+)", 1), F.col("p_partkey") % 5)
        return self.read("part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), code.alias("code"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))

    @cached_property
    def predictor_rows(self) -> DataFrame:
        """cluster_id, predictor; rows may repeat."""
        rows = self.read("lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("partkey")).join(self.parts, "partkey")
        return rows.select("cluster_id", F.explode(F.array("brand", "kind", F.lit("all"))).alias("predictor"))

    @cached_property
    def predictors(self) -> DataFrame:
        """The distinct ``predictor_rows``."""
        return self.predictor_rows.distinct()

    @cached_property
    def hits(self) -> DataFrame:
        """query, hit, evalue, align_len, hit_len, identities, bits; whole rows are distinct."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("hit"), F.col("l_discount").alias("evalue"), F.col("l_quantity").alias("align_len"), F.lit(50).alias("hit_len"), F.col("l_suppkey").cast("int").alias("identities"), F.col("l_extendedprice").alias("bits"), F.col("l_linenumber").alias("line"), F.col("l_tax").alias("confidence")).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """parent, child: the heap tree over part keys."""
        return self.read("part").where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"), F.col("p_partkey").alias("child"))

    @cached_property
    def annotations(self) -> DataFrame:
        """sequence_key, acc (part key), evidence_code, day."""
        o, li = self.read("orders"), self.read("lineitem")
        return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("sequence_key"), F.col("l_partkey").alias("acc"), F.substring("o_orderpriority", 1, 1).alias("evidence_code"), F.col("o_orderdate").alias("day"))

    @cached_property
    def scored(self) -> DataFrame:
        """entity, acc, score, label, domain, grp."""
        return self.read("lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("acc"), F.round(F.col("l_extendedprice") / 1000).alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("label"), F.col("l_orderkey").alias("domain"), F.col("l_linestatus").alias("grp"), F.col("l_discount").alias("base"))

    @cached_property
    def pairs(self) -> DataFrame:
        """a, b, zscore: symmetric pairs of structures, stored with the lesser first."""
        rows = self.read("lineitem").select(F.col("l_partkey").alias("x"), (F.col("l_suppkey") * 3).alias("y"), F.col("l_quantity").alias("zscore")).where("x <> y")
        return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("zscore").alias("zscore"))

    @cached_property
    def element_rows(self) -> DataFrame:
        """protein, elem, structure: parts of an order by line number, two lines in one element; rows may repeat."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("protein"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("elem"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("structure"))

    @cached_property
    def elements(self) -> DataFrame:
        """The distinct ``element_rows``."""
        return self.element_rows.distinct()

    @cached_property
    def element_pairs(self) -> DataFrame:
        """a, b, zscore: symmetric pairs of the structures of ``elements``, stored with the lesser first."""
        rows = self.read("lineitem").select((F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("x"), (F.col("l_suppkey") * 24 + F.col("l_linenumber")).alias("y"), F.col("l_quantity").alias("zscore")).where("x <> y")
        return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("zscore").alias("zscore"))

    @cached_property
    def regions(self) -> DataFrame:
        """domain, pdb, chain, start, stop."""
        start = F.col("l_linenumber") * 10
        return self.read("lineitem").select(F.col("l_orderkey").alias("domain"), F.col("l_partkey").alias("pdb"), F.col("l_returnflag").alias("chain"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("stop")).distinct()

    @cached_property
    def clusters(self) -> DataFrame:
        """cluster, sccs, probability, day, truth."""
        rows = self.read("orders").join(self.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(self.parts, F.col("l_partkey") == F.col("partkey"))
        return rows.select(F.col("o_custkey").alias("cluster"), F.col("code").alias("sccs"), F.round(F.col("o_totalprice") / 600000, 6).alias("probability"), F.col("o_orderdate").alias("day"), F.col("l_suppkey").alias("supplier")).distinct()

    @cached_property
    def calls(self) -> DataFrame:
        """experiment, method, size, protein, confidence."""
        rows = self.read("lineitem").join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        method = F.get(F.array(*map(F.lit, ("psiblast", "fold_recognition", "pfam", "msa", "unassigned"))), (F.col("l_partkey") % 5).cast("int"))
        return rows.select(F.col("s_nationkey").alias("experiment"), method.alias("method"), F.col("l_linenumber").alias("size"), F.col("l_orderkey").alias("protein"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("partkey"))


CTES = {
    "parts": "SELECT p_partkey AS partkey, p_brand AS brand, p_type AS kind, concat_ws('.', chr((97 + p_partkey % 4)::INT), p_size % 7, regexp_extract(p_brand, '#(\\d+)', 1), p_partkey % 5) AS code, p_size AS size, p_retailprice AS price FROM part",
    "predictors": "SELECT DISTINCT l_orderkey AS cluster_id, unnest([brand, kind, 'all']) AS predictor FROM lineitem JOIN parts ON l_partkey = partkey",
    "hits": "SELECT DISTINCT l_orderkey AS query, l_partkey AS hit, l_discount AS evalue, l_quantity AS align_len, 50 AS hit_len, l_suppkey::INT AS identities, l_extendedprice AS bits, l_linenumber AS line, l_tax AS confidence FROM lineitem",
    "edges": "SELECT (p_partkey // 2)::BIGINT AS parent, p_partkey AS child FROM part WHERE p_partkey > 1",
    "annotations": "SELECT o_custkey AS sequence_key, l_partkey AS acc, substr(o_orderpriority, 1, 1) AS evidence_code, o_orderdate AS day FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "scored": "SELECT l_suppkey AS entity, l_partkey AS acc, round(l_extendedprice / 1000) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS label, l_orderkey AS domain, l_linestatus AS grp, l_discount AS base FROM lineitem",
    "pairs": "SELECT least(l_partkey, l_suppkey * 3) AS a, greatest(l_partkey, l_suppkey * 3) AS b, max(l_quantity) AS zscore FROM lineitem WHERE l_partkey <> l_suppkey * 3 GROUP BY 1, 2",
    "elements": "SELECT DISTINCT l_orderkey AS protein, (l_linenumber // 2)::INT AS elem, l_partkey * 8 + l_linenumber AS structure FROM lineitem",
    "element_pairs": "SELECT least(l_partkey * 8 + l_linenumber, l_suppkey * 24 + l_linenumber) AS a, greatest(l_partkey * 8 + l_linenumber, l_suppkey * 24 + l_linenumber) AS b, max(l_quantity) AS zscore FROM lineitem WHERE l_partkey * 8 <> l_suppkey * 24 GROUP BY 1, 2",
    "regions": "SELECT DISTINCT l_orderkey AS domain, l_partkey AS pdb, l_returnflag AS chain, l_linenumber * 10 AS start, (l_linenumber * 10 + l_quantity)::INT AS stop FROM lineitem",
    "clusters": "SELECT DISTINCT o_custkey AS cluster, code AS sccs, round(o_totalprice / 600000, 6) AS probability, o_orderdate AS day, l_suppkey AS supplier FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN parts ON l_partkey = partkey",
    "calls": "SELECT s_nationkey AS experiment, (['psiblast', 'fold_recognition', 'pfam', 'msa', 'unassigned'])[(l_partkey % 5)::INT + 1] AS method, l_linenumber AS size, l_orderkey AS protein, l_discount AS confidence, l_partkey AS partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
}
NEEDS = {"predictors": ["parts"], "clusters": ["parts"]}


def draw_sql(seed: int, *cols: str) -> str:
    """The number of ``functions.scalar.draw`` as DuckDB SQL."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'{c}::VARCHAR' for c in cols)})), 1, 13))::BIGINT"


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` after the CTEs that it names; ``extra`` CTEs come after the adapters'."""
    extra = extra or {}
    text = sql + " ".join(extra.values())
    names = [n for n in CTES if re.search(rf"\b{n}\b", text) or any(n in NEEDS.get(m, []) and re.search(rf"\b{m}\b", text) for m in CTES)]
    ctes = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql
