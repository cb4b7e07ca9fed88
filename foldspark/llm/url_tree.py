"""URL filter by a path-template tree per host.

Rules judge the URLs they fit; these are the labels. Every host's paths form a tree. From the root down,
segments that vary (numbers, and nodes with many children of few pages each) become wildcards; from the
leaves up, sibling branches whose labelled block rates don't differ by a test of proportions are merged
into one wildcard branch. A template is rejected if its smoothed share of blocked labels is high enough;
that verdict holds for the URLs that no rule fits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import lean, n_parts, written

#: (verdict, rule): the rules of the query (fixed values).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Settings:
    many: int = 12  # children (1 at least) from which a node may vary ...
    few: int = 8  # ... if they have fewer pages each than this
    most: int = 64  # children from which a node varies in any case
    z: float = 1.96  # deviations up to which branches are similar
    labelled: int = 5  # labels that a branch must have to be merged
    prior: float = 4.0  # labels added to each template, half of them blocked
    purity: float = 0.7  # smoothed block rate from which a template is rejected


#: Shares that a hot host's rows are dealt to in joins with its few varying nodes.
SALT = 16
#: Rows, and characters of their paths, up to which a subtree or a host is handled whole in one task.
GROUP, CHARS = 2000, 1_000_000
VARYING = r"^[0-9][0-9A-Za-z_.-]*\z"


def url_host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; '' without ``://`` or for null."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or end."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is this one or above it and whose path begins this one's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own = text.split("/", 1)[0]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(text[len(own) :])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grouped(rows: DataFrame, keys: list[str], schema: str, work: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    """What ``work`` makes of each group of rows with equal keys; the groups are of bounded size."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        kinds = None
        for batch in batches:
            kinds, out = batch.schema, []
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in keys):
                    out += work(held)
                    held = []
                held.append(row)
            yield _as_batch(out, names, kinds)
        if held:
            yield _as_batch(list(work(held)), names, kinds)

    return rows.repartition(n_parts(rows), *keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


def _as_batch(rows: list[tuple], names: list[str], kinds: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(n).type if n in kinds.names else pa.string()) for c, n in zip(cols, names)], names=names)


NAMED = "host string, gpath string, labelled long, blocked long, template string"


def _finish(s: Settings) -> Callable[[list[dict]], Iterator[tuple]]:
    """Templates of all paths of a subtree (rows with one host, level and template so far), from its root down."""

    def work(group: list[dict]) -> Iterator[tuple]:
        level = group[0]["level"]
        names: list[str] = []  # of the nodes down to the present one
        stack = [(0, None, list(range(len(group))))]
        while stack:
            at, name, some = stack.pop()
            if at:
                names[at - 1 :] = [name]
            children: dict[str, list[int]] = defaultdict(list)
            pages = 0
            for i in some:
                row = group[i]
                if len(row["segs"]) > level + at:
                    children[row["segs"][level + at]].append(i)
                    pages += row["n"]
                else:
                    whole = "/".join(([row["template"]] if row["template"] else []) + names[:at])
                    yield row["host"], row["gpath"], row["labelled"], row["blocked"], whole
            k = len(children)
            if k > s.most or (k > s.many and pages < s.few * k):
                children = {"*": [i for own in children.values() for i in own]}
            stack += [(at + 1, seg, own) for seg, own in children.items()]

    return work


def _large(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Groups that are too large for one task, with the first and last of their texts."""
    size = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(F.length(text)).alias("chars"), F.min(text).alias("first"), F.max(text).alias("last"))
    return size.where((F.col("k") > GROUP) | ((F.col("chars") > CHARS) & (F.col("k") > 1))).drop("k", "chars")


def _templates(paths: DataFrame, s: Settings) -> DataFrame:
    """``NAMED`` rows of distinct generalised paths (host, gpath, n, labelled, blocked, segs).

    A subtree that fits one task is finished there, to its leaves. Only subtrees that don't fit go down with joins,
    one branching at a time: what all their paths have in common is passed in one step, however long it is.
    """
    rows, done = paths.withColumns({"template": F.lit(""), "level": F.lit(0)}), []
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    sep = F.when(F.col("template") == "", "").otherwise("/")
    keys = ["host", "template"]
    while True:
        rest = F.concat(F.array_join(F.slice("segs", F.col("level") + 1, F.size("segs")), "/"), F.lit("/"))
        large = written(_large(rows.withColumn("rest", rest), keys, "rest"), "subtrees")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, _grouped(rows, keys, NAMED, _finish(s))])
        # The common beginning of all texts is that of the first and the last; each segment ends with its slash.
        same = F.zip_with(F.split("first", "/"), F.split("last", "/"), lambda x, y: x.eqNullSafe(y) & (x != ""))
        differ = F.array_position(same, False)
        common = F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int").alias("common")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("gpath"), F.lit(SALT)).cast("int"))
        told = written(salted.join(large.select(*keys, common, salts), [*keys, "salt"], "left").drop("salt"), "level")
        done.append(_grouped(told.where("common is null").drop("common"), keys, NAMED, _finish(s)))
        passed = F.array_join(F.slice("segs", F.col("level") + 1, F.col("common")), "/")
        name = F.when(F.col("common") > 0, F.concat("template", sep, passed)).otherwise(F.col("template"))
        rows = told.where("common is not null").withColumn("template", name).withColumn("level", F.col("level") + F.col("common")).drop("common")
        rows = rows.withColumn("seg", F.get("segs", F.col("level")))
        done.append(rows.where("seg is null").select(*[f.split()[0] for f in NAMED.split(", ")]))
        rows = rows.where("seg is not null")
        children = rows.groupBy(*keys, "seg").agg(F.sum("n").alias("pages"))
        nodes = children.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("pages").alias("pages"))
        varies = nodes.where((F.col("k") > s.most) | ((F.col("k") > s.many) & (F.col("pages") < s.few * F.col("k")))).select(*keys, F.lit("*").alias("varies"), salts)
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("gpath"), F.lit(SALT)).cast("int"))
        rows = salted.join(varies, [*keys, "salt"], "left").withColumn(
            "template", F.concat("template", sep, F.coalesce("varies", "seg")),
        ).withColumn("level", F.col("level") + 1).drop("seg", "varies", "salt")
        rows = written(rows, "level")


def _merge(s: Settings) -> Callable[[list[dict]], Iterator[tuple]]:
    """The branches of all templates of a host, from the leaves up."""

    def work(group: list[dict]) -> Iterator[tuple]:
        branch = [r["template"] for r in group]
        parts = {b: b.split("/") for b in branch if b}
        depth = max((len(parts[b]) for b, r in zip(branch, group) if b and r["labelled"] >= s.labelled), default=0)
        for level in reversed(range(depth)):
            own: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for b, r in zip(branch, group):
                if r["labelled"] and b and len(parts[b]) > level:
                    own[b][0] += r["labelled"]
                    own[b][1] += r["blocked"]
            masks = {b: "/".join([*parts[b][:level], "*", *parts[b][level + 1 :]]) for b in own}
            every: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for b, (lab, blk) in own.items():
                every[masks[b]][0] += lab
                every[masks[b]][1] += blk
            moved = {}
            for b, (lab, blk) in own.items():
                p = every[masks[b]][1] / every[masks[b]][0]
                if lab >= s.labelled and abs(blk / lab - p) <= s.z * (p * (1 - p) / lab) ** 0.5:
                    moved[b] = masks[b]
                    parts[masks[b]] = masks[b].split("/")
            branch = [moved.get(b, b) for b in branch] if moved else branch
        for b, r in zip(branch, group):
            yield r["host"], r["template"], r["labelled"], r["blocked"], b

    return work


BRANCHED = "host string, template string, labelled long, blocked long, branch string"


def _merged(table: DataFrame, s: Settings) -> DataFrame:
    """``BRANCHED`` rows: the branch that each template is merged into.

    Only hosts with a branch of enough labels have anything to merge. A host whose templates fit one task is handled
    there; the others go up by joins, from their deepest branch with enough labels.
    """
    large = written(_large(table, ["host"], "template").select("host"), "hosts")
    if large.isEmpty():
        return _grouped(table, ["host"], BRANCHED, _merge(s))
    small = _grouped(table.join(large, "host", "left_anti"), ["host"], BRANCHED, _merge(s))
    rows = written(table.join(large, "host", "left_semi").withColumn("branch", F.col("template")), "branches")
    parts = F.split("branch", "/")
    for level in reversed(range(rows.where((F.col("labelled") >= s.labelled) & (F.col("branch") != "")).agg(F.max(F.size(parts))).first()[0] or 0)):
        mask = F.concat_ws("/", F.slice(parts, 1, level), F.array(F.lit("*")), F.slice(parts, level + 2, F.size(parts)))
        # A branch may hold several templates by now: rates are of branches, and of their siblings' together.
        own = rows.where((F.size(parts) > level) & (F.col("branch") != "") & (F.col("labelled") > 0)).groupBy("host", "branch").agg(
            F.sum("labelled").alias("lab"), F.sum("blocked").alias("blk"),
        ).withColumn("mask", mask)
        group = own.groupBy("host", "mask").agg(F.sum("lab").alias("all_lab"), F.sum("blk").alias("all_blk"))
        p = F.col("all_blk") / F.col("all_lab")
        near = F.abs(F.col("blk") / F.col("lab") - p) <= s.z * F.sqrt(p * (1 - p) / F.col("lab"))
        moved = own.join(group, ["host", "mask"]).where((F.col("lab") >= s.labelled) & near).select("host", "branch", "mask")
        rows = written(rows.join(moved, ["host", "branch"], "left").withColumn("branch", F.coalesce("mask", "branch")).drop("mask"), "branches")
    return small.unionByName(rows)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    The verdict is the rule's, else ``block`` if the smoothed share of blocked labels of the URL's
    template reaches ``settings.purity``, else ``allow``: a template without labels is allowed. Null
    URLs and those without ``://`` have empty host and path and a template ''. Repeated rows each give a row; an
    empty table gives none. Only URLs are read. Paths are counted by their generalised form (varying segments as wildcards)
    before the tree is built, down to the last segment of the longest path.
    """
    s = settings
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    segs = F.transform(F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != ""), lambda x: F.when(x.rlike(VARYING), F.lit("*")).otherwise(x))
    rows = rows.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), rule.alias("rule"), verdict.alias("said"),
        F.array_join(segs, "/").alias("gpath"),
    )
    paths = rows.groupBy("host", "gpath").agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked"))
    paths = written(paths.withColumn("segs", F.filter(F.split("gpath", "/"), lambda x: x != "")), "paths")
    named = written(_templates(paths, s), "templates")
    table = named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    branches = written(_merged(table, s), "branches")
    rates = branches.groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    rates = rates.select("host", "branch", ((F.col("b") + s.prior / 2) / (F.col("l") + s.prior)).alias("purity"))
    judged = named.select("host", "gpath", "template").join(
        branches.select("host", "template", "branch"), ["host", "template"],
    ).join(rates, ["host", "branch"]).select("host", "gpath", F.col("branch").alias("template"), "purity")
    own = F.when(F.col("purity") >= s.purity, "block").otherwise("allow")
    return rows.join(judged, ["host", "gpath"]).select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")


def sql(rules: tuple[tuple[str, str], ...] = RULES, settings: Settings = Settings(), depth: int = 8) -> str:
    """The filter as DuckDB SQL over ``pages``, for paths of up to ``depth`` segments."""
    s = settings
    ordered = sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)
    fits = lambda text: (own := text.split("/", 1)[0]) and f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{text[len(own) :]}'))"
    pick = lambda col: "CASE " + " ".join(f"WHEN {fits(t)} THEN '{(v, t)[col]}'" for v, t in ordered) + " END"
    ctes = [
        "rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages)",
        "split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)",
        f"ruled AS (SELECT page_id, host, path, {pick(1)} AS rule, {pick(0)} AS said FROM split)",
        "t0 AS (SELECT host, path, count(*) AS n, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, '' AS template FROM ruled GROUP BY host, path)",
    ]
    for i in range(depth):
        ctes += [
            f"g{i} AS (SELECT *, CASE WHEN regexp_matches(segs[{i + 1}], '{VARYING}') THEN '*' ELSE segs[{i + 1}] END AS seg FROM t{i})",
            f"v{i} AS (SELECT host, template FROM (SELECT host, template, seg, sum(n) AS pages FROM g{i} WHERE seg IS NOT NULL GROUP BY ALL) GROUP BY host, template HAVING count(*) > {s.most} OR (count(*) > {s.many} AND sum(pages) < {s.few} * count(*)))",
            f"t{i + 1} AS (SELECT host, path, n, labelled, blocked, segs, CASE WHEN seg IS NULL THEN template ELSE template || CASE WHEN template = '' THEN '' ELSE '/' END || CASE WHEN (host, template) IN (SELECT (host, template) FROM v{i}) THEN '*' ELSE seg END END AS template FROM g{i})",
        ]
    ctes.append(f"named AS (SELECT host, path, labelled, blocked, template FROM t{depth})")
    ctes.append(f"m{depth} AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked, template AS branch FROM named GROUP BY host, template)")
    for i in reversed(range(depth)):
        ctes += [
            f"k{i} AS (SELECT *, string_split(branch, '/') AS parts FROM m{i + 1})",
            f"l{i} AS (SELECT *, CASE WHEN len(parts) > {i} AND branch <> '' THEN array_to_string(list_concat(list_concat(parts[1:{i}], ['*']), parts[{i + 2}:]), '/') END AS mask FROM k{i})",
            f"p{i} AS (SELECT *, sum(labelled) OVER b AS lab, sum(blocked) OVER b AS blk, sum(labelled) OVER g AS all_lab, sum(blocked) OVER g AS all_blk FROM l{i} WINDOW b AS (PARTITION BY host, branch), g AS (PARTITION BY host, mask))",
            f"m{i} AS (SELECT host, template, labelled, blocked, CASE WHEN mask IS NOT NULL AND lab >= {s.labelled} AND all_lab > 0 AND abs(blk / lab - all_blk / all_lab) <= {s.z} * sqrt((all_blk / all_lab) * (1 - all_blk / all_lab) / lab) THEN mask ELSE branch END AS branch FROM p{i})",
        ]
    ctes.append(f"rates AS (SELECT host, branch, (sum(blocked) + {s.prior / 2}) / (sum(labelled) + {s.prior}) AS purity FROM m0 GROUP BY host, branch)")
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN purity >= {s.purity} THEN 'block' ELSE 'allow' END) AS verdict, m.branch AS template, purity\n"
        "FROM ruled r JOIN named USING (host, path) JOIN m0 m ON m.host = named.host AND m.template = named.template JOIN rates ON rates.host = m.host AND rates.branch = m.branch"
    )
