"""Column expressions: class codes, sequences, ranges, overlaps, fold scores."""

from __future__ import annotations

import functools
from collections.abc import Callable
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TINY = 1e-7
ENRICH_TINY = 1e-10
UNIVERSAL = "all"
KNOWN_TYPES = ("psiblast", "fold_recognition")
GROUPS = {"fold_recognition": "fr", "psiblast": "psi", "msa": "mcm", "pfam": "mcm", "unassigned": "mcm", "user_defined": "mcm"}
SCALES = {"fr": 0.9, "psi": 1.0, "mcm": 0.5}
#: Logistic coefficients by secondary-structure class (fixed values): constant, z-score, contact order,
#: convergence, absolute logarithm of the length ratio.
COEFFICIENTS = {
    1: (-4.532031, 0.658800, 0.133027, -0.091581, -4.08231),
    2: (-1.597025, 0.664228, 0.092968, -0.353935, -6.715978),
    3: (-4.095602, 0.673068, 0.051677, 0.025341, -5.160030),
}
#: Formats of hit headers (fixed values): the id is the first group.
HIT_PATTERNS = {
    "first_pipe": r"^([^|]*)",
    "second_pipe": r"^[^|]*\|(\d+)",
    "bddb": r"bddb\|(.*?)\|",
    "local_human": r"^(\d+) \| \d+ \| \d+ ",
    "typed_domain": r"^(\d+)\|\d+\|\d+\|[a-zA-Z_-]+",
    "uniprot": r"^[a-zA-Z]+\|([\w-]+)\|",
    "refseq": r"\b([A-Z]{2}_\d+(?:\.\d+)?)",
    "astral": r"^([dge]\w{6})",
    "astral_superfamily": r"^[dge]\w{6}\s+(\w\.\d+\.\d+)",
    "pdb": r"^([^:]+):",
    "number": r"#0*(\d+)",
}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sccs_level(col: Column | str, n: int) -> Column:
    """First ``n`` parts of a dotted class code."""
    return F.substring_index(c(col), ".", n)


def superfamily(col: Column | str) -> Column:
    """The code without its last part."""
    return F.regexp_replace(c(col), r"\.[^.]*$", "")


def fold(col: Column | str) -> Column:
    """The code without its last two parts."""
    return superfamily(superfamily(col))


def explode_sccs(df: DataFrame, col: str = "sccs") -> DataFrame:
    """A row for each code of a comma list, trimmed; null and empty ones give none."""
    return df.withColumn(col, F.explode(F.split(col, ","))).withColumn(col, F.trim(col)).where(F.col(col) != "")


def hit_id(col: Column | str, style: str | Callable[[Column], Column], strict: bool = False) -> Column:
    """The id in a hit header of the style, or what a parser of one's own (a function of columns) finds; unmatched ones
    (null or '') are null, or an error if ``strict``."""
    found = F.coalesce(style(c(col)), F.lit("")) if callable(style) else F.regexp_extract(c(col), HIT_PATTERNS[style], 1)
    other = F.raise_error(F.concat(F.lit(f"no {style} id in "), c(col))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(found != "", found).otherwise(other)


#: Hit headers of several fields (fixed values): the fields' names and the pattern, a group each.
HIT_FIELDS = {
    "local_human": (("id", "protein", "experiment"), r"^(\d+) \| (\d+) \| (\d+) "),
    "typed_domain": (("id", "protein", "experiment", "kind"), r"^(\d+)\|(\d+)\|(\d+)\|([a-zA-Z_-]+)"),
    "ranged_query": (("id", "start", "stop"), r"^[a-zA-Z]+\|([\w-]+)\|.*Range:(\d+)-(\d+)"),
    "astral": (("id", "sccs"), r"^(\S+)\s+(\S+)"),
}


def hit_fields(col: Column | str, style: str) -> Column:
    """The fields of a header of the style as a struct of strings; null if it doesn't match."""
    names, pattern = HIT_FIELDS[style]
    parts = [F.regexp_extract(c(col), pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return F.when(c(col).rlike(pattern), F.struct(*parts))


def ranged_id(col: Column | str) -> Column:
    """id:start-stop of a query header that names a range; null for others."""
    f = hit_fields(col, "ranged_query")
    return F.when(f.isNotNull(), F.concat(f["id"], F.lit(":"), f["start"], F.lit("-"), f["stop"]))


def known_type(col: Column | str) -> Column:
    return c(col).isin(*KNOWN_TYPES)


def model_group(col: Column | str) -> Column:
    """fr, psi or mcm; null for other types."""
    return F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[c(col)]


def model_scale(group: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])[c(group)]


def translate_nonstandard(col: Column | str) -> Column:
    """X, Z, B, U as A, Q, N, C."""
    return F.translate(c(col), "XZBU", "AQNC")


def clean_sequence(col: Column | str) -> Column:
    """Without stops, gaps and white space."""
    return F.regexp_replace(c(col), r"[*\s.-]", "")


def share_of(col: Column | str, letter: str) -> Column:
    """Share of a letter in a string; null for the empty one."""
    n = F.length(c(col))
    return F.when(n > 0, (n - F.length(F.replace(c(col), F.lit(letter), F.lit("")))) / n)


def ss_fractions(seq: Column | str, ss: Column | str) -> tuple[Column, Column]:
    """(share of H, share of E) of a prediction as long as its sequence; null if the lengths differ."""
    same = F.length(c(seq)) == F.length(c(ss))
    return F.when(same, share_of(ss, "H")), F.when(same, share_of(ss, "E"))


def region_slice(text: Column | str, start: Column | str, stop: Column | str) -> Column:
    """Letters start..stop, 1-based, both included."""
    return F.substring(c(text), c(start), c(stop) - c(start) + 1)


def gene_name(description: Column | str) -> Column:
    """The GN= value of a description, else 'None'."""
    found = F.regexp_extract(c(description), r"GN=(\S+)", 1)
    return F.when(found != "", found).otherwise("None")


def chain_range(text: Column | str, length: Column | str) -> tuple[Column, Column, Column]:
    """(chain, start, stop) of ``A:5-90``; a negative start is 0; ``A:`` is 1..length; others are null."""
    t = c(text)
    pattern = r"^(\w):(-?\d+)-(\d+)$"
    whole = t.rlike(r"^\w:$")
    ranged = t.rlike(pattern)
    chain = F.when(whole | ranged, F.substring(t, 1, 1))
    start = F.when(whole, F.lit(1)).when(ranged, F.greatest(F.regexp_extract(t, pattern, 2).try_cast("int"), F.lit(0)))
    stop = F.when(whole, c(length).cast("int")).when(ranged, F.regexp_extract(t, pattern, 3).try_cast("int"))
    return chain, start, stop


def overlap_ratio(q0, q1, t0, t1) -> Column:
    """Share of q0..q1 that t0..t1 covers, ends included; 1 if the target is null."""
    q0, q1, t0, t1 = map(c, (q0, q1, t0, t1))
    common = F.greatest(F.lit(0), F.least(q1, t1) - F.greatest(q0, t0) + 1)
    return F.when(t0.isNull() | t1.isNull(), 1.0).otherwise(common / (q1 - q0 + 1))


def half_open_overlap(a0, a1, b0, b1) -> Column:
    """max(0, min of stops - max of starts)."""
    return F.greatest(F.lit(0), F.least(c(a1), c(b1)) - F.greatest(c(a0), c(b0)))


def percent_identity(df: DataFrame, key: str, order: str, aligned: str) -> DataFrame:
    """key, order, identity: residues equal to those of the alignment's first record, *100 // ungapped length."""
    first = df.groupBy(key).agg(F.min_by(aligned, order).alias("first__"))
    same = F.size(F.filter(F.arrays_zip(F.split(aligned, "").alias("a"), F.split("first__", "").alias("b")), lambda x: (x["a"] == x["b"]) & (x["a"] != "-") & (x["a"] != "")))
    own = F.length(F.replace(F.col(aligned), F.lit("-"), F.lit("")))
    return df.join(first, key).select(key, order, F.when(own > 0, F.floor(same * 100 / own)).cast("int").alias("identity"))


def draw(seed: int, *keys: str | Column) -> Column:
    """A number of 52 bits from the seed and the columns as text: a seeded draw that any engine with MD5 repeats."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def fold_coverage(parent: Column | str, folded: Column | str, d0: Column | str, d1: Column | str) -> Column:
    """start, stop, fold and domain shares of where a foldable part lies in its parent against d0..d1.

    Start is 1-based, stop is start + length (one past the end); null if the part isn't found.
    """
    at = F.instr(c(parent), c(folded))
    start = F.when(at > 0, at)
    stop = start + F.length(c(folded))
    common = F.greatest(F.lit(0), F.least(stop, c(d1)) - F.greatest(start, c(d0)))
    return F.struct(start.alias("start"), stop.alias("stop"), (common / (stop - start)).alias("fold_share"), (common / (c(d1) - c(d0))).alias("domain_share"))


@functools.cache
def _log_factorials() -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1_000_001)))])


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Logarithm of n over k; -inf outside 0..n."""
    n, k = np.broadcast_arrays(np.asarray(n, dtype=np.int64), np.asarray(k, dtype=np.int64))
    ok = (k >= 0) & (k <= n) & (n >= 0)
    a, b, d = np.where(ok, n, 0), np.where(ok, k, 0), np.where(ok, n - k, 0)
    table = _log_factorials()
    if a.max(initial=0) < len(table):
        out = table[a] - table[b] - table[d]
    else:
        out = np.array([lgamma(x + 1) - lgamma(y + 1) - lgamma(z + 1) for x, y, z in zip(a.ravel(), b.ravel(), d.ravel())]).reshape(a.shape)
    return np.where(ok, out, -np.inf)


def hypergeom_values(x, r, b, n) -> np.ndarray:
    """exp(log C(r, x) + log C(b, n - x) - log C(r + b, n))."""
    x, r, b, n = (np.asarray(v, dtype=np.int64) for v in (x, r, b, n))
    total = _log_choose(r + b, n)
    return np.where(np.isfinite(total), np.exp(_log_choose(r, x) + _log_choose(b, n - x) - np.where(np.isfinite(total), total, 0.0)), 0.0)


@F.pandas_udf(T.DoubleType())
def hypergeom_point(x: pd.Series, r: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_values(x, r, b, n))


@F.pandas_udf(T.DoubleType())
def fisher_greater_p(a: pd.Series, b: pd.Series, cc: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided p of [[a, b], [c, d]]: the chance of a or more, margins fixed; null for a negative cell."""
    cells = np.stack([np.asarray(v, dtype=np.int64) for v in (a, b, cc, d)])
    bad = (cells < 0).any(axis=0)
    w, x, y, z = np.where(bad, 0, cells)
    hit, miss, n = w + x, y + z, w + y
    # Above the mean the tail itself is summed, else one less the other tail: terms fall off from the first.
    high = w * (hit + miss) > n * hit
    at = np.where(high, w, w - 1)
    term = hypergeom_values(at, hit, miss, n)
    total, live = term.copy(), term > 0
    while live.any():
        up, down = (hit - at) * (n - at) / (np.maximum(at + 1, 1) * np.maximum(miss - n + at + 1, 1)), at * (miss - n + at) / np.maximum((hit - at + 1) * (n - at + 1), 1)
        term = np.where(live, term * np.where(high, up, down), 0.0)
        total += term
        at += np.where(high, 1, -1)
        live = term > total * 1e-17
    p = np.clip(np.where(high, total, 1 - total), 0.0, 1.0)
    return pd.Series(np.where(bad, np.nan, p)).astype(object).where(~bad, None).astype("float64")


def ss_class(alpha: Column | str, beta: Column | str, cut: float = 0.15) -> Column:
    """1: mainly alpha, 2: mainly beta, 3: both or neither."""
    a, b = c(alpha) >= cut, c(beta) >= cut
    return F.when(a & ~b, 1).when(b & ~a, 2).otherwise(3)


def log_share_ratio(x: Column | str, y: Column | str) -> Column:
    """x / y; 1 for 0/0, 0.0067379 (e^-5) for 0/y, 148.41 (e^5) for x/0."""
    x, y = c(x), c(y)
    return F.when((x == 0) & (y == 0), 1.0).when(x == 0, 0.0067379).when(y == 0, 148.41).otherwise(x / y)


def fold_score(zscore, contact_order, convergence, len_p, len_e, alpha, beta, alpha_e, beta_e) -> Column:
    """Struct of class, ratio, alpha_ratio, beta_ratio and probability of a predicted against a known fold."""
    kind, ratio = ss_class(alpha, beta), c(len_p) / c(len_e)
    terms = [c(zscore), c(contact_order), c(convergence), F.abs(F.ln(ratio))]

    def chance(weights: tuple[float, ...]) -> Column:
        z = F.lit(weights[0])
        for w, t in zip(weights[1:], terms):
            z = z + F.lit(w) * t
        return 1 / (1 + 1 / F.exp(z))

    p = F.when(kind == 1, chance(COEFFICIENTS[1])).when(kind == 2, chance(COEFFICIENTS[2])).otherwise(chance(COEFFICIENTS[3]))
    return F.struct(
        kind.alias("class"), ratio.alias("ratio"), log_share_ratio(alpha, alpha_e).alias("alpha_ratio"),
        log_share_ratio(beta, beta_e).alias("beta_ratio"), p.alias("probability"),
    )
