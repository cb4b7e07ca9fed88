"""Licence scans with a positional rare-token index, in DataFrame operations only.

Licence templates are short word sequences. Each is posted under its rarest mandatory word: the one of
highest IDF over all files. Of a file's licence words those with postings are looked up; each place
proposes a template at the position where it would have to begin, and the proposals are held against the
file's other licence words by relative position. A template counts if its mandatory phrase stands whole
in its place. A file may hold any number of licences: a template is proposed wherever its word stands.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import written

#: What stands between words (fixed value): ASCII but a-z and 0-9, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: str


TEMPLATES = (
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template("public-domain", "released into the public domain", "into the public domain"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
)
#: Words that stand anywhere: their places in templates match any word and are not indexed.
COMMON = frozenset("a and are by in into is of or the this to under use with without work".split())
#: Share of a template's words that have to agree.
AGREE = 0.5
#: Bits of a word's code, and of a place in a template; a hit's position has the rest of 64.
_BITS = 16
#: Shares that the vocabulary is dealt to by crc32: a word is looked up in one of them.
_SHARES = 64
_MASK = (1 << _BITS) - 1
_SHIFT = 1 << 20


def _at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


class Index:
    """Vocabulary (a code a word), postings and mandatory places of templates."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE):
        self.base = [(p.split(), label) for p, label in base]
        kept = {w for p, _ in self.base for w in p}
        #: Label, (place, word) of the indexed words, places of the mandatory phrase among them.
        self.templates = []
        for t in templates:
            text, phrase = t.text.split(), t.mandatory.split()
            first = _at(text, phrase)
            places = [(k, w) for k, w in enumerate(text) if w not in COMMON or first <= k < first + len(phrase)]
            self.templates.append((t.label, places, [(k, w) for k, w in places if first <= k < first + len(phrase)]))
            kept |= {w for _, w in places}
        words = sorted(kept)
        if len(words) >= 1 << _BITS or len(self.templates) >= 1 << _BITS or any(len(p) >= 1 << _BITS for _, p, _ in self.templates):
            raise ValueError("too many licence words or templates for their codes")
        self.code = {w: i for i, w in enumerate(words)}
        self.words = words

    def postings(self, idf: list[float]) -> list[list[int]]:
        """For each code, template << 16 | position in it, of the templates that are posted under the word."""
        out: list[list[int]] = [[] for _ in self.words]
        for t, (_, _, must) in enumerate(self.templates):
            k, w = min(((k, w) for k, w in must if w not in COMMON), key=lambda x: (-idf[self.code[x[1]]], self.code[x[1]], x[0]))
            out[self.code[w]].append(t << _BITS | k)
        return out


def licence_words(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hits: places of licence words as position << 16 | code, in order. Narrow."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # lower() makes an ASCII letter of two other characters only; these are put out of its way.
    text = F.when(text.rlike("[Kİ]"), F.regexp_replace(text, "[Kİ]", "�")).otherwise(text)
    words = F.array_remove(F.split(F.lower(text), GAP), "")
    shares = [[(w, c) for w, c in index.code.items() if crc32(w.encode()) % _SHARES == k] for k in range(_SHARES)]
    codes = F.array(*[F.create_map(*[F.lit(x) for pair in share or [("", 0)] for x in pair]) for share in shares])
    code = lambda w: F.get(codes, (F.crc32(w.cast("binary")) % _SHARES).cast("int"))[w]
    places = F.transform(F.col("words"), lambda w, i: F.when(w.isin(index.words), F.shiftleft(i.cast("long"), _BITS) + code(w)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(places, lambda x: x.isNotNull()).alias("hits"))


def inverse_frequencies(found: DataFrame, index: Index) -> list[float]:
    """IDF of each licence word over all files: as many numbers as licence words."""
    n = found.count()
    code = F.explode(F.array_distinct(F.transform("hits", lambda x: x.bitwiseAND(_MASK)))).alias("code")
    df = {r["code"]: r["n"] for r in found.select(code).groupBy("code").agg(F.count("*").alias("n")).collect()}
    from math import log

    return [log((n + 1) / (df.get(c, 0) + 1)) for c in range(len(index.words))]


def _starts(place: str) -> str:
    """SQL: where the whole would begin, going by the places in the file of the word of ``place`` (k, code)."""
    return f"transform(filter(hits, x -> (x & {_MASK}) = {place}.code), x -> shiftright(x, {_BITS}) - {place}.k)"


def _places(index: Index, places: list[tuple[int, str]]) -> str:
    return "array(" + ", ".join(f"named_struct('k', {k}, 'code', {index.code[w]}L)" for k, w in places) + ")"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None, agree: float = AGREE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    n_base counts the places of base phrases, first_word and last_word are the least and greatest word
    position where one starts (else null); labels are the base labels and those of templates found,
    distinct, sorted and comma-joined; score is the greatest share of a found template's words in
    place, 1 where a base phrase stands, else 0. Null is the empty text. Two narrow passes and the
    counts of the licence words; no texts are shuffled, and all steps are linear in a file's hits.
    """
    index = index or Index()
    found = written(licence_words(docs, index, id_col, text_col), "licence")
    idf = inverse_frequencies(found, index)
    postings = "array(" + ", ".join(f"cast(array({', '.join(map(str, p))}) as array<bigint>)" for p in index.postings(idf)) + ")"
    phrases = "array(" + ", ".join(f"named_struct('label', '{label}', 'places', {_places(index, list(enumerate(words)))})" for words, label in index.base) + ")"
    templates = "array(" + ", ".join(f"named_struct('id', {t}L, 'label', '{label}', 'places', {_places(index, places)}, 'must', {_places(index, must)})" for t, (label, places, must) in enumerate(index.templates)) + ")"
    rows = found.selectExpr(
        "*",
        f"transform({phrases}, b -> named_struct('label', b.label, 'starts', aggregate(slice(b.places, 2, size(b.places)), {_starts('b.places[0]')}, (s, m) -> array_intersect(s, {_starts('m')})))) as phrases",
    )
    # A proposal: template << 40 | begin + _SHIFT.
    rows = rows.selectExpr(
        "doc_id", "n_words", "hits", "flatten(transform(phrases, b -> b.starts)) as base_starts", "array_sort(array_distinct(transform(filter(phrases, b -> size(b.starts) > 0), b -> b.label))) as base",
        f"array_distinct(flatten(transform(filter(hits, x -> size({postings}[int(x & {_MASK})]) > 0), x -> transform({postings}[int(x & {_MASK})], p -> shiftleft(bigint(shiftright(p, {_BITS})), 40) + shiftright(x, {_BITS}) - (p & {_MASK}) + {_SHIFT})))) as proposed",
    )
    own = f"transform(filter(proposed, p -> shiftright(p, 40) = t.id), p -> (p & {(1 << 40) - 1}L) - {_SHIFT})"
    whole = f"aggregate(t.must, {own}, (s, m) -> array_intersect(s, {_starts('m')}))"
    share = f"aggregate(array({whole}), 0D, (z, w) -> if(size(w) > 0, size(filter(t.places, m -> arrays_overlap(w, {_starts('m')}))) / size(t.places), 0D))"
    rows = rows.selectExpr(
        "*",
        f"transform(transform(array_distinct(transform(proposed, p -> int(shiftright(p, 40)))), t -> {templates}[t]), t -> named_struct('label', t.label, 'share', {share})) as held",
    )
    rows = rows.selectExpr("*", f"filter(held, t -> t.share >= {agree}) as named")
    return rows.selectExpr(
        "doc_id", "n_words", "bigint(size(base_starts)) as n_base", "array_min(base_starts) as first_word", "array_max(base_starts) as last_word", "array_join(base, ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(base, transform(named, t -> t.label)))), ',') as labels", "greatest(coalesce(array_max(transform(named, t -> t.share)), 0D), if(size(base_starts) > 0, 1D, 0D)) as score",
    )


def sql(index: Index | None = None, agree: float = AGREE) -> str:
    """The scan as DuckDB SQL over ``documents``."""
    index = index or Index()
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
    tmpl = [(t, k, w, int((k, w) in m), len(places), len(m), label, int(w not in COMMON)) for t, (label, places, m) in enumerate(index.templates) for k, w in places]
    base = [(b, k, w, len(words), label) for b, (words, label) in enumerate(index.base) for k, w in enumerate(words)]
    return f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
code(word, c) AS (VALUES {values(index.code.items())}),
tmpl(t, k, word, must, len, musts, label, indexed) AS (VALUES {values(tmpl)}),
base(b, k, word, len, label) AS (VALUES {values(base)}),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM split),
hits AS (SELECT doc_id, pos, word, c FROM flat JOIN code USING (word)),
df AS (SELECT c, count(DISTINCT doc_id) AS n FROM hits GROUP BY c),
posted AS (
  SELECT t, k, word FROM tmpl JOIN code USING (word) LEFT JOIN df USING (c) WHERE must = 1 AND indexed = 1 QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), c, k) = 1),
proposed AS (
  SELECT DISTINCT h.doc_id, t.t, h.pos - t.k AS start FROM hits h JOIN posted t ON t.word = h.word),
held AS (
  SELECT p.doc_id, p.t, p.start FROM proposed p JOIN tmpl t ON p.t = t.t AND t.must = 1 JOIN hits h ON h.doc_id = p.doc_id AND h.pos = p.start + t.k AND h.word = t.word
  GROUP BY p.doc_id, p.t, p.start HAVING count(*) = any_value(t.musts)),
named AS (
  SELECT p.doc_id, any_value(t.label) AS label, count(DISTINCT t.k)::DOUBLE / any_value(t.len) AS share
  FROM held p JOIN tmpl t ON p.t = t.t JOIN hits h ON h.doc_id = p.doc_id AND h.pos = p.start + t.k AND h.word = t.word GROUP BY p.doc_id, p.t HAVING share >= {agree}),
places AS (
  SELECT h.doc_id, b.b, h.pos - b.k AS start, any_value(b.label) AS label FROM hits h JOIN base b ON b.word = h.word
  GROUP BY h.doc_id, b.b, h.pos - b.k HAVING count(*) = any_value(b.len)),
based AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM named UNION SELECT doc_id, label FROM places) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM named GROUP BY doc_id)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM split s LEFT JOIN based USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""
