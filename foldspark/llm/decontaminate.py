"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders; windows of the canonical tokens of every benchmark
item form a hash table that the windows of all documents are joined with. A re-parameterised question
has the item's windows with other slot values; its slots must be consistent: one value of the item's
stands for one value of the document's throughout, and the other way round. Beside that, every item is
matched whole, with its own values, so that none is too short, or too rich in slots, to be found as it is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from foldspark.llm._common import filled, keep_rows, lean, ragged, slices

#: Tokens of a window; the least of them that are plain words; tokens an item with windows has at least.
WINDOW, PLAIN, SHORTEST = 6, 3, 4
#: Share of an item's windows that a document has to hold, and of its slots that have to agree.
COVERAGE, CONSISTENT = 0.4, 0.8
#: Benchmark windows in a block: the size of the hash table that tasks hold.
BLOCK = 1_000_000
UNITS = frozenset("mm cm km kg mg ml lb lbs oz ft mph kph kmh km/h m/s hz khz mhz ghz kb mb gb tb kw kwh mw volt volts watt watts usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees".split())
WORD, NUMBER, NAME, UNIT, BLANK, SIGN = range(6)
_MARK = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0, 0], dtype=np.uint64)
_SLOT = np.array([False, True, True, True, False, False])
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Scripts written without spaces: each of their characters is a token.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Chunks of operators alone: they are tokens that stand for themselves, neither words nor slots.
_SIGN = re.compile(r"^[-+*/=<>^~%−×÷±·≤≥≠≈]+$")
_NUMBER = re.compile(r"^\d[\d.,:/-]*(%|[a-zA-Z]{1,3})?$")


def describe(chunk: str) -> tuple[int, int, bool, bool]:
    """(kind, hash, begins with a capital, ends a sentence) of a chunk without white space."""
    core = _EDGE.sub("", chunk)
    ends = chunk.rstrip("\"')]}»”’")[-1:] in tuple(".!?:;")
    if not core:
        return (SIGN, xxh64_intdigest(chunk.encode()), False, False) if _SIGN.match(chunk) else (BLANK, 0, False, ends)
    low = core.lower()
    kind = NUMBER if _NUMBER.match(core) else UNIT if low in UNITS else WORD
    return kind, xxh64_intdigest(low.encode("utf-8", "surrogatepass")), core[0].isupper(), ends


class Tokens:
    """Canonical tokens of texts end to end: ``offsets``, ``kind``, ``value`` (hash of what stands there) and
    ``form`` (hash of the canonical token)."""

    def __init__(self, texts: pa.Array):
        ascii_ = pc.string_is_ascii(texts)
        if not pc.all(ascii_).as_py():
            texts = pc.if_else(ascii_, texts, pc.replace_substring_regex(texts, _UNSPACED, r" \1 "))
        lists = pc.ascii_split_whitespace(texts)
        codes = lists.flatten().dictionary_encode()
        told = [describe(c) for c in codes.dictionary.to_pylist()] or [(BLANK, 0, False, False)]
        # Hashes have a type of their own: numpy takes a list of small and large ones for floating point.
        kinds, values, capital, ends = (np.array(x, dtype=t) for x, t in zip(zip(*told), (np.int8, np.uint64, bool, bool)))
        use = codes.indices.to_numpy(zero_copy_only=False)
        kind = kinds[use]
        doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
        keep = kind != BLANK
        use, kind, doc = use[keep], kind[keep], doc[keep]
        first = np.ones(len(use), dtype=bool)
        first[1:] = (doc[1:] != doc[:-1]) | ends[use[:-1]]
        kind[(kind == WORD) & capital[use] & ~first] = NAME
        self.kind, self.value = kind, values[use]
        self.form = np.where(_SLOT[kind], _MARK[kind], self.value)
        self.offsets = ragged(np.bincount(doc, minlength=len(texts)))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first token, hash) of all windows of ``k`` tokens with enough plain words."""
        n = len(self.form) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h, plain = np.full(n, k, dtype=np.uint64), np.zeros(n, dtype=np.int8)
        for j in range(k):
            h = (h ^ self.form[j : j + n]) * _BASE
            h ^= h >> np.uint64(32)
            plain += self.kind[j : j + n] == WORD
        last = np.repeat(self.offsets[1:], np.diff(self.offsets))[:n]
        at = np.flatnonzero((plain >= min(PLAIN, k)) & (np.arange(n) + k <= last))
        return at, h[at]


class Runs:
    """Hashes of runs of values of any length, each in one step: prefix sums of a polynomial with an odd base."""

    #: The base and its inverse modulo 2^64.
    BASE = 0x9E3779B97F4A7C15
    BACK = pow(BASE, -1, 1 << 64)

    def __init__(self, value: np.ndarray):
        n = len(value)
        self.back = np.ones(n + 1, dtype=np.uint64)
        power = self.back.copy()
        power[1:], self.back[1:] = self.BASE, self.BACK
        power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(self.back)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value * power[:n], out=self.sums[1:])

    def hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (self.sums[at + size] - self.sums[at]) * self.back[at] ^ size.astype(np.uint64)
        h = (h ^ h >> np.uint64(29)) * _BASE
        return h ^ h >> np.uint64(32)


class ItemTable:
    """Windows of benchmark items by hash, with a bitmap before the exact look-up.

    Of windows that an item repeats with all values, the first counts. Whole items are looked up by the
    hash of all their values; ``whole`` has, by number of first tokens (up to three), the hashes of these
    tokens' values with the lengths of the items that begin so, and a bitmap of these hashes.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.tokens = Tokens(pa.array([t for _, t in items], pa.string()))
        sizes, runs = np.diff(self.tokens.offsets), Runs(self.tokens.value)
        self.k = np.minimum(sizes, WINDOW)
        at, h, of = [], [], []
        for k in range(SHORTEST, WINDOW + 1):
            a, x = self.tokens.windows(k)
            item = np.searchsorted(self.tokens.offsets, a, side="right") - 1
            own = self.k[item] == k
            at.append(a[own]), h.append(x[own]), of.append(item[own])
        self.at, self.hash, self.item = np.concatenate(at), np.concatenate(h), np.concatenate(of)
        order = np.lexsort((self.at, runs.hash(self.at, self.k[self.item]), self.item, self.hash))
        same = runs.hash(self.at, self.k[self.item])[order]
        h, of = self.hash[order], self.item[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1]) | (same[1:] != same[:-1])
        order = order[new]
        self.at, self.hash, self.item = self.at[order], self.hash[order], self.item[order]
        self.windows = np.bincount(self.item, minlength=len(items))
        self.sizes = sorted({int(k) for k in self.k if k >= SHORTEST})
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.hash & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        some = np.flatnonzero(sizes > 0)
        full = runs.hash(self.tokens.offsets[some], sizes[some])
        order = np.argsort(full, kind="stable")
        self.full, self.full_item = full[order], some[order]
        self.whole: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in (1, 2, 3):
            own = some[np.minimum(sizes[some], 3) == k]
            if len(own):
                h = self._first(self.tokens.value, self.tokens.offsets[own], k)
                order, bits = np.lexsort((sizes[own], h)), np.zeros(1 << 22, dtype=bool)
                h, size = h[order], sizes[own][order]
                new = np.append(True, (h[1:] != h[:-1]) | (size[1:] != size[:-1]))
                bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
                self.whole[k] = h[new], size[new], bits

    @staticmethod
    def _first(value: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            h = (h ^ value[at + j]) * _BASE
            h ^= h >> np.uint64(32)
        return h

    def held_whole(self, tokens: Tokens) -> set[tuple[int, int]]:
        """(document's number, item's number): items that stand in a document as they are.

        A place is looked up once for each length that items with its beginning have, however many they are.
        """
        n, out, runs = len(tokens.value), set(), None
        for k, (keys, sizes, bits) in self.whole.items():
            if n < k:
                continue
            h = self._first(tokens.value, np.arange(n - k + 1), k)
            at = np.flatnonzero(bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at, size = _expanded(at, keys, h[at], sizes)
            doc = np.searchsorted(tokens.offsets, at, side="right") - 1
            fits = at + size <= tokens.offsets[doc + 1]
            at, size, doc = at[fits], size[fits], doc[fits]
            if len(at):
                runs = runs or Runs(tokens.value)
                doc, item = _expanded(doc, self.full, runs.hash(at, size), self.full_item)
                out.update(zip(doc.tolist(), item.tolist()))
        return out

    def whole_row(self, item: int) -> tuple:
        """What ``judged`` says of an item that stands there as it is."""
        own = slice(self.tokens.offsets[item], self.tokens.offsets[item + 1])
        kind, value = self.tokens.kind[own], self.tokens.value[own]
        slots = _SLOT[kind]
        return self.ids[item], int(self.windows[item]), 1.0, len(set(zip(kind[slots].tolist(), value[slots].tolist()))), 1.0, True

    def found(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in the documents' tokens, row of this table) of equal windows."""
        place, row = [], []
        for k in self.sizes:
            at, h = tokens.windows(k)
            maybe = self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            at, rows = _expanded(at, self.hash, h, np.arange(len(self.hash)))
            right = self.k[self.item[rows]] == k
            place.append(at[right]), row.append(rows[right])
        if not place:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(place), np.concatenate(row)


def _expanded(left: np.ndarray, keys: np.ndarray, sought: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``left`` and ``right`` for each of the sorted ``keys`` that equals a left row's ``sought`` one."""
    lo, hi = np.searchsorted(keys, sought, "left"), np.searchsorted(keys, sought, "right")
    n = hi - lo
    return np.repeat(left, n), right[np.repeat(lo - ragged(n)[:-1], n) + np.arange(n.sum())]


def judged(table: ItemTable, tokens: Tokens, places: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """(item, windows, coverage, slots, consistent, exact) of the items in one document's matches."""
    out = []
    order = np.argsort(table.item[rows], kind="stable")
    places, rows = places[order], rows[order]
    cuts = np.flatnonzero(np.append(True, np.diff(table.item[rows]) != 0)) if len(rows) else rows
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        item = int(table.item[rows[a]])
        told = [x for p, w in _occurrences(table, item, places[a:b], table.at[rows[a:b]]) if (x := _occurrence(table, tokens, item, p, w))]
        if told:
            out.append((table.ids[item], *max(told, key=lambda x: (x[1], x[3]))))
    return out


def _occurrences(table: ItemTable, item: int, places: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All of an item's matches (document place, item place), those of each alignment (their difference), and those of
    alignments close to each other, as words put in or left out move them; if they are enough to cover the item."""
    least = COVERAGE * int(table.windows[item])
    yield places, own
    line = places - own
    order = np.argsort(line, kind="stable")
    places, own, line = places[order], own[order], line[order]
    step = np.diff(line)
    if not step.any():
        return
    slack = int(table.tokens.offsets[item + 1] - table.tokens.offsets[item]) // 4
    for apart in (step > 0, step > slack):
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(line)]
        for a, b in zip(cuts, cuts[1:]):
            if least <= b - a < len(line):
                yield places[a:b], own[a:b]


def _occurrence(table: ItemTable, tokens: Tokens, item: int, places: np.ndarray, own: np.ndarray) -> tuple | None:
    """(windows, coverage, slots, consistent, exact) if these matches cover the item and agree."""
    held = len(np.unique(own))
    coverage = held / int(table.windows[item])
    if coverage < COVERAGE:
        return None
    steps = np.arange(int(table.k[item]))
    there, here = (places[:, None] + steps).ravel(), (own[:, None] + steps).ravel()
    slot = _SLOT[tokens.kind[there]]
    mark = _MARK[table.tokens.kind[here[slot]]]
    mine, theirs = table.tokens.value[here[slot]] ^ mark, tokens.value[there[slot]] ^ mark
    n_slots, agree = _commonest(mine, theirs)
    agree = min(agree, _commonest(theirs, mine)[1])
    consistent = agree / len(mine) if len(mine) else 1.0
    return (held, coverage, n_slots, consistent, False) if consistent >= CONSISTENT else None


def _commonest(keys: np.ndarray, others: np.ndarray) -> tuple[int, int]:
    """(distinct keys, rows that have their key's commonest counterpart)."""
    if not len(keys):
        return 0, 0
    order = np.lexsort((others, keys))
    keys, others = keys[order], others[order]
    new = np.append(True, keys[1:] != keys[:-1])
    run = np.flatnonzero(new | np.append(True, others[1:] != others[:-1]))
    many = np.diff(np.append(run, len(keys)))
    best = np.maximum.reduceat(many, np.flatnonzero(new[run]))
    return len(best), int(best.sum())


SCHEMA = "doc_id long, item_id long, n_windows long, coverage double, n_slots long, consistent double, exact boolean"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """A row for each document and benchmark item whose template it holds; clean documents have none.

    Each occurrence of an item is judged by itself, and the best is told: an exact one, else the one
    that covers most. n_windows and coverage: the item's distinct windows found, and their share; n_slots:
    distinct slot values of the item in them; consistent: share of slots that agree with their value's
    commonest counterpart, in the worse of both directions; exact: the whole item, however short, stands there with
    its own values and operators (coverage and consistent 1). What a document's row is doesn't depend on the rows beside it. Null, empty and blank items and texts match nothing. Repeated rows each give
    their rows; a null id stays null; an empty table on either side gives none. Documents are scanned whole
    once for each block of about ``block`` benchmark windows (a stated query set in blocks): the block is
    the build side of a broadcast hash join, and neither it nor what the driver holds grows with the data.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return reduce(DataFrame.unionByName, [_scan(rows, items) for items in item_blocks(benchmark, item_col, item_text, block)])


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``block`` windows each, one block at a time (one empty block if it has none)."""
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"),
    ).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text") / 3)).first()[0] or 0
    blocks = max(1, int(-(-size // block)))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows, with all columns, that hold no benchmark item's template. Null and empty texts are clean; repeated
    rows stay or go together; without items all rows stay. Narrow."""
    for items in item_blocks(benchmark, block=block):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = keep_rows(docs, text_col, _cleaner(shared))
    return docs


def _cleaner(shared):
    def make():
        table = ItemTable(shared.value)

        def clean(texts: pa.Array) -> np.ndarray:
            tokens = Tokens(texts)
            out = np.ones(len(texts), dtype=bool)
            out[[d for d, found in _by_document(table, tokens) if found]] = False
            return out

        return clean

    return make


def _by_document(table: ItemTable, tokens: Tokens) -> Iterator[tuple[int, list[tuple]]]:
    """(number of the document, what ``judged`` says of its items) for documents with any equal window or item."""
    exact: dict[int, dict[int, tuple]] = defaultdict(dict)
    for d, item in table.held_whole(tokens):
        exact[d][table.ids[item]] = table.whole_row(item)
    places, rows = table.found(tokens)
    doc = np.searchsorted(tokens.offsets, places, side="right") - 1
    order = np.argsort(doc, kind="stable")
    places, rows, doc = places[order], rows[order], doc[order]
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
        d = int(doc[a])
        told = [x for x in judged(table, tokens, places[a:b], rows[a:b]) if x[0] not in exact.get(d, ())]
        yield d, told + list(exact.pop(d, {}).values())
    for d, told in exact.items():
        yield d, list(told.values())


def _scan(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ItemTable(shared.value)
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens(filled(part["text"]))
                ids = part["doc_id"]
                found = [(ids[d].as_py(), *x) for d, told in _by_document(table, tokens) for x in told]
                cols = list(zip(*found)) or [[] for _ in range(7)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(cols, types)],
                    names=["doc_id", "item_id", "n_windows", "coverage", "n_slots", "consistent", "exact"],
                )

    return rows.mapInArrow(lean(run), SCHEMA)
