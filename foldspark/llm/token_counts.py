"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a slice of documents lie in one ragged numpy array of symbols. Each round
finds every sequence's lowest-rank pair and merges all its occurrences at once, in all sequences;
sequences without a mergeable pair leave with their number of symbols. A document's count is the sum
over its pre-tokens. Chunks with characters that Unicode doesn't assign yet go to the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foldspark.llm._common import filled, lean, ragged, segment_sum, slices

NONE = np.int32(2**31 - 1)
#: Distinct chunks whose counts a Python worker keeps; the table is emptied when full.
CACHE = 300_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class RankMerger:
    """Byte-pair merges of a tokenizers JSON file as sorted arrays."""

    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        suffix = model.get("end_of_word_suffix") or ""
        names = byte_symbols()
        self.inner = np.array([vocab[x] for x in names], dtype=np.int64)
        self.final = np.array([vocab[x + suffix] for x in names], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # Merging all occurrences at once is exact only if every pair ranks after its parts.
        rank = np.arange(len(pairs))
        last = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(last, self.product, rank)
        if not ((last[left] < rank) & (last[right] < rank)).all():
            raise ValueError("a merge ranks before one of its parts")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        raw = [t.encode() for t in tokens]
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        out = np.zeros(len(raw), dtype=np.int64)
        sym = self.inner[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        offsets = ragged(lens)
        ends = offsets[1:] - 1
        sym[ends] = self.final[np.frombuffer(b"".join(r[-1:] for r in raw), dtype=np.uint8)]
        who = np.arange(len(raw))
        rank = np.full(len(sym), NONE, dtype=np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[ends] = NONE
        while len(who):
            starts = ragged(lens)[:-1]
            low = np.minimum.reduceat(rank, starts)
            live = low != NONE
            if not live.all():
                out[who[~live]] = lens[~live]
                keep = np.repeat(live, lens)
                sym, rank, who, lens, low = sym[keep], rank[keep], who[live], lens[live], low[live]
                if not len(who):
                    break
            seq = np.repeat(np.arange(len(who)), lens)
            hit = rank == low[seq]
            at = np.flatnonzero(hit)
            # In a run of overlapping hits (one symbol repeated) every second one merges.
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, at, 0))
            at = at[(at - run) % 2 == 0]
            sym[at] = self.product[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            last = np.zeros(len(sym), dtype=bool)
            last[np.cumsum(lens) - 1] = True
            last[at] |= last[at + 1]
            lens = lens - np.bincount(seq[at], minlength=len(who))
            new = np.cumsum(keep)[at] - 1
            sym, rank, last = sym[keep], rank[keep], last[keep]
            for p in (new, new[new > 0] - 1):
                q = np.minimum(p + 1, len(sym) - 1)
                rank[p] = np.where(last[p], NONE, self.rank(sym[p], sym[q]))
        return out

    @functools.cached_property
    def library(self):
        """The tokenizer as its file says, for whole texts."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    @staticmethod
    def unassigned(chunk: str) -> bool:
        """Holds a character that the two sides' versions of Unicode may tell differently."""
        return not chunk.isascii() and "Cn" in map(unicodedata.category, chunk)

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space, normalised."""
        chunk = unicodedata.normalize("NFC", chunk)
        return self.pattern.findall("".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower())


@functools.lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


_known: dict[str, dict[str, int]] = {}


def chunk_counts(m: RankMerger, path: str, chunks: list[str]) -> np.ndarray:
    """Tokens in each chunk, from this worker's table or by merging."""
    known = _known.setdefault(path, {})
    new = [c for c in chunks if c not in known]
    if new:
        if len(known) + len(new) > CACHE:
            known.clear()
            new = chunks
        ids: dict[str, int] = {}
        owner: list[int] = []
        piece: list[int] = []
        odd = {i: len(m.library.encode(c, add_special_tokens=False).ids) for i, c in enumerate(new) if m.unassigned(c)}
        for i, c in enumerate(new):
            for p in m.pieces(c) if i not in odd else ():
                owner.append(i)
                piece.append(ids.setdefault(p, len(ids)))
        each = m.counts(list(ids)) if ids else np.zeros(0, dtype=np.int64)
        sums = np.bincount(np.array(owner, dtype=np.int64), weights=each[np.array(piece, dtype=np.int64)], minlength=len(new)) if owner else np.zeros(len(new))
        for i, n in odd.items():
            sums[i] = n
        known.update(zip(new, sums.astype(np.int64).tolist()))
    return np.fromiter((known[c] for c in chunks), dtype=np.int64, count=len(chunks))


def split_special(texts: pa.Array, special: re.Pattern | None) -> tuple[pa.Array, np.ndarray]:
    """Texts with a space for each special string, and how many of these each had."""
    extra = np.zeros(len(texts), dtype=np.int64)
    if special is None or not len(texts):
        return texts, extra
    found = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
    if not len(found):
        return texts, extra
    values = texts.to_pylist()
    for i in found:
        values[i], extra[i] = special.subn(" ", values[i])
    return pa.array(values, pa.string()), extra


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; a null id stays
    null; other columns are ignored. Narrow: no shuffle. ``tokenizer`` is a tokenizers JSON file of
    byte-level BPE that every executor can open (default: the public 49k word vocabulary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        m = merger(path)
        for batch in batches:
            for part in slices(batch):
                texts = filled(part["text"])
                size = pc.binary_length(texts).cast(pa.int64())
                clean, n = split_special(texts, m.special)
                lists = pc.ascii_split_whitespace(clean)
                codes = lists.flatten().dictionary_encode()
                each = chunk_counts(m, path, codes.dictionary.to_pylist())
                flat = each[codes.indices.to_numpy(zero_copy_only=False)]
                n = n + segment_sum(flat, ragged(lists.value_lengths().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), SCHEMA)
