"""Token-id files: Parquet list columns in document order, with selective reads.

``write_tokens`` range-partitions documents by id, encodes them with the tokenizers library and
writes one sorted Parquet file per range. The id lists are dictionary or delta encoded, row groups
and pages have set sizes, and the writer adds page indexes, so that a reader can fetch the metadata
columns alone or a few documents' tokens. ``read_tokens`` reads files back and adds the position of
each document in the whole stream of ids, from the small per-range totals.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm._common import filled, lean, n_parts, ragged, slices, work_path
from foldspark.llm.token_counts import RankMerger, byte_symbols, default_tokenizer, merger, split_special

#: Distinct pieces in each of the two generations that a Python worker keeps: what the last one saw used
#: stays, the rest goes when the new one is full.
CACHE = 120_000
#: Pieces in one text given to the library.
JOINED = 128
#: UTF-8 bytes of text encoded at a time.
STEP_BYTES = 4 << 20
#: Marks that letters of ASCII are composed with.
_COMPOSING = "[\u0300-\u036f]"
_MARKS = np.frombuffer(b",.;:!?", dtype=np.uint8)
FILE_SCHEMA = "part int, row long, doc_id long, ids_before long, n_tokens long, ids array<int>"
LAYOUT = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "v1"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def words_and_marks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts between ASCII white space, end to end, and how many each text has.

    One mark after a letter that ends a chunk is a chunk of its own: there the pre-tokenizer always cuts.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(flat):
        return flat, n
    width = np.int64 if pa.types.is_large_string(flat.type) else np.int32
    offsets = np.frombuffer(flat.buffers()[1], dtype=width)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    size, end = np.diff(offsets), offsets[1:]
    at = np.flatnonzero(size > 1)
    at = at[np.isin(data[end[at] - 1], _MARKS)]
    before, first = data[end[at] - 2], data[np.maximum(end[at] - 3, 0)]
    latin = (size[at] > 2) & (first == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    at = at[((before >= 97) & (before <= 122)) | latin]
    cut = np.zeros(len(flat), dtype=bool)
    cut[at] = True
    full = size > 0  # blanks at either end of a text leave empty strings
    many = full.astype(np.int64) + cut
    doc = np.repeat(np.arange(len(texts)), n)
    starts = np.repeat(offsets[:-1], many)
    second = np.cumsum(many)[at] - 1
    starts[second] = end[at] - 1
    # Chunks lie end to end, so that starts alone tell where each ends.
    bounds = np.append(starts, offsets[-1]).astype(np.int32)
    out = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), flat.buffers()[2])
    return out, np.bincount(doc, weights=many, minlength=len(texts)).astype(np.int64)


class ChunkEncoder:
    """Ids of white-space-free chunks from the tokenizers library; distinct pre-tokens are encoded once.

    The library gets normalised pre-tokens, many in one text, and only cuts at the blanks between them. Texts
    with special strings go to it whole, as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.rules: RankMerger = merger(path)
        self.byte_names = byte_symbols()
        self.cutter = Tokenizer.from_file(path)
        self.cutter.no_truncation()
        self.cutter.no_padding()
        self.cutter.normalizer = None
        self.cutter.pre_tokenizer = CharDelimiterSplit(" ")
        vocab = self.cutter.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, and the number of each."""
        known, older = self.known, self.older
        if len(known) > CACHE:
            self.older = older = known
            self.known = known = {}
        parts = [known.get(c) for c in chunks]
        lost = [i for i, ids in enumerate(parts) if ids is None]
        if lost:
            new = []
            for i in lost:
                c = chunks[i]
                ids = older.get(c)
                if ids is None:
                    new.append(c)
                else:
                    known[c] = parts[i] = ids
            for c in new:
                if self.rules.unassigned(c):
                    known[c] = np.array(self.rules.library.encode(c, add_special_tokens=False).ids, dtype="<i4").tobytes()
            cut = {c: pieces for c in new if not (c.isascii() and c.isalpha() and c.islower()) and c not in known and (pieces := self.rules.pieces(c)) != [c]}
            self._learn([c for c in dict.fromkeys([*new, *(p for pieces in cut.values() for p in pieces)]) if c not in cut and c not in known])
            for c, pieces in cut.items():
                known[c] = b"".join([known[p] for p in pieces])
            for i in lost:
                if parts[i] is None:
                    parts[i] = known[chunks[i]]
        flat = np.frombuffer(b"".join(parts), dtype="<i4")
        return flat, np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4

    def _learn(self, new: list[str]) -> None:
        names = self.byte_names
        groups = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
        texts = (" ".join([p if p.isascii() and p.isprintable() else "".join([names[b] for b in p.encode("utf-8", "surrogatepass")]) for p in x]) for x in groups)
        encoded = (e for few in iter(lambda: list(islice(texts, 32)), []) for e in self.cutter.encode_batch_fast(few, add_special_tokens=False))
        for pieces, e in zip(groups, encoded):
            ids = np.array(e.ids, dtype="<i4")
            ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, dtype=np.int64)
            if len(ends) != len(pieces):
                raise ValueError("the vocabulary doesn't mark the ends of pre-tokens")
            raw, at = ids.tobytes(), 0
            for p, to in zip(pieces, (4 * ends).tolist()):
                self.known[p] = raw[at:to]
                at = to

    def documents(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, each with ``end_id`` after it, and offsets."""
        clean, n_special = split_special(texts, self.rules.special)
        # Of these letters the normaliser makes small ones too; special strings are out by now. It composes letters
        # with marks before, and some small letters have composed forms that their capitals lack: those texts stay as they are.
        words, n_words = words_and_marks(pc.if_else(pc.match_substring_regex(clean, _COMPOSING), clean, pc.ascii_lower(clean)))
        codes = words.dictionary_encode()
        flat, size = self.encode(codes.dictionary.to_pylist())
        flat, size = np.append(flat, np.int32(end_id)), np.append(size, 1)
        begin = ragged(size)[:-1]
        use = np.empty(len(codes) + len(texts), dtype=np.int64)
        last = np.cumsum(n_words) + np.arange(len(texts))
        body = np.ones(len(use), dtype=bool)
        body[last] = False
        use[body], use[last] = codes.indices.to_numpy(zero_copy_only=False), len(size) - 1
        each = size[use]
        to = ragged(each)
        at = np.repeat((begin[use] - to[:-1]).astype(np.int32), each)
        at += np.arange(to[-1], dtype=np.int32)
        ids = flat.take(at)
        offsets = np.append(0, to[last + 1])
        if n_special.any():  # these documents hold special strings: whole, by the library
            rows = np.split(ids, offsets[1:-1])
            for i in np.flatnonzero(n_special):
                rows[i] = np.append(np.array(self.rules.library.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.int32), np.int32(end_id))
            ids, offsets = np.concatenate(rows), ragged(np.array([len(r) for r in rows]))
        return ids, offsets


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, parts: int | None = None) -> DataFrame:
    """One row per document in ascending id order over the partitions (``FILE_SCHEMA``).

    Null and empty texts are the end id alone; a null id comes first; rows with one id are in the order of
    a hash of their texts, which ranges are cut by too: one id, or none, may have any number of rows. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer or default_tokenizer())
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in slices(batch, limit=STEP_BYTES):
                ids, offsets = enc.documents(filled(some["text"]), end_id)
                n = some.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(row, row + n)), some["doc_id"], pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)),
                    )],
                    names=["part", "row", "doc_id", "ids_before", "n_tokens", "ids"],
                )
                row, before = row + n, before + int(offsets[-1])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts or n_parts(docs), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    return rows.drop("hash").mapInArrow(lean(run), FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, layout: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20, page_rows: int = 2000, **options) -> None:
    """Writes the token files of ``docs`` below ``path``: ``FILE_SCHEMA``, sorted by id.

    ``layout`` is ``dictionary`` or ``delta``; row groups, pages and rows a page are at most the given
    sizes. Null and empty texts are documents of the end id alone. A null id comes first; rows with one
    id are in the order of a hash of their texts. An empty table gives no rows.
    """
    sizes = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.dictionary.page.size": page_bytes, "parquet.page.row.count.limit": page_rows}
    encoded(docs, **options).write.options(**LAYOUT[layout], **{k: str(v) for k, v in sizes.items()}).option("compression", "zstd").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens from the metadata columns alone; no ids are read."""
    return _started(spark.read.schema(FILE_SCHEMA).parquet(path)).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the files; filters on doc_id skip row groups and pages. Rows with one id
    each have their own start; no rows give none."""
    return _started(spark.read.schema(FILE_SCHEMA).parquet(path)).select("doc_id", "start", "n_tokens", "ids")


def _started(files: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before, from the totals of the files (one row a file)."""
    spark = files.sparkSession
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, rows = 0, []
    for part in sorted(totals):
        rows.append((part, base))
        base += totals[part]
    bases = spark.createDataFrame(rows, "part int, ids_base long")
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("ids_base") + F.col("ids_before"))


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of ``read_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            offsets = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` as token files in the shared folder and reads them back (``read_tokens``)."""
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
