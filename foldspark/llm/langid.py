"""Language identification by multilingual mixture inference.

Character n-grams of words give each word a likelihood under every learned language. A document is a
mixture: expectation-maximisation over its words estimates the languages' shares, for the nested sets
of its strongest languages, and the set of the best penalised likelihood is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import filled, keep_rows, lean, ragged, sampled, segment_sum, slices

#: Hash buckets of n-grams, lengths of n-grams, add-count smoothing.
BUCKETS, GRAMS, SMOOTH = 1 << 16, (2, 3, 4), 0.5
#: Labelled documents a language that the model is fitted on, at most about (a bounded sample).
DOCS_PER_LANG = 4000
ROUNDS = 6
PENALTY = 3.0
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>, n_words long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters (and marks) of each text; runs of marks alone may be among them."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pM]+", " ")
    return pc.ascii_split_whitespace(clean)


def lettered(words: pa.Array) -> np.ndarray:
    """Which words have a letter."""
    return pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``_word_`` for each word end to end, and offsets."""
    text = "".join(f"_{w}_" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(codes))
    word = np.repeat(np.arange(len(words)), lens)
    who, val = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        ok = at + n <= ends
        at, ends, word, h = at[ok], ends[ok], word[ok], h[ok]
        h = (h + codes[at + n - 1] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(31)
        if n in GRAMS:
            who.append(word)
            val.append((h % np.uint64(BUCKETS)).astype(np.int64))
    who, val = np.concatenate(who), np.concatenate(val)
    order = np.argsort(who, kind="stable")
    return val[order], ragged(np.bincount(who, minlength=len(words)))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over rows of (lang, text), added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                own = batch.filter(pc.equal(batch["lang"], lang))
                for part in slices(own):
                    words = words_of(filled(part["text"])).flatten()
                    words = words.filter(pa.array(lettered(words))).dictionary_encode()
                    if not len(words):
                        continue
                    times = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
                    grams, offsets = word_grams(words.dictionary.to_pylist())
                    add = np.bincount(grams, weights=np.repeat(times, np.diff(offsets)), minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + add
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    part = docs.select("lang", "text").mapInArrow(lean(run), "lang string, bucket int, n double")
    return part.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-likelihoods of n-gram buckets: ``table`` has a row a bucket, a column a language, less the
    row's mean; ``base`` has that mean over the likelihood under no language (all buckets alike)."""

    def __init__(self, langs: list[str], table: np.ndarray, base: np.ndarray):
        self.langs, self.table, self.base = langs, table, base


def fit(docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> LanguageModel:
    """Fits on rows where ``keep`` holds and the language isn't null: about ``docs_per_lang`` documents a
    language, chosen by a hash of their ids. The model, BUCKETS numbers a language, goes to the driver."""
    rows = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(BUCKETS))
    rates = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    found = gram_counts(rows.where(sampled("doc_id", rates[F.col("lang")]))).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    np.add.at(table, (found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"])), found["n"].to_numpy())
    table = np.log(table / table.sum(axis=0))
    mean = table.mean(axis=1)
    return LanguageModel(langs, (table - mean[:, None]).astype(np.float32), mean + np.log(BUCKETS))


def _em(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(shares of each document's languages after so many rounds, the log-likelihood that no shares exceed).

    ``p`` (languages, words) likelihoods, ``doc`` the number of each word's document, ``starts`` and ``n`` its first word and its
    words. The log-likelihood is concave in the shares: the best is at most n log(g) over the present one, where g is the
    greatest factor by which the next round would change a share.
    """
    pi = np.full((len(n), len(p)), 1 / len(p))
    for _ in range(rounds + 1):
        last = pi
        parts = [pi[:, j][doc] * x for j, x in enumerate(p)]
        total = sum(parts)
        pi = np.stack([np.add.reduceat(x / total, starts) / n for x in parts], axis=1)
    ratio = np.stack([np.add.reduceat(x / total, starts) / n for x in p], axis=1).max(axis=1)
    return last, np.add.reduceat(np.log(np.maximum(total, 1e-300)), starts) + n * np.log(np.maximum(ratio, 1.0)) + 1e-9 * n


def mixtures(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of all languages (rows: texts; 0 outside the chosen set), numbers of words, and the log of how
    much likelier the words are under the chosen set than under no language (0 without words)."""
    lists = words_of(texts)
    flat = lists.flatten()
    every = flat.dictionary_encode()
    full = lettered(every.dictionary)[every.indices.to_numpy(zero_copy_only=False)]
    n_words = segment_sum(full.astype(np.int64), ragged(lists.value_lengths().to_numpy(zero_copy_only=False)))
    n_langs = len(model.langs)
    shares, told = np.zeros((len(texts), n_langs)), np.zeros(len(texts))
    if not n_words.any() or not n_langs:
        return shares, n_words, told
    codes = flat.filter(pa.array(full)).dictionary_encode()
    grams, offsets = word_grams(codes.dictionary.to_pylist())
    # Overlapping n-grams tell the same thing several times: their sum is divided by their kinds.
    each = np.stack([segment_sum(model.table[:, j][grams].astype(np.float64), offsets) for j in range(n_langs)], axis=1) / len(GRAMS)
    top = each.max(axis=1, keepdims=True)
    like = np.maximum(np.exp(each - top), 1e-9)
    word, use = ragged(n_words), codes.indices.to_numpy(zero_copy_only=False)
    some = np.flatnonzero(n_words)
    starts = word[:-1][some]
    doc = np.repeat(np.arange(len(some)), n_words[some])
    p = like[use].T.copy()  # language x word
    n = n_words[some].astype(np.float64)

    whole, gap = _em(p, doc, starts, n)
    order = np.argsort(-whole, axis=1, kind="stable")
    penalty = PENALTY * np.log(n + 1)
    best = np.add.reduceat(np.log(np.maximum(p[order[doc, 0], np.arange(len(doc))], 1e-300)), starts)
    raw, out = best.copy(), np.zeros((len(some), n_langs))
    out[np.arange(len(some)), order[:, 0]] = 1.0
    for size in range(2, n_langs + 1):
        # No mixture of any languages is likelier than ``gap``: where that can't pay for the set, larger ones can't either.
        alive = np.flatnonzero(gap - (size - 1) * penalty > best)
        if not len(alive):
            break
        at = np.flatnonzero(np.isin(doc, alive)) if len(alive) < len(some) else np.arange(len(doc))
        own = np.repeat(np.arange(len(alive)), n_words[some][alive])
        chosen = order[alive, :size]
        held = p[chosen[own].T, at]
        pi, _ = _em(held, own, ragged(n_words[some][alive])[:-1], n[alive])
        plain = np.add.reduceat(np.log(np.maximum((pi[own].T * held).sum(axis=0), 1e-300)), ragged(n_words[some][alive])[:-1])
        fit_ = plain - (size - 1) * penalty[alive]
        better = fit_ > best[alive]
        won = alive[better]
        best[won], raw[won], out[won] = fit_[better], plain[better], 0.0
        out[won[:, None], chosen[better]] = pi[better]
    # A set of one still tells how sure it is: its share among all languages.
    single = out.max(axis=1) > 1 - 1e-12
    at = out.argmax(axis=1)
    out[single, at[single]] = np.minimum(1.0, whole[single, at[single]])
    shares[some] = out
    base = segment_sum(model.base[grams], offsets) / len(GRAMS) + top[:, 0]
    told[some] = raw + np.add.reduceat(base[use], starts)
    return shares, n_words, told


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, langs, shares, n_words of every row.

    lang_pred is the language of the largest share, score that share; langs and shares are the chosen
    set, largest first. Null texts and texts without letters, and all texts if the model knows no
    language, are ``und`` with score 0. Ties go to the language first in order. Narrow.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [*model.langs, UNKNOWN]
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                shares, n, _ = mixtures(model, filled(part["text"]))
                rows = np.arange(len(n))
                order = np.argsort(-shares, axis=1, kind="stable")
                chosen = [[j for j in o if s[j] > 0] for o, s in zip(order, shares)]
                first = np.where(shares.any(axis=1), order[:, 0], len(model.langs)) if model.langs else np.zeros(len(n), dtype=int)
                score = np.clip(shares[rows, np.minimum(first, shares.shape[1] - 1)], 0, 1) if model.langs else np.zeros(len(n))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([names[j] for j in first], pa.string()), pa.array(score), pa.array([[names[j] for j in c] for c in chosen], pa.list_(pa.string())), pa.array(
                        [[float(s[j]) for j in c] for c, s in zip(chosen, shares)], pa.list_(pa.float64()),
                    ), pa.array(n.astype(np.int64))],
                    names=["doc_id", "lang_pred", "score", "langs", "shares", "n_words"],
                )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text has letters and is likelier under its mixture of languages,
    whatever their shares, than under no language.

    If the model knows no language, nothing can be told from text: all rows with letters are kept. Null,
    empty and letterless texts go. Repeated rows are kept or go together; an empty table stays empty. Narrow.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        if not model.langs:
            return lambda texts: mixtures(model, texts)[1] > 0
        return lambda texts: mixtures(model, texts)[2] > 0

    return keep_rows(docs, text_col, make, 2 << 20)
