"""Operators against brute force, exact round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import decontaminate, langid, license_index, mixing, simhash, syncmers, token_counts, token_output, toxicity, url_tree

SCHEMA = "doc_id long, text string, lang string, source string, size string, key int"
LICENSE = "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3. All rights reserved."
EDGES = [(1, None, None, None, "x", 1), (2, "", "en", "a", "x", 1), (3, " \n\t", "en", "a", "x", 1), (None, "no id here", "en", None, None, None), (5, "twice the same text", "en", "b", "x", 1), (5, "twice the same text", "en", "b", "x", 1), (6, "long " * 30_000, "en", "b", "x", 2), (7, "<|endoftext|> Été Σ don't 12", "fr", "c", "x", 3), (8, LICENSE, "en", "a", "y", 4)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts(60, 1)
    texts += [texts[3], texts[4] + " tail", texts[5].upper(), ""]
    return spark.createDataFrame([(i * 3, t, "en", f"s{i % 4}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer())


def test_token_counts(docs, edges, empty):
    lib = _library()
    for df in (docs, edges):
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df).collect())
        want = []
        for r in df.collect():
            t = r["text"] or ""
            n = len(lib.encode(t, add_special_tokens=False).ids)
            want.append((r["doc_id"] if r["doc_id"] is not None else -1, len(t.encode()), n, n > 2048))
        assert got == sorted((x[0] or -1, *x[1:]) for x in want)
    assert token_counts.count_tokens(empty).count() == 0


def test_rank_merging_of_odd_strings():
    m, lib = token_counts.merger(token_counts.default_tokenizer()), _library()
    rng = random.Random(3)
    words = ["a" * n for n in (1, 2, 3, 7, 64, 999)] + ["".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    assert m.counts(words).tolist() == [len(lib.encode(w, add_special_tokens=False).ids) for w in words]


@pytest.mark.parametrize("layout", ["dictionary", "delta"])
def test_token_files_round_trip(spark, docs, layout):
    lib = _library()
    got = {r["doc_id"]: r for r in token_output.token_files(docs, layout=layout).collect()}
    digest = {r["doc_id"]: r for r in token_output.token_digest(token_output.token_files(docs, layout=layout)).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*lib.encode(r["text"], add_special_tokens=False).ids, 1]
        assert (got[r["doc_id"]]["start"], list(got[r["doc_id"]]["ids"])) == (start, ids)
        assert digest[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_edges(edges, empty):
    rows = token_output.token_files(edges).orderBy("start").collect()
    assert len(rows) == len(EDGES) and rows[0]["doc_id"] is None and [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert token_output.token_files(empty).count() == 0
    lib = _library()
    assert next(list(r["ids"]) for r in rows if r["doc_id"] == 7) == [*lib.encode(EDGES[7][1], add_special_tokens=False).ids, 1]


def test_edit_comparison(docs):
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in syncmers.edit_comparison(docs, parts=5).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in syncmers.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        t, a = r["text"], rows[(i + 1) % len(rows)]["text"]
        h = len(t) // 2
        edited = t[: len(t) - h] + a[:h]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g["fingerprint"] == prints[r["doc_id"]] == syncmers.sketches([t])[0].tobytes().hex()
        assert g["edited_fingerprint"] == syncmers.sketches([edited])[0].tobytes().hex()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1


def test_syncmers_are_context_free():
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = make(300)
    a, b = make(100) + core, make(37) + core + make(50)
    _, pa_, ha = syncmers.anchors([a])
    _, pb, hb = syncmers.anchors([b])
    inside = {(p - 100, h) for p, h in zip(pa_, ha) if p >= 100}
    assert inside and inside <= {(p - 37, h) for p, h in zip(pb, hb)}
    # brute force of the choice on one text
    _, pos, _ = syncmers.anchors([a])
    codes = np.frombuffer(a.encode("utf-32-le"), "<u4").astype(np.uint64)
    inner = syncmers._rolling(codes, syncmers.S)
    w = syncmers.K - syncmers.S + 1
    assert sorted(pos.tolist()) == [i for i in range(len(a) - syncmers.K + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])]


def test_syncmer_edges(edges, empty, spark):
    got = syncmers.edit_comparison(edges).collect()
    assert len(got) == len(EDGES)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {syncmers.EMPTY}
    assert syncmers.edit_comparison(empty).count() == 0
    one = syncmers.edit_comparison(spark.createDataFrame([(1, "only one document here, its own next")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert syncmers.syncmer_anchors(edges).count() == len(EDGES)


def _simhash(text: str) -> int:
    from xxhash import xxh64_intdigest

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints: dict[int, int], radius: int) -> dict[int, int]:
    ids, of = sorted(prints), {i: i for i in prints}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                of[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = " ".join(_texts(30, 9))
    rows += [(1000 + i, base + " " + x) for i, x in enumerate(["", "a", "b c", "d", "a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: _simhash(t) for i, t in rows}
    want = _components(prints, 3)
    got = simhash.near_duplicates(df).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert want[1001] == want[1004] == want[1000]


def test_simhash_tiles_miss_no_link(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 3)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.components(simhash.links(df, piece=8)).collect()
    got = {x: x for x in signed} | {r["node"]: r["component"] for r in found}
    want = _components({x: x & (2**64 - 1) for x in signed}, 3)
    assert got == want


def test_simhash_edges(edges, empty):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_language_mixture(spark, edges, empty):
    rng = random.Random(2)
    alpha = {"xa": ["kato", "meri", "lonka", "sipu", "tavo"], "yb": ["grüft", "schnaz", "verzug", "blöde", "krampf"]}
    text = lambda k, n: " ".join(rng.choice(alpha[k]) + rng.choice(["", "s", "en"]) for _ in range(n))
    rows = [(i, text(k, 40), k) for i, k in enumerate(["xa", "yb"] * 60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in langid.identify(train, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    mixed = spark.createDataFrame([(1, text("xa", 60) + " " + text("yb", 30))], "doc_id long, text string")
    r = langid.identify(mixed, model).first()
    assert r["langs"] == ["xa", "yb"] and r["shares"][0] == pytest.approx(2 / 3, abs=0.1)
    out = langid.identify(edges, model).collect()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in out)
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty, F.lit(True)).langs == []
    assert {r["lang_pred"] for r in langid.identify(edges, langid.fit(empty, F.lit(True))).collect()} == {"und"}
    assert langid.keep_identified(edges, model).columns == edges.columns


def test_toxicity(spark, edges, empty):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))] + ["grubface"] * (3 * toxic)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, known, F.col("doc_id") % 5 != 2)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, machine).collect()}
    held = [(got[i], t) for i, t in labels if i % 5 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert len(toxicity.score(edges, machine).collect()) == len(EDGES) and toxicity.score(empty, machine).count() == 0
    none = toxicity.fit(docs, known.where("false"), F.lit(True))
    assert {r["predicted"] for r in toxicity.score(edges, none).collect()} == {0}


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append([1] * bool(a) + [2] * bool(b) + rng.integers(10, 60, 5).tolist())
        y.append(float(a and b))
    ids = np.array([x for r in rows for x in r])
    offsets = np.append(0, np.cumsum([len(r) for r in rows]))
    m = toxicity.train(ids, offsets, np.array(y), np.ones(len(y)))
    one, both = m.margin(np.array([1, 2]), np.array([0, 1, 2])), m.margin(np.array([1, 2]), np.array([0, 2]))
    assert both[0] > 0 > one.max()


def test_toxicity_learns_exclusive_or():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append([1] * bool(a) + [2] * bool(b) + np.unique(rng.integers(10, 60, 8)).tolist())
        y.append(float(a != b))
    ids, offsets, y = np.array([x for r in rows for x in r]), np.append(0, np.cumsum([len(r) for r in rows])), np.array(y)
    assert not toxicity.telling(ids, offsets, y, np.ones(len(y)))[[1, 2]].any()
    m = toxicity.train(ids, offsets, y, np.ones(len(y)))
    assert ((m.margin(ids, offsets) > 0) == (y > 0)).mean() > 0.99
    # the margin by brute force
    for i in range(20):
        own = ids[offsets[i] : offsets[i + 1]]
        want = m.bias + sum(float(m.weight[x]) for x in own) + sum(float(m.vector[x].astype(float) @ m.vector[z].astype(float)) for k, x in enumerate(own) for z in own[:k])
        assert m.margin(own, np.array([0, len(own)]))[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_terms_read_whole_words():
    long = "ab" * 60
    ids = toxicity.term_ids([long, long[:-1] + "c", "abcdefg", "abcdexyz", "abcde", "edcba"])
    assert ids[0, 0] != ids[1, 0] and ids[0, 1] == ids[1, 1] and ids[2, 1] == ids[3, 1] == ids[4, 1] != ids[5, 1] and ids[2, 0] != ids[3, 0]


def test_language_shares_by_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(langid.BUCKETS) * 0.05, 3).T + 1e-9)
    mean = table.mean(axis=1)
    model = langid.LanguageModel(["a", "b", "c"], table - mean[:, None], mean + np.log(langid.BUCKETS))
    words = ["kato", "meri", "lonka", "sipu", "tavo", "x", "été"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 3, 12, 40)]
    shares, n, told = langid.mixtures(model, pa.array(texts))
    for text, got, length, raw in zip(texts, shares, n, told):
        each = []
        for w in text.split():
            grams, _ = langid.word_grams([w])
            each.append(table[grams].sum(axis=0) / len(langid.GRAMS))
        each = np.array(each)
        like = np.maximum(np.exp(each - each.max(axis=1, keepdims=True)), 1e-9)

        def em(own, rounds, like=like):
            pi = np.array([1 / len(own) if j in own else 0 for j in range(3)])
            for _ in range(rounds):
                r = pi * like
                pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            return pi, float(np.log((pi * like).sum(axis=1)).sum())

        whole, _ = em([0, 1, 2], langid.ROUNDS)
        order = np.argsort(-whole, kind="stable")
        sets = [em(order[:k].tolist(), 1 if k == 1 else langid.ROUNDS) for k in (1, 2, 3)]
        best = max(range(3), key=lambda k: (sets[k][1] - langid.PENALTY * k * np.log(len(each) + 1), -k))
        want = sets[best][0]
        if best == 0:
            want = np.where(want > 0, whole, 0)
        assert got == pytest.approx(want, abs=1e-4) and length == len(each)
        base = sum(float((mean + np.log(langid.BUCKETS))[langid.word_grams([w])[0]].sum()) / len(langid.GRAMS) for w in text.split())
        assert raw == pytest.approx(sets[best][1] + float((each - np.log(1)).max(axis=1).sum()) - sum(float(mean[langid.word_grams([w])[0]].sum()) / len(langid.GRAMS) for w in text.split()) + base, rel=1e-3, abs=1e-2)


def test_texts_of_marks_alone_have_no_language(spark):
    rows = [(i, t, "xa") for i, t in enumerate(["kato meri", "lonka sipu"] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    docs = spark.createDataFrame([(1, "\u0301\u0301 \u0300"), (2, "12 \u0301!"), (3, "kato \u0301")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()} == {1: "und", 2: "und", 3: "xa"}
    none = langid.LanguageModel([], np.zeros((langid.BUCKETS, 0)), np.zeros(langid.BUCKETS))
    assert {r["doc_id"] for r in langid.keep_identified(docs, none).collect()} == {3}


def test_cuts_are_found_in_several_rounds(spark):
    rng = random.Random(9)
    rows = [(i if i % 7 else 5, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", None])) for i in range(3000)]
    sized = mixing._sized(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source", None)
    targets = mixing.source_targets(sized)
    one = {r["source"]: tuple(r) for r in mixing.cuts(sized, targets).collect()}
    assert one == {r["source"]: tuple(r) for r in mixing.cuts(sized, targets, buckets=4, few=8).collect()}


def test_deep_urls_and_repeated_rows(spark):
    deep = "/".join(f"s{i}" for i in range(30))
    rows = [(1, f"http://a.net/{deep}/1", "x"), (1, f"http://a.net/{deep}/1", "x"), (2, f"http://a.net/{deep}/2", "y"), (3, "http://b.org/" + "x" * 50_000, None), (None, "http://b.org/q", "z")]
    got = url_tree.filter_urls(spark.createDataFrame(rows, "page_id long, url string, template string")).collect()
    assert len(got) == 5 and {r["template"] for r in got if r["page_id"] in (1, 2)} == {f"{deep}/*"}


def test_special_strings_keep_their_case(spark):
    lib = _library()
    texts = ["<|STARTOFTEXT|> hi", "<|endoftext|> Hi <|ENDOFTEXT|>", "x\x01y \x7f,", "Ça, é. \u2028ok", "\u0558 \u1c89a, b", "  lead and trail  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: list(r["ids"]) for r in token_output.token_files(df).collect()} == {i: [*x, 1] for i, x in want.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()} == {i: len(x) for i, x in want.items()}


@pytest.mark.parametrize("layout", ["dictionary", "delta"])
def test_token_files_layout(spark, layout, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(1)
    rows = [(i, " ".join(str(rng.randint(0, 99)) for _ in range(60))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_output.write_tokens(df, f"file://{tmp_path}/t", layout=layout, row_group_bytes=1 << 18, page_bytes=1 << 14, page_rows=500, parts=1)
    name = next(str(p) for p in (tmp_path / "t").iterdir() if p.name.endswith(".parquet"))
    meta = pq.ParquetFile(name).metadata
    assert meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            col = meta.row_group(g).column(c)
            assert col.has_column_index or col.path_in_schema.startswith("ids.")
            assert col.has_offset_index and col.compression == "ZSTD"
            if col.path_in_schema.startswith("ids."):
                assert ("DICTIONARY" in str(col.encodings)) == (layout == "dictionary") and ("DELTA_BINARY_PACKED" in str(col.encodings)) == (layout == "delta")
    some = token_output.read_tokens(spark, f"file://{tmp_path}/t").where("doc_id between 3000 and 3001")
    assert sorted(r["doc_id"] for r in some.collect()) == [3000, 3001]
    plan = token_output.read_metadata(spark, f"file://{tmp_path}/t")._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan.split("ReadSchema")[1]


def test_licence_files_with_many_licences(spark):
    lines = [t.text for t in license_index.TEMPLATES]
    docs = spark.createDataFrame([(1, ". ".join(lines))] + [(i + 2, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_index.scan_licenses(docs).collect()}
    assert got[1] == {t.label for t in license_index.TEMPLATES}
    assert all(t.label in got[i + 2] for i, t in enumerate(license_index.TEMPLATES))


def test_a_shared_folder_is_required_off_one_machine():
    from types import SimpleNamespace

    from foldspark.llm._common import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(far)


def test_mix(spark, docs, edges, empty):
    rows = mixing.mix(docs).collect()
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    total = sum(size.values())
    w = dict(zip(sorted(size), (5, 2, 1, 5)))
    target, open_ = {}, set(size)
    while True:  # stop at three times the size, share the excess
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    target |= {s: w[s] * level for s in open_}
    taken = {}
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert sum(r["taken"] for r in rows) == sum(len((r["text"] or "").split()) for r in mixing.mixed(docs).collect())
    got = mixing.mix(edges).collect()
    assert len(got) == len(EDGES) and all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0 and mixing.mixed(edges).columns == edges.columns


def test_licenses(spark, edges, empty):
    got = {r["doc_id"]: r for r in license_index.scan_licenses(edges).collect()}
    r = got[8]
    assert (r["n_base"], r["base_labels"]) == (3, "cc-by,gpl,reserved") and {"cc-by-nc", "gpl-3.0"} <= set(r["labels"].split(","))
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, 0, None, "", 0.0)
    assert got[6]["n_words"] == 30_000 and license_index.scan_licenses(empty).count() == 0
    odd = spark.createDataFrame([(1, "cc-by cc by CC BY x"), (2, "by cc, all the rights reserved"), (3, "the MIT  license; Kcc by")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_index.scan_licenses(odd).collect()}
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"]) == (3, 0, 4)
    assert out[2]["n_base"] == 0 and out[3]["n_base"] == 0 and "mit" in out[3]["labels"]


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/1?x#y", "http://example.net/fr/5", "http://www.example.com/en/5", "http://example.com/en/5", "http://x.org/a/b", "http://x.org#f", "http://notcom/en/"]
    got = [r for r in url_tree.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "/en/1", "example.com/en/"), ("example.net", "/fr/5", "net/fr/"), ("www.example.com", "/en/5", "www.example.com/en/"), ("example.com", "/en/5", "example.com/en/"), ("x.org", "/a/b", None), ("x.org", "", None), ("notcom", "/en/", None),
    ]
    assert [r["verdict"] for r in got[3:7]] == ["block", "block", "allow", "block"] and all(r["verdict"] in ("allow", "block") for r in got)
    assert url_tree.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_templates_reject_by_purity(spark):
    rows = [(i, f"http://spam.net/{'es' if i % 2 else 'fr'}/{i}") for i in range(60)] + [(100 + i, f"http://fine.org/{i}/page") for i in range(20)]
    got = {r["page_id"]: r for r in url_tree.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0]["template"] == "*/*" and got[0]["purity"] > 0.7 and got[100]["template"] == "*/page" and got[100]["verdict"] == "allow"


def test_decontamination(spark, edges, empty):
    item = "A train leaves Boston at 60 km per hour and travels 120 km before it stops in Albany for 15 minutes to change its crew."
    swapped = item.replace("60", "75").replace("120", "150").replace("15", "20").replace("Boston", "Denver").replace("Albany", "Omaha")
    bench = spark.createDataFrame([(1, item), (2, "too few words"), (3, None), (4, "the cat sat on the mat and slept for a very long while there")], "item_id long, text string")
    filler = " ".join(_texts(3, 8))
    rows = [(1, f"{filler}. {item} {filler}"), (2, f"{filler}. {swapped} {filler}"), (3, filler), (4, "1 2 3 4 5 6 7 8 9 10"), (5, None), (6, "the cat sat on the mat")]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2} and got[1]["exact"] and not got[2]["exact"] and got[2]["consistent"] >= 0.8 and got[2]["n_slots"] >= 3
    assert {r["doc_id"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block=10).collect()} == {1, 2}
    assert decontaminate.contaminated(edges, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(edges, bench.where("false")).count() == 0
    kept = decontaminate.keep_clean(edges, bench)
    assert kept.count() == len(EDGES) and kept.columns == edges.columns


def test_inconsistent_slots_are_no_match():
    import pyarrow as pa

    table = decontaminate.ItemTable([(1, "give 5 apples to Ann then take 5 apples from Ann and give 5 to Ann again now please")])
    text = "give 1 apples to Bob then take 2 apples from Cat and give 3 to Dan again now please"
    tokens = decontaminate.Tokens(pa.array([text]))
    assert decontaminate.judged(table, tokens, *table.found(tokens)) == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(_texts(1, 77)[0].split()[:30]) + " ends here with seven more plain words"
    texts = _texts(40, 21)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts) if t]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, f"{texts[2]} {item}", "en", "s1", 1), (102, None, "en", "s1", 0), (103, "123 456", "en", "s2", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept["language_id"] == {r[0] for r in rows} - {102, 103}
    assert 100 not in kept["near_duplicates"] and 0 in kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["decontamination"] == {101}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "token_files"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids"] and {r["doc_id"] for r in out.collect()} == kept["source_mix"]


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    rows = [(r[0], r[1], r[2], r[3], 1, "k") for r in EDGES]
    for name, some in (("edges", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None)] if some else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/edges").collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in rows} and 6 in {r["doc_id"] for r in out}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
