"""URL templates: long paths, large subtrees, and clashing columns, against a plain tree."""

from __future__ import annotations

import random
import time

import duckdb
import pytest

from foldspark.llm import url_tree


def _pages(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    hosts = ["spam.net", "fine.org", "shop.example.com", "www.example.com", "x.org"]
    segs = ["es", "fr", "en", "a", "b", "c-d", "item", "12", "7a", "p.html"]
    rows = []
    for i in range(n):
        parts = [rng.choice(segs) if rng.random() < 0.7 else f"slug{rng.randrange(60)}" for _ in range(rng.randint(0, 6))]
        rows.append((i, f"http://{rng.choice(hosts)}/{'/'.join(parts)}{rng.choice(['', '/', '?q', '#x'])}"))
    return rows


def _by_sql(rows: list[tuple]) -> list[tuple]:
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    return sorted(con.execute(f"select page_id, host, path, rule, verdict, template, purity from ({url_tree.sql()})").fetchall(), key=str)


@pytest.mark.parametrize("group", [2000, 8])
def test_large_subtrees_give_the_same_rows(spark, monkeypatch, group):
    monkeypatch.setattr(url_tree, "GROUP", group)
    rows = _pages(3, 900)
    df = spark.createDataFrame([(i, u, "s", "t", 1, 2, "h") for i, u in rows], "page_id long, url string, seg string, template string, salt int, level int, host string")
    got = url_tree.filter_urls(df).select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect()
    assert sorted(map(tuple, got), key=str) == _by_sql(rows)


def test_a_thousand_segments_beside_short_paths(spark):
    trap = "/".join(f"s{i % 7}" for i in range(1000))
    rows = _pages(5, 300) + [(1000, f"http://trap.org/{trap}/1"), (1001, f"http://trap.org/{trap}/2"), (1002, "http://deep.org/" + "y/" * 20_000)]
    began = time.perf_counter()
    got = {r["page_id"]: r for r in url_tree.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.perf_counter() - began < 60
    assert len(got) == 303 and got[1000]["template"] == got[1001]["template"] == f"{trap}/*" and got[1002]["template"].count("/") == 19_999


def test_a_common_beginning_is_passed_in_one_step(spark, monkeypatch):
    monkeypatch.setattr(url_tree, "GROUP", 5)
    trap = "/".join(f"s{i}" for i in range(300))
    rows = [(i, f"http://a.org/{trap}/{'uvw'[i % 3]}{i}/end") for i in range(40)] + [(50, f"http://a.org/{trap}"), (51, f"http://a.org/{trap}-/k")]
    began = time.perf_counter()
    got = {r["page_id"]: r["template"] for r in url_tree.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.perf_counter() - began < 90
    assert {got[i] for i in range(40)} == {f"{trap}/*/end"} and got[50] == trap and got[51] == f"{trap}-/k"
