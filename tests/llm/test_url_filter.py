"""URL filter: resolved targets against urllib, alias groups against union-find, and both against the SQL."""

from urllib.parse import urljoin

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from advertlake.llm import queries as Q
from advertlake.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, rule string"
REFS = ["q2", "../e", "?p=1", "/a/./b/../c", "//h.org/x", "http://Z.com/y?u=1&amp;v=2", "./", "..", "../../../up", "a/b/../c?x=/../y", "", "x?u=http://other.com/", "q#part"]
BASES = ["http://e.info/en/q1", "http://e.info", "https://e.info/a/b/c/d?q=/z/", "http://e.info/a/"]


@pytest.mark.parametrize("base", BASES)
def test_targets_resolve_as_in_a_browser(spark, base):
    rows = spark.createDataFrame([(r,) for r in REFS], "r string").select("r", U.resolved(F.lit(base), F.col("r")).alias("u")).collect()
    for r in rows:
        want = urljoin(base, r.r.replace("&amp;", "&")).split("#")[0]
        assert r.u.split("://")[1] == want.split("://")[1] or r.u.split("://")[1] + "/" == want.split("://")[1], (r.r, r.u, want)


def _page(i, url, to=None, kind="canonical", base=""):
    tag = f'<link rel="canonical" href="{to}">' if kind == "canonical" else f'<META http-equiv="Refresh" content="0; url={to}">'
    return (i, url, None if to is None else f"<html>{base}{tag}</html>", "clash", "clash")


def _random_pages(seed):
    rng = np.random.default_rng(seed)
    urls = [f"http://h{i % 7}.{('info', 'com', 'net', 'example.net', 'example.com')[rng.integers(5)]}/{('en', 'de', 'x')[rng.integers(3)]}/{i}" for i in range(120)]
    pages = [_page(i, u, urls[rng.integers(max(0, i - 6), min(120, i + 7))] if rng.random() < 0.6 else None, "refresh" if i % 2 else "canonical") for i, u in enumerate(urls)]
    pages += [_page(200 + i, f"http://chain.info/{i}", f"{i + 1}") for i in range(40)] + [_page(299, "http://chain.info/40", "http://a.com/en/x")]
    pages += [_page(300 + i, f"http://cycle.info/{i}", f"/{(i + 1) % 5}") for i in range(5)]
    pages += [_page(400, "http://s.info/a/b", "../z?k=1&amp;l=2"), _page(401, "http://s.info/z?k=1&l=2", "http://b.org/es/1"), _page(402, "http://t.info/", "z?k=1&l=2", base='<base href="http://s.info/">')]
    return pages + [_page(500, None, "http://a.com/en/x"), _page(501, "no scheme", "http://a.com/en/x"), _page(502, "http://chain.info/3"), (503, "http://q.info/", None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_union_find_and_the_sql(spark, seed):
    pages = _random_pages(seed)
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(spark.createDataFrame(pages, SCHEMA)).collect()}
    pages_table = pd.DataFrame(pages, columns=["page_id", "url", "html", "host", "rule"])
    con = duckdb.connect()
    con.register("pages", pages_table)
    names = ["page_id", "host", "path", "rule", "verdict"]
    assert got == set(con.sql(Q.ORACLE_SQL["op4_url_filter"]).select(", ".join(names)).fetchall())

    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    def node(u):
        host, _, rest = u.split("://")[1].partition("/")
        return host.lower() + "/" + rest

    def rule(u):
        host, _, rest = node(u).partition("/")
        path = "/" + rest.split("?")[0]
        fit = [(len(h + p), v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    seen = set()
    for _, u, html, _, _ in pages:
        if u and "://" in u:
            seen.add(u)
            if html:
                base = html.split('<base href="')[1].split('"')[0] if "<base" in html else u
                to = html.split('href="')[-1].split('"')[0] if "canonical" in html else html.split("url=")[1].split('"')[0]
                to = urljoin(base, to.replace("&amp;", "&"))
                seen.add(to)
                root[find(node(u))] = find(node(to))
    verdicts = {}
    for u in seen:
        verdicts.setdefault(find(node(u)), set()).add(rule(u))
    for i, u, _, _, _ in pages:
        want = "allow"
        if u and "://" in u:
            of = verdicts[find(node(u))]
            want = rule(u) or ("block" if "block" in of and "allow" not in of else "allow")
        assert [v for p, _, _, _, v in got if p == i] == [want], (i, u)
    assert {v for p, _, _, _, v in got if 200 <= p < 300} == {"block"}


def test_rules_may_be_a_table(spark):
    rules = spark.createDataFrame([("block", f"h{i}.com", "/") for i in range(3000)] + [("allow", "com", "/")], "verdict string, host string, path string")
    pages = spark.createDataFrame([_page(i, f"http://w.h{i}.com/x") for i in range(2990, 3010)], SCHEMA)
    got = {r.page_id: r.verdict for r in U.judge(pages, rules).collect()}
    assert got == {i: "block" if i < 3000 else "allow" for i in range(2990, 3010)}
