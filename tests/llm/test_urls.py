"""URL rules and trust propagation against SQL and hand-made graphs."""

import duckdb
import numpy as np
import pytest

from lorebase.llm import urls


def page(i, url, *links):
    return i, url, "<html>" + "".join(f'<a class=x href="{u}">t</a>' for u in links) + "</html>"


PAGES = [
    page(1, "https://WWW.Example.com/en/1?x#y", "http://b.org/"), page(2, "http://example.com/en/1"), page(3, "http://example.com/fr/1"),
    page(4, "http://x.net/es/1", "/local"), page(5, "http://x.net/es/2"), page(6, None), page(7, "no scheme/en/"), page(8, "http://example.com"),
    page(9, "http://notexample.com/en/"), page(10, "http://net/fr/"), page(11, "http://spam.org/a", "http://x.net/es/1", "//net/fr/"),
    page(12, "http://mixed.org/a", "http://x.net/es/1", "http://good.com/"), page(13, "http://good.com/"), page(14, "http://friend.org/"),
    page(15, "http://good.com/2", "http://friend.org/b"), page(16, "http://far.org/", "http://spam.org/a"), page(16, "http://far.org/", "http://spam.org/a"),
    (17, "http://null.org/", None), (None, "ftp://Host.DE:80?q", ""), page(18, "http://user@host.com#f"), page(19, "a://b://c/d"), page(20, ""),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string").repartition(3)
    return {}, urls.judge(df).collect(), df


def test_equals_sql(judged):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert sorted(map(tuple, judged[1]), key=str) == sorted(con.execute(urls.check_sql()).fetchall(), key=str)


def test_rules_and_propagation(judged):
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged[1]}
    assert by[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[2][2:] == ("example.com/en/", "block") and by[3][2:] == ("com/", "allow") and by[8] == ("example.com", "", None, "allow")
    assert by[6] == ("", "", None, "allow") == by[7] and by[9][2] == "com/" and by[10][2:] == ("net/fr/", "block")
    assert by[11][3] == "block" and by[16][3] == "block"  # links to blocked hosts, also at second hand
    assert by[12][3] == "allow" and by[14][3] == "allow" and by[19] == ("b:", "//c/d", None, "allow")


def test_empty(judged):
    assert urls.judge(judged[2].limit(0)).count() == 0


def test_propagation_converges_on_cycles(spark):
    rng = np.random.default_rng(5)
    edges = {(f"h{i}", f"h{(i + 1) % 6}"): 1 for i in range(6)} | {(f"h{a}", f"h{b}"): int(n) for a, b, n in rng.integers(1, 6, (8, 3)) if a != b}
    seeds = [("h0", "distrust", 1.0), ("h3", "trust", 0.5)]
    frames = spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, kind string, score double")
    links = np.zeros((6, 6))
    for (a, b), n in edges.items():
        links[int(a[1]), int(b[1])] = n
    tolerance, worst = 1e-4, 0.0
    rows = urls.propagate(*frames, damping=0.85, rounds=None, tolerance=tolerance).collect()
    for kind, out in (("trust", links), ("distrust", links.T)):
        seed = np.array([sum(s for h, k, s in seeds if (h, k) == (f"h{i}", kind)) for i in range(6)])
        want = np.linalg.solve(np.eye(6) - 0.85 * (out / out.sum(axis=1, keepdims=True)).T, seed)
        got = {r.host: r.score for r in rows if r.kind == kind}
        worst = max(worst, max(abs(got[f"h{i}"] - want[i]) for i in range(6)))
    assert worst < 6 * tolerance * 0.85 / 0.15


def test_host_above_the_threshold_only_after_convergence(spark):
    # two hosts in a cycle, the seed wholly blocked: the excess of h1 converges to 0.85 / (1 - 0.85 ** 2)
    pages = spark.createDataFrame([page(1, "http://x.net/es/1", "http://b.org/"), page(2, "http://b.org/", "http://x.net/es/1")], "page_id long, url string, html string")
    limit = 0.85 / (1 - 0.85**2)
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages, tolerance=1e-6, threshold=limit * 0.997).collect()}
    assert verdicts == {1: "block", 2: "block"}
