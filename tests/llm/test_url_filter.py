import re

from pyspark.sql import functions as F

from cityhop.llm.url_filter import RULES, filter_urls, host_edges, propagate

PAGES = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:0:-1] if fits else (None, None)


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/de/2?q=/en/", "http://net/", "http://x.NET", "ftp://u.org/fr/x", "http://org/en#/fr/", "http://notorg/fr/",
    "http://example.com/de/1", "http://b.example.com/DE/1", "http://é.example.com/de/", "no scheme", "://odd.net/x", "http://?q", "http://a.net/en/://b.org/fr/", "", None,
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)).withColumn("src", F.lit(2))).collect()}
    for i, u in enumerate(URLS):
        host, path = split(u)
        name, verdict = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, name), u
        if verdict:
            assert got[i]["verdict"] == verdict
        assert got[i]["verdict"] in ("allow", "block")


def brute(edges, restart, damping=0.85, steps=400):
    hosts = {h for e in edges for h in e[:2]} | set(restart)
    out = {}
    for k, pairs in (("trust", [(a, b, n) for a, b, n in edges]), ("distrust", [(b, a, n) for a, b, n in edges])):
        total = {}
        for a, _, n in pairs:
            total[a] = total.get(a, 0) + n
        ways = [(a, b, n / total[a]) for a, b, n in pairs] + [(h, h, 1.0) for h in hosts if h not in total]
        s = {h: restart.get(h, (0.0, 0.0))[k == "distrust"] for h in hosts}
        p = dict(s)
        for _ in range(steps):
            new = {h: (1 - damping) * s[h] for h in hosts}
            for a, b, w in ways:
                new[b] += damping * w * p[a]
            p = new
        out[k] = p
    return out


def test_propagation_matches_power_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("e", "d", 1), ("f", "e", 5), ("f", "a", 1)]
    restart = {"a": (1.0, 0.0), "d": (0.0, 1.0), "z": (0.25, 0.5)}
    got = propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame([(h, *v) for h, v in restart.items()], "host string, trust double, distrust double"), tolerance=1e-9)
    want = brute(edges, restart)
    rows = {r["host"]: r for r in got.collect()}
    assert rows.keys() == want["trust"].keys()
    assert all(abs(rows[h][k] - want[k][h]) < 1e-6 for h in rows for k in want)


def test_links_and_verdicts_of_unruled_hosts(spark):
    bad = "<a href='http://spam.net/x'>x</a> <A HREF=//Spam2.net/y> <a href=\"/own\">"
    rows = [(1, "http://farm.info/a", bad), (2, "http://farm.info/b", bad), (3, "http://good.info/", '<a href="http://u.org/fr/1">'), (4, "http://spam.net/x", None), (5, "http://spam2.net/y", ""), (6, "http://u.org/fr/1", "x" * 100_000), (7, None, bad), (8, "http://lone.info/", None), (8, "http://lone.info/", None)]
    pages = spark.createDataFrame(rows, PAGES)
    assert {tuple(r) for r in host_edges(pages).collect()} == {("farm.info", "spam.net", 2), ("farm.info", "spam2.net", 2), ("good.info", "u.org", 1)}
    verdict = [(r["page_id"], r["verdict"]) for r in filter_urls(pages).collect()]
    assert sorted(verdict) == [(1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "block"), (6, "allow"), (7, "allow"), (8, "allow"), (8, "allow")]


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_verdicts_do_not_turn_on_how_many_link(spark):
    links = {
        "farm1.info": ["a.net"], "farm2.info": ["a.net"],  # share a blocked host
        "farm.info": ["b.net", "c.net", "d.net"], "fan1.info": ["farm.info"], "fan2.info": ["farm.info"],  # a farm that is linked itself
        "list.info": ["e.net", *[f"h{i}.info" for i in range(9)]], "two.info": ["farm.info", "g1.info", "g2.info", "g3.info"],  # innocent linkers
        **{f"many{i}.info": ["z.net"] for i in range(40)},
    }
    rows = [(h, " ".join(f'<a href="http://{t}/">' for t in to)) for h, to in links.items()]
    rows += [(h, None) for h in {t for to in links.values() for t in to} - links.keys()]
    pages = spark.createDataFrame([(i, f"http://{h}/", html) for i, (h, html) in enumerate(rows)], PAGES)
    got = {r["host"]: r for r in filter_urls(pages).collect()}
    assert {h for h in links if got[h]["verdict"] == "block"} >= {"farm1.info", "farm2.info", "farm.info", *[f"many{i}.info" for i in range(40)]}
    assert got["list.info"]["verdict"] == got["two.info"]["verdict"] == "allow"
    assert got["farm.info"]["distrust"] > got["fan1.info"]["distrust"] > got["two.info"]["distrust"]
    assert all(0 <= r[k] <= 1.001 for r in got.values() for k in ("trust", "distrust"))
