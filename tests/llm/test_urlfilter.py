from tallyrift.llm.urlfilter import url_verdicts

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr/x", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://X.Example.NET/en/1?q", "http://example.net/en", "https://notexample.com/de/",
    "https://www.example.com/de/", "https://www.example.com/DE/", "http://b.org/fr/", "http://a.org/fr/xy", "http://z.a.org/fr/y", "x://y.org/fr/?a://b", "http://example.com:80/de/",
    "http://net?x", "http://a..net/", "http://ÄB.net/", "http://example.com/de/\nmore", "http://n" + "/a" * 3000 + ".net/", "http://net/", "http://q.net#/en/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r[0]: tuple(r[1:]) for r in url_verdicts(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert url_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_verdicts(pages.union(pages), rules).count() == 2 * len(URLS)


def test_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_verdicts(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
