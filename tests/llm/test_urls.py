from sedra.llm import urls
from sedra.llm.urls import Rule


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
    return host, path, best and best.name, best.verdict if best else default


RULES = (*urls.RULES, Rule("a.net", "/", "allow"), Rule("b.a.net", "/x", "block"), Rule("a-b.net", "/", "allow"), Rule("com", "/", "block"), Rule("zz", "", "block"), Rule("b.a.net", "/", "allow"))
URLS = [
    None, "", "no scheme", "http://", "://", "http://net", "http://net/", "http://NET/a", "http://x.net/?q", "https://A.B.net/x/y?z#f", "ftp://b.a.net/xyz", "http://q.b.a.net/x",
    "http://b.a.net/y", "http://a-b.net/1", "http://xa.net/en/", "http://www.example.net/en/1#t", "http://example.net/EN/", "http://example.com/de/", "http://m.example.com/fr/", "http://example.org/fr/9",
    "http://a.zz", "http://zz?x", "http://zza/", "http://netx/", "http://net.example/", "http://a..net/", "http://.net/", "x://y://z.net/", "http://u@h.net:80/p", "http://example.com#://x.net/",
]


def test_sweep_equals_brute_force(spark):
    rows = [(i, u, "", u) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    for rules in (urls.RULES, RULES):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules=rules).collect()}
        assert len(got) == len(rows)
        for i, u, _, _ in rows:
            assert got[i] == brute(u, rules), u


def test_empty_and_repeated_rows(spark):
    schema = "page_id long, url string, html string"
    assert urls.judge_urls(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(None, "http://a.net/", "")] * 3, schema)
    assert [r.verdict for r in urls.judge_urls(same).collect()] == ["block"] * 3
    assert [r.verdict for r in urls.judge_urls(same, rules=()).collect()] == ["allow"] * 3
