import random

from orrery.llm.queries import URL_RULES
from orrery.llm.url_filter import filter_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = max(((len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [None, "", "nothing", "http://", "https://www.EXAMPLE.com/en/x?q=://a/b#f", "http://example.com", "http://example.com/en", "http://example.com/en/", "ftp://a.b.net/es/1", "x://net/fr/#t", "http://.net/fr/", "http://com/", "http://a..com/x\ny", "http://É.COM/ß", "http://h?x://y.com/en/", "http://" + "a." * 500 + "com/" + "d/" * 3000]
MORE = [("example.com", "/en/page", "allow"), ("example.com", "", "block"), ("b.net", "/es", "allow"), ("com", "/e", "block"), ("com", "/e", "allow")]


def test_against_brute_force(spark):
    rng = random.Random(5)
    urls = URLS + ["{}://{}{}{}/{}{}".format(rng.choice(["http", "https"]), rng.choice(["", "www.", "m.", "WWW."]), rng.choice(["example.com", "b.net", "q.net", "org"]), rng.choice(["", "/en", "/es", "/fr", "/e"]), rng.choice(["", "page1", "x/y"]), rng.choice(["", "?a", "#b"])) for _ in range(300)]
    rows = [(i // 2 if i % 7 else None, u, "r") for i, u in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    for rules in (URL_RULES, URL_RULES + MORE, []):
        want = sorted([(i, *brute(u, rules)) for i, u, _ in rows], key=str)
        table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
        for given in (rules, table) if rules else (table,):
            assert sorted(map(tuple, filter_urls(df, given).collect()), key=str) == want
    assert filter_urls(df.limit(0), URL_RULES).count() == 0


def test_many_rules_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("orrery.llm.url_filter.BROADCAST_RULES", 0)
    df = spark.createDataFrame([(1, "http://www.example.com/en/a"), (2, "http://q.net/de/")], "page_id long, url string")
    assert [tuple(r) for r in filter_urls(df, URL_RULES).orderBy("page_id").collect()] == [(1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "q.net", "/de/", None, "allow")]
