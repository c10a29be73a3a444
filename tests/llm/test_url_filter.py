"""The trie against a scan of all rules."""

import random

from kindred.llm import url_filter as U
from kindred.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3 :]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (h.count("."), len(p) + len(slash), verdict == "block")
            best = max(best, (key, rule, verdict)) if best else (key, rule, verdict)
    return (host, path, best[1] if best else None, best[2] if best else default)


URLS = [
    None, "", "no scheme", "http://", "https://a.net", "https://a.net/", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.net/en", "http://example.netx/en/",
    "x://example.com/de/", "http://example.com/de", "http://m.example.com/DE/", "https://z.org/fr/1", "https://org/fr/", "http://a.org?/fr/", "http://a.org#://b.net/",
    "http://É.NET/ä", "http://example.net:80/en/", "http://.net/", "a://b://c.net/", "http://net/\nline", "http://" + "a." * 5000 + "net/x", "http://net//fr/",
]


def test_contract_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, "http://")]
    df = spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id long, url string, verdict string")
    got = sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in U.filter_urls(df, URL_RULES).collect())
    want = sorted((i, *(str(x) if k == 2 else x for k, x in enumerate(brute(u, URL_RULES)))) for i, u in rows)
    assert got == want


def test_random_rules():
    rng = random.Random(4)
    part = lambda: rng.choice(["a", "b", "ab", "net"])
    for _ in range(300):
        rules = list({
            (rng.choice(["allow", "block"]), ".".join(part() for _ in range(rng.randint(1, 3))) + rng.choice(["", "/", "/a", "/a/", "/ab", "/a/b/", "/a/b/a"]))
            for _ in range(8)
        })
        trie = U.build_trie(rules)
        for _ in range(40):
            url = "h://" + ".".join(part() for _ in range(rng.randint(1, 4))) + "".join(rng.choice(["/", "/a", "/ab", "/b"]) for _ in range(rng.randint(0, 4)))
            host, path = U.split_url(url)
            got = trie.longest(host, path) or (None, "allow")
            assert (host, path, *got) == brute(url, rules), (url, rules)


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df, URL_RULES).collect() == []
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.filter_urls(some, []).collect()] == [(None, "allow")]
