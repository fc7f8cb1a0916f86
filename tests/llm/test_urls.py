"""URL filters against a plain loop over all rules, with odd rows."""

import re

from tidewise.llm import queries, urls

URLS = [
    "http://a.org/x", "HTTP://EN.Example.ORG/es/q?u=1", "http://example.org/en/10#f", "https://notexample.org/es/", "x://com/fr/", "x://a.b.com/de/y",
    "x://a.com/DE/", "x://org", "x://org?/", "x:///path", "x://", "://com/de/", "no scheme", "", None, "x://com/fr/://org/", "x://org./", "x://.org/", "x://com:80/fr/",
    "x://" + ".".join("a" * 3 for _ in range(60)) + ".com/de/" + "p" * 100_000,
]


def expected(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_against_all_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y"), (None, URLS[5], "x", "y"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _row string")
    rules = [*queries.URL_RULES, ("com", "/fr/", "block"), ("b.com", "/", "allow")]
    odd = [*rules, (None, "/", "block"), ("org", None, "block"), ("org", "/x", None)]
    got = urls.judge(pages, spark.createDataFrame(odd, urls.RULE_SCHEMA)).collect()
    want = [(i, *expected(u, rules)) for i, u, _, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "x://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], urls.RULE_SCHEMA)
    assert [tuple(r) for r in urls.judge(pages, none, default="block").collect()] == [(1, "a.org", "/", None, "block")]
    rules = spark.createDataFrame(list(queries.URL_RULES), urls.RULE_SCHEMA)
    assert urls.judge(pages.limit(0), rules).collect() == []
