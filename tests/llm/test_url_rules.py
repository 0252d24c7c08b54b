import random

import pytest

from rayloom.llm import url_rules as ur
from rayloom.llm.queries import RULES


def slow(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not host and not path:
        fits = []
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.host + r.path, r.verdict), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://example.com/", "https://a.example.com/en/1?x=/fr/", "http://www.example.com/en/",
    "http://www.example.com/EN/", "http://xexample.com/en/", "http://x.www.example.com/en/a#b", "ftp://a.net/es/1", "http://net/fr/", "http://anet/fr/x",
    "http://a.net?/es/", "http://a.net/es", "http://user@b.net/fr/", "://q.net/fr/?", "http://é.com/ü", "http://a.com:80/x", "http://a.com/\n/x", "x" * 5000 + "://b.com/" + "y/" * 9000,
]


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    out = ur.judge_urls(df, rules).select("row.page_id", "host", "path", "rule", "verdict")
    return [tuple(r)[1:] for r in sorted(out.collect(), key=lambda r: r.page_id)]


def test_contract_rules(spark):
    urls = URLS + URLS
    assert judged(spark, urls, RULES) == [slow(u, RULES) for u in urls]


def test_random_rules(spark):
    rng = random.Random(4)
    part = lambda: rng.choice(["a", "b", "cd", "e-f", "g+"])
    rules = [ur.Rule(".".join(part() for _ in range(rng.randint(1, 3))), rng.choice(["", "/", "/a/", "/a/b", "/b/a/", "/c.d"]), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = ["http://" + ".".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/a/", "/a/b/c", "/b/a/x", "/c.d/", "/cxd"]) for _ in range(400)]
    assert judged(spark, urls, rules) == [slow(u, rules) for u in urls]


@pytest.mark.parametrize("rules", [[], RULES])
def test_no_rows_and_no_rules(spark, rules):
    assert judged(spark, [], rules) == []
    assert judged(spark, ["http://a.com/"], []) == [("a.com", "/", None, "allow")]


def test_rarest_token(spark):
    urls = spark.createDataFrame([("a.com", "/en/")] * 5 + [("b.com", "/fr/")], "host string, path string")
    index = {r.rule: r.token for r in ur.rule_index(urls, [ur.Rule("a.com", "/en/", "block"), ur.Rule("com", "/fr/", "allow")]).collect()}
    assert index == {"a.com/en/": "h:a", "com/fr/": "p:fr"}
