"""URL filters against every rule on every URL."""

import random
import re

import pytest

from pactlake.llm import url_filters as uf

HOSTS = [("allow", "org", "/"), ("block", "Example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "net", "")]
PATTERNS = [("block", r"[?&]page=\d"), ("block", r"/tag/"), ("allow", r"/tag/news/"), ("block", r"^https?://ads?\."), ("block", "xx"), ("allow", r"(?:/|^)wiki\b")]
URLS = [
    None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://A.EXAMPLE.ORG/es/1", "http://example.org/en/12", "http://example.org/EN/1", "http://notexample.org/es/", "http://u@example.org:80/es/",
    "http://x.net/http://example.org/es/", "a://b.c://example.com/fr/x", "https://ads.shop.io/?page=2", "https://shop.io/tag/news/1", "https://shop.io/tags/", "ftp://shop.io/axxb", "shop.io/wiki", "https://m.com?x=/fr/", "http://com/fr/é",
    "http://example.org/es\n/x", "https://exa\nmple.com/de/", "http://xxx.io/" + "y" * 50_000,
]


def brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c in uf.UPPER else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), h.lower() + p, v) for v, h, p in HOSTS if m and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    if fits:
        _, name, verdict = max(fits)
        return host, path, name, None, verdict
    seen = url or ""
    if m:
        seen = url[: m.start(1)] + host + url[m.end(1) :]
    hits = sorted((-len(p), p, v) for v, p in PATTERNS if re.search(p, seen, re.ASCII | re.DOTALL))
    return host, path, None, hits[0][1] if hits else None, hits[0][2] if hits else "allow"


@pytest.mark.parametrize("slice_bytes", [uf.SLICE_BYTES, 40])
def test_every_rule_on_every_url(spark, slice_bytes):
    rng = random.Random(2)
    parts = ["http://", "https://", "example", "a.", "www.", "org", "com", "net", "/", "/es/", "/en/1", "/fr/", "/de/", "?page=3", "&page=x", "#top", "/tag/", "news/", "wiki", "xx", "ads.", "é"]
    urls = URLS + ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(400)]
    rules = [uf.host_rule(*r) for r in HOSTS] + [uf.pattern_rule(*r) for r in PATTERNS]
    pages = spark.createDataFrame([(i // 2, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, `_state` string")
    found = uf.filter_urls(pages, rules, slice_bytes=slice_bytes)
    assert found.columns == ["page_id", "url", "host", "_state", "_host", "path", "rule", "pattern", "verdict"]
    got = sorted(map(str, [(r.page_id, r.url, r.host, r["_host"], r.path, r.rule, r.pattern, r.verdict) for r in found.collect()]))
    assert got == sorted(map(str, [(i // 2, u, "h", *brute(u)) for i, u in enumerate(urls)]))


def test_sure_tokens():
    assert uf.sure_tokens(uf.host_rule("block", "example.org", "/es/x1").pattern) == ["es", "example", "org"]
    assert uf.sure_tokens(r"/(tag|category)/") == []
    assert uf.sure_tokens(r"[?&]page=\d") == ["page"]
    assert uf.sure_tokens(r"/(?:a/)?wiki(?:/b)?/") == ["wiki"]
    assert uf.sure_tokens(r"/(?:a/?)?wiki/") == []
    assert uf.sure_tokens(r"^News[.]html$") == ["html", "news"]
    assert uf.sure_tokens(r"x+/feed/y*") == ["feed"]
    assert uf.sure_tokens("plain") == []


def test_rarest_token_fetches_the_rule(spark):
    pages = spark.createDataFrame([(i, f"http://common.org/common/{'rare/' * (i == 3)}") for i in range(9)], "page_id long, url string")
    rule = uf.pattern_rule("block", "/common/rare/")
    counts = uf.token_counts(pages, ["common", "rare"], "url")
    assert counts == {"common": 9, "rare": 1}
    index = uf.Index([rule], counts)
    assert list(index.filed) == ["rare"] and not list(index.candidates("http://common.org/common/")) and index.best("http://x/common/rare/")[1] == rule


def test_empty_table_no_rules_and_equal_names(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert uf.filter_urls(empty, [uf.pattern_rule("block", "/a/")]).count() == 0
    assert [r.verdict for r in uf.filter_urls(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), []).collect()] == ["allow"]
    with pytest.raises(ValueError):
        uf.filter_urls(empty, [uf.pattern_rule("block", "/a/"), uf.pattern_rule("allow", "/a/")])
