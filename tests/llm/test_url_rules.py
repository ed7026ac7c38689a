import pytest

from threadtox.llm import url_rules as ur

PAGES = "page_id long, url string, html string"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "")]
URLS = ["http://example.com/en/x", "https://www.example.com/en/", "https://A.www.EXAMPLE.com/en/?q", "http://myexample.com/en/x", "http://x.net/es/",
        "http://x.net", "http://net/es", "ftp://example.org/en/", "no scheme", "", None, "://", "http:///path", "http://com", "http://com/", "x://b.com?/en/",
        "http://a.net#/es/", "http://example.com:80/en/", "http://É.example.com/en/ü", "http://x.com/http://y.net/es/"]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else default


def test_rules(spark):
    rows = [(i if i % 5 else None, u, None, "h", 1) for i, u in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, PAGES + ", host string, verdict int")
    got = ur.judge_urls(df, RULES).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(r[1], RULES) for r in rows]
    assert [r.page_id for r in got] == [r[0] for r in rows]
    assert {r.verdict for r in ur.judge_urls(df, [], default="block").collect()} == {"block"}
    assert ur.judge_urls(spark.createDataFrame([], PAGES), RULES).count() == 0


def test_equal_digests_are_told_apart(tmp_path):
    same = lambda s: 7
    rules = [("block", f"h{i}.com", "/") for i in range(50)]
    file = tmp_path / "rules"
    file.write_bytes(ur.digest_file(rules, same))
    got = ur.DigestArray(str(file), same).judge([("h3.com", "/x"), ("h99.com", "/x"), ("a.h49.com", "/")])
    assert got == [("h3.com/", "block"), (None, None), ("h49.com/", "block")]


def test_many_rules_against_brute_force(tmp_path):
    rules = [("block" if i % 3 else "allow", f"s{i % 40}.d{i % 17}.org", f"/p{i % 5}/" if i % 2 else "/") for i in range(400)]
    last = {(h, p): a for a, h, p in rules}
    file = tmp_path / "rules"
    file.write_bytes(ur.digest_file(rules))
    array = ur.DigestArray(str(file))
    assert (array.keys[1:] >= array.keys[:-1]).all()
    urls = [f"http://x.s{i % 45}.d{i % 19}.org/p{i % 7}/y" for i in range(900)]
    kept = [(a, h, p) for (h, p), a in last.items()]
    assert [array.judge([ur.split_url(u)])[0] for u in urls] == [(w[2], w[3] if w[2] else None) for w in (brute(u, kept) for u in urls)]


def test_bad_rules(spark):
    with pytest.raises(ValueError):
        ur.digest_file([("deny", "a", "/")])
    with pytest.raises(ValueError):
        ur.judge_urls(spark.createDataFrame([], PAGES), RULES, max_rules=2)
