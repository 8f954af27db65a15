import re

from cohortlens.llm import url_filter as U

URLS = ["http://Example.COM/en/1", "https://www.example.com/en/x?q", "ftp://a.b.example.com/en/", "http://example.com", "http://com/",
        "http://notexample.com/en/1", "http://x.net/es/1#f", "http://x.net/ES/1", "http://net/fr/", "http://xnet/fr/", "http://q.org/x.com/",
        "no scheme", "", None, "a://b://c/d", "http://ads.org/ads/x", "http://spam-farm.org/x", "http://h.org/spam/x", "x://h.org/a.exe",
        "http://é.net/fr/ü", "http://x.com?/y", "http://x.org/" + "a/" * 40_000, "://x.com/", "http://u@x.com:80/", "http://x.com/\nen"]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    bad = re.search(r"(?s)^[^/]*spam[^/]*/.*$|/ads/|/tracker/|\.exe$", host + path)
    return (host, path, best[0] if best else None, best[1] if best else "block" if bad else "allow")


def test_against_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string")
    got = U.judge(rows.selectExpr("*", "'x' as host", "'y' as verdict")).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]])


def test_globs_over_many_words():
    globs = [f"host{i}.*/p{i}/**" for i in range(40)] + ["**", "*", "a**c*", "**end"]
    texts = [b"host3.com/p3/x/y", b"host3.co/m/p3/", b"", b"a/b/c", b"a/b/c/", b"the/end", b"abcabc"]
    want = [[bool(re.fullmatch(re.escape(g).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/]*"), t.decode())) for g in globs] for t in texts]
    assert U.Globs(globs).match(texts).tolist() == want


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_long_url(spark):
    from cohortlens.llm.url_filter import judge
    path = "/" + "a/" * 20_000
    rows = [(1, "http://x.org" + path), (2, "http://x.org" + path + "ads/" + "b" * 20_000)]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1]["path"] == path and got[1]["verdict"] == "allow" and got[2]["verdict"] == "block"
