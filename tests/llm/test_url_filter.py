from sparkpact.llm import url_filter as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([k for c in "?#" if (k := path.find(c)) >= 0], default=len(path))]
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.www.example.com/en/?q#f", "http://shop.net/es/a/b", "http://net/es", "http://net/es/", "http://example.com?x=/en/", "ftp://x.org:80/a",
        "http://a.b.c.d.e.f.com/1/2/3/4", "http://notexample.com/en/", "http://com", "http://" + "a." * 3000 + "com/" + "d/" * 3000, "http://x.com//", "http://É.com/é/", "http://x.com/enx/y", "HTTP://EXAMPLE.COM/en/"]


def test_against_brute_force(spark):
    rules = [*U.RULES, ("x.com", "/en", "block"), ("x.com", "", "block"), ("x.com", "/en", "allow"), ("d.e.f.com", "/1/2", "block")]
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    r = spark.createDataFrame([*rules, (None, "/", "block"), ("q.com", None, "block")], "host string, path string, action string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in U.judge_urls(df, r).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(URLS * 2)}


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([*enumerate(URLS)], "page_id long, url string")
    r = spark.createDataFrame(U.RULES, "host string, path string, action string")
    want = {tuple(x) for x in U.judge_urls(df, r).collect()}
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert {tuple(x) for x in U.judge_urls(df, r).collect()} == want


def test_empty_tables(spark):
    r = spark.createDataFrame(U.RULES, "host string, path string, action string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(none, r).count() == 0
    assert [tuple(x) for x in U.judge_urls(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), r.limit(0)).collect()] == [(1, "a", "/b", None, "allow")]


def test_plan_has_no_python(spark):
    r = spark.createDataFrame(U.RULES, "host string, path string, action string")
    plan = U.judge_urls(spark.createDataFrame([*enumerate(URLS)], "page_id long, url string"), r)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
