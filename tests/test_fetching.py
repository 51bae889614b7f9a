"""The fetch chain on cases by hand."""

from corpusloom.operators import fetching, ops

GOOD = "<title>t</title><body><main>" + "some good words here " * 30 + "</main>"
SHELL = "<title>t</title><body><div id='root'></div>"


def test_chain(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    static = table([("https://a.com/good", GOOD, 200), ("https://a.com/shell", SHELL, 200), ("https://a.com/alone", SHELL, 200), ("https://a.com/slow", SHELL, 200), ("https://b.com/app", GOOD, 200), ("https://b.com/plain", GOOD, 200), ("https://c.com/null", None, 204)], "url string, html string, status int")
    rendered = table([("https://a.com/shell", "full", 200, None), ("https://a.com/slow", None, None, "TIMEOUT"), ("https://b.com/app", "app", 201, None), ("https://b.com/slow", None, None, "TIMEOUT"), ("https://a.com/old", "x", 200, None)], "url string, html string, status int, error string")
    cache = table([("https://a.com/old", "kept", 200, None), ("https://b.com/old", "kept b", 203, "browser")], "url string, html string, status int, via string")
    policies = table([("b.com", "browser"), ("c.com", "static")], "host string, strategy string")
    urls = ["https://a.com/good", "https://a.com/shell", "https://a.com/alone", "https://a.com/slow", "https://a.com/old", "https://b.com/app", "https://b.com/plain", "https://b.com/slow", "https://b.com/old", "https://c.com/null", "https://c.com/gone", "https://a.com/shell", "https://a.com/slow", None]
    requests = table([(u, i) for i, u in enumerate(urls)], "url string, ord long")
    out = fetching.fetched(requests, static, rendered, cache, policies)
    rows = {r.ord: r for r in out.collect()}
    got = {i: (r.cache_hit, r.initial_strategy, r.final_strategy, r.route_reason, r.outcome, r.retry_reason, r.retry_count, r.shell, r.status) for i, r in rows.items()}
    app = "js_app_shell_detected"
    assert got == {
        0: (False, "static", "static", "default", "success_static", None, 0, False, 200), 1: (False, "static", "browser", "default", "success_retry", app, 1, True, 200),
        2: (False, "static", "static", "default", "failed_browser", app, 1, True, 200), 3: (False, "static", None, "default", "failed", None, 0, False, None),
        4: (True, "static", "static", "cached", "success_static", None, 0, False, 200), 5: (False, "browser", "browser", "host_policy", "success_browser", None, 0, False, 201),
        6: (False, "browser", "static", "host_policy", "success_static", None, 0, False, 200), 7: (False, "browser", None, "host_policy", "failed", None, 0, False, None),
        8: (True, "browser", "browser", "cached", "success_static", None, 0, False, 203), 9: (False, "static", "static", "host_policy", "success_static", None, 0, False, 204),
        10: (False, "static", None, "host_policy", "failed", None, 0, False, None), 11: (True, "browser", "browser", "cached", "success_static", None, 0, False, 200),
        12: (False, "static", None, "default", "failed", None, 0, False, None), 13: (False, "static", None, "default", "failed", None, 0, False, None)}
    assert rows[6].fallback_used and not rows[0].fallback_used and rows[1].html == rows[11].html == "full"
    told = fetching.outcomes(out)
    assert sorted(r.ord for r in told.collect()) == [0, 1, 2, 5, 6, 9]
    assert {r.host: r.attempts for r in ops.host_policy(told).collect()} == {"a.com": 3, "b.com": 2, "c.com": 1}
    after = {r.url: r.via for r in fetching.cached(out, cache).collect()}
    assert len(after) == 8 and after["https://a.com/shell"] == "browser" and after["https://b.com/old"] == "browser"
    empty = fetching.fetched(requests.limit(0), static, rendered, cache, policies)
    assert empty.count() == 0
