import random

from pocketlens.llm import url_rules


def brute(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if ("." + host).endswith("." + r[0]) or r[0] == ""]
    fits = [r for r in fits if path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r[0].split(".")) if r[0] else 0, len(r[1])))
    return host, path, best[0] + best[1], best[2]


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS key")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages.repartition(3), table).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "ample.com", "m.www.example.com", "net", "a.net", "b.a.net", "A.Net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/é/ü", "/en/x/y"]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=://b', '#c'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "x://?q", "http://h.com", "://a.com/x://net/"] + ["http://hot.example.com/en/x"] * 300
    rules = list({(rng.choice(hosts[:-1]), rng.choice(paths)): None for _ in range(25)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    got = judged(spark, urls, rules)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_tables_and_null_rules(spark):
    assert judged(spark, [], [("com", "/", "block")]) == {}
    assert judged(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
    assert judged(spark, ["http://a.com/x"], [(None, "/x", "block")]) == {0: ("a.com", "/x", "/x", "block")}
    same = [("com", None, "block"), ("com", "", "allow")]
    assert judged(spark, ["http://a.com"], same) == {0: ("a.com", "", "com", "allow")}


def test_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.com/")] * 2, "page_id bigint, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert [r.verdict for r in url_rules.judge_urls(pages, rules).collect()] == ["block"] * 2
