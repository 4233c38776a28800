import random

from catalog_fusion.llm.url_sweep import judge_urls, prefix_sweep


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def expected(url, rules):
    host, path = split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h is not None and p is not None and ("." + host).endswith("." + h) and path.startswith(p) and host]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in judge_urls(pages.repartition(5), table).collect())
    assert got == sorted((i, *expected(u, rules)) for i, u in enumerate(urls))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_edges(spark):
    urls = [
        None, "", "example.com/en/", "http://", "http:///en/", "https://WWW.Example.COM/en/x?y#z", "https://m.example.com/en/",
        "https://example.com/EN/", "https://example.com", "https://example.com?x=/en/", "https://myexample.com/en/a", "ftp://a.net/es/1#q",
        "http://net/fr/", "http://a.b.c.net/fr", "http://xn.org/fr/", "http://a.com.net/es/", "x://y://z.com/", "http://É.com/", "http://.com/", "http://com./",
        "http://example.com/en/" + "a" * 20_000,
    ] + ["https://www.example.com/en/1"] * 50
    check(spark, urls, RULES)


def test_random_nested_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "ab", "a-b", "c"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda: "/" + "".join(rng.choice(["x", "/", "xy"]) for _ in range(rng.randint(0, 4)))
    rules = {(host(3), rng.choice([path(), path(), ""])): rng.choice(["allow", "block"]) for _ in range(80)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [(None, "/", "block"), ("a", None, "block")]
    check(spark, [f"http://{host(5)}{path()}" for _ in range(600)], rules)


def test_no_rules_no_pages(spark):
    check(spark, ["http://a.com/"], [])
    check(spark, [], RULES)


def test_sweep_carries_the_stack_between_tasks(spark):
    keys = [f"a{i:04d}" for i in range(400)] + ["b", "a"]
    rules = ["a", "a0", "a01", "a0150", "c"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frames = [spark.createDataFrame([(k,) for k in x], "key string") for x in (keys, rules)]
        got = {r["key"]: r["open"] for r in prefix_sweep(*frames).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: [r for r in rules if k.startswith(r)] for k in keys}
