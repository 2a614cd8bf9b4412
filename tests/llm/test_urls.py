import random

from pyspark.sql import functions as F

from fieldspark.llm import urls


def slow(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or (len(rule), verdict == "block") > (len(best[1]), best[0] == "block"):
                best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


def fixture():
    rng = random.Random(8)
    hosts = ["org", "example.org", "EXAMPLE.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "www.x.com", "com.org", "é.org", "example.org.", "", "a,b.org", "org:80", "net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a#b", "/de/", "?q://x", "#f", "/fr//de/", "/ES/"]
    pages = [(k, rng.choice(["http://", "https://", "", "x:// "]) + rng.choice(hosts) + rng.choice(paths)) for k in range(400)]
    return pages + [(None, "http://example.org/es/1"), (7, None), (8, ""), (9, "://"), (1, pages[1][1])] + [(500 + k, "http://hot.example.org/en/1") for k in range(200)]


def test_every_url_equals_brute_force(spark):
    pages = fixture()
    rules = urls.RULES + [("block", "a.example.org/"), ("block", "org/"), ("allow", "b.a.example.org/e"), ("allow", "x/"), ("block", "example.org/es/1")]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).repartition(4)
    for ranges in (1, 7):
        out = urls.judge(frame, urls.rule_table(spark, rules), ranges=ranges).collect()
        assert sorted(map(tuple, out), key=str) == sorted(((k, *slow(u, rules)) for k, u in pages), key=str)


def test_empty_tables(spark):
    rules = urls.rule_table(spark, urls.RULES)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge(one, rules.filter("false")).first().verdict == "allow"
