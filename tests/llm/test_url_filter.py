from pyspark.sql import functions as F

from tidemark.llm import registry
from tidemark.llm import url_filter as u


def lists(spark):
    return u.rule_table(spark, registry.URL_RULES), u.host_table(spark, [f"{n}.{e}" for e in registry.LISTED_ENDS for n in registry.LISTED_NAMES])


def test_rules_and_odd_urls(spark):
    cases = [
        (1, "http://a.b.com/x", ("a.b.com", "/x", "com/", "allow")),
        (2, "http://EXAMPLE.com/en/1?q", ("example.com", "/en/1", "example.com/en/", "block")),
        (3, "https://www.example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
        (4, "http://xexample.com/en/", ("xexample.com", "/en/", "com/", "allow")),
        (5, "http://a.net/es/1#f", ("a.net", "/es/1", "net/es/", "block")),
        (6, "http://a.net/de/", ("a.net", "/de/", None, "allow")),
        (7, "http://b.free-bets.example.org/de/", ("b.free-bets.example.org", "/de/", None, "block")),
        (8, None, ("", "", None, "allow")), (9, "no scheme.com/", ("", "", None, "allow")), (10, "", ("", "", None, "allow")),
        (11, "http://a.com?x=/", ("a.com", "", None, "allow")), (12, "x://y://z.com/", ("y:", "//z.com/", None, "allow")),
    ]
    df = spark.createDataFrame([(i, x, "z") for i, x, _ in cases], "page_id long, url string, host string")
    rules, hosts = lists(spark)
    for bits in (u.MOST_BITS, 0):  # by filters, and by joins
        got = {r["page_id"]: tuple(r)[1:] for r in u.filter_urls(df, rules, hosts, most_bits=bits).collect()}
        assert got == {i: want for i, _, want in cases}
        assert u.filter_urls(df.where("false"), rules, hosts, most_bits=bits).count() == 0
        assert {r["rule"] for r in u.filter_urls(df, rules.where("false"), hosts.where("false"), most_bits=bits).collect()} == {None}
    twice = df.unionByName(df)
    assert u.filter_urls(twice, rules.unionByName(rules).unionByName(spark.createDataFrame([(None, "/", "block"), ("com", None, "allow")], rules.schema)), hosts.unionByName(hosts)).count() == 24


def test_rules_equal_brute_force(spark):
    import random

    rnd = random.Random(1)
    part = lambda: rnd.choice(["a", "b", "c", "com", "org"])
    host = lambda: ".".join(part() for _ in range(rnd.randint(1, 4)))
    path = lambda: "/" + "/".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 3)))
    rules = list({(host(), path()): None for _ in range(60)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    listed = list({host() for _ in range(25)})
    urls = [(i, f"http://{host()}{path()}") for i in range(500)]
    got = u.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), u.rule_table(spark, rules), u.host_table(spark, listed)).collect()
    under = lambda h, r: h == r or h.endswith("." + r)
    for r in got:
        fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if under(r["host"], h) and r["path"].startswith(p)]
        want = max(fit)[2:] if fit else (None, "block" if any(under(r["host"], x) for x in listed) else "allow")
        assert (r["rule"], r["verdict"]) == want


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = spark.range(0, 4000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    c = u.Cascade.build(listed, universe)
    assert len(c.levels) > 2
    got = {r["key"] for r in universe.where(c.holds(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 4000, 3)}
