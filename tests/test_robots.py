"""Robots tables against the standard library parser."""

import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pagetab.operators.robots import (
    crawl_delays, delay_gate, effective_rules, path_rules, robots_gate, robots_groups, robots_verdicts,
)

AGENT = "pagetab/0.1"


def test_random_files_agree_with_standard_parser(spark):
    rnd = random.Random(3)
    agents = ["*", "pagetab", "PageTab", "page", "other", "", "tab/2"]
    paths = ["", "/", "/a", "/a/b", "/%61", "/a+b", "/a%2fb", "/x%zz", "/ü", "/%C3%BC", "*", "/a?b", "/a?", "/b;", "/c#d"]
    lines = (
        [lambda: "User-agent: " + rnd.choice(agents)] * 4
        + [lambda: rnd.choice(["Disallow", "Allow", "disallow "]) + ":" + rnd.choice(["", " "]) + rnd.choice(paths)] * 5
        + [lambda: "Crawl-delay: " + rnd.choice(["1", "70", "x", "007", "1.5"]), lambda: "", lambda: "  ", lambda: "# note",
           lambda: "Sitemap: /s", lambda: "nonsense", lambda: "Request-rate: 1/5", lambda: "Disallow: /a # why"]
    )
    files = ["\n".join(rnd.choice(lines)() for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    probes = ["https://e.com/", "https://e.com/a", "https://e.com/a/b?x=1", "https://e.com/a%2Fb", "https://e.com/ü",
              "https://e.com/a+b", "https://e.com/b;p", "https://e.com/x%zz", "https://e.com/a?b", "https://e.com//a"]
    bodies = spark.createDataFrame([(str(i), f) for i, f in enumerate(files)], "crawl_id string, body string")
    urls = bodies.select("crawl_id", F.explode(F.array(*map(F.lit, probes))).alias("url"))
    effective = effective_rules(robots_groups(bodies), AGENT)
    got = {(r.crawl_id, r.url): r.allowed for r in robots_verdicts(urls, path_rules(effective)).collect()}
    delays = {r.crawl_id: r.robots_delay for r in crawl_delays(effective).collect()}
    wrong = []
    for i, text in enumerate(files):
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        wrong += [(text, u) for u in probes if parser.can_fetch(AGENT, u) != got[(str(i), u)]]
        if parser.crawl_delay(AGENT) != delays.get(str(i)):
            wrong.append((text, "delay", delays.get(str(i))))
    assert wrong == []


def test_gate(spark):
    text, html = "text/plain", "text/html; charset=utf-8"
    robots = [(n, s, t, e, "User-agent: *\n", x) for n, s, t, e, x in [
        ("ok", 200, text, None, None), ("gone", 404, html, None, None), ("401", 401, text, None, None),
        ("403", 403, text, None, None), ("302", 302, text, None, None), ("503", 503, text, None, None),
        ("login", 200, html, None, None), ("coded", 200, text, "unknown", None), ("net", None, None, None, "TimeoutError"),
        ("json", 200, "application/json", None, None)]]
    table = spark.createDataFrame(
        robots, "crawl_id string, http_status int, content_type string, content_encoding string, body string, error_type string")
    crawls = spark.createDataFrame([(r[0], "https://e.com", 2000) for r in robots] + [("none", "https://e.com", 2000)],
                                   "crawl_id string, allowed_origin string, max_body_bytes int")
    rows = {r.crawl_id: r for r in robots_gate(crawls, table).collect()}
    assert {k: r.robots_status for k, r in rows.items()} == {
        "ok": "loaded", "gone": "missing_404", "json": "loaded",
        **dict.fromkeys(["401", "403", "302", "503", "login", "coded", "net", "none"], "unavailable")}
    assert {k: r.robots_error for k, r in rows.items() if r.robots_error} == {
        "coded": "IgnoreRequest", "net": "TimeoutError", "none": "NotCaptured"}
    assert rows["ok"].robots_body and rows["401"].robots_body is None and rows["403"].robots_http_status == 403


def test_delay(spark):
    rows = spark.createDataFrame([(0.5, None), (0.5, 1), (2.0, 1), (0.5, 60), (0.5, 61)], "d double, r bigint")
    assert [r[0] for r in rows.select(delay_gate(F.col("d"), F.col("r"))).collect()] == [0.5, 1.0, 2.0, 60.0, None]


def test_verdicts_keep_rows_that_repeat(spark):
    urls = spark.createDataFrame([("c", "https://e.com/a", 1)] * 3 + [("c", "https://e.com/b", 1), ("d", "https://e.com/a", 2)], "crawl_id string, url string, n int")
    long = "/" + "a" * 5000
    prefixes = spark.createDataFrame([("c", "/a", 1, False), ("c", long, 2, False)], "crawl_id string, prefix string, seq int, allow boolean")
    got = robots_verdicts(urls, prefixes)
    assert sorted((r.crawl_id, r.url[-1], r.n, r.allowed) for r in got.collect()) == [("c", "a", 1, False)] * 3 + [("c", "b", 1, True), ("d", "a", 2, True)]
    kept = path_rules(spark.createDataFrame([("c", 0, 1, "disallow", long)], "crawl_id string, grp int, seq int, directive string, value string"))
    assert kept.first().prefix == long


def test_one_file_of_many_agents_and_rules(spark):
    """Agents and rules of one group are never paired: a file of a megabyte takes seconds."""
    n = 20_000
    text = "".join(f"User-agent: bot{i}\n" for i in range(n)) + "User-agent: *\n" + "".join(f"Disallow: /p{i}\n" for i in range(n))
    groups = robots_groups(spark.createDataFrame([("c", text)], "crawl_id string, body string"))
    assert effective_rules(groups, AGENT).count() == n


@pytest.mark.parametrize("together", [5, 100_000])
def test_verdicts_of_random_rules(spark, together):
    """Nested, equal, empty and unmatched prefixes against a plain search, with crawls in parts and whole."""
    rnd = random.Random(4)
    word = lambda n: "/" + "".join(rnd.choice("ab") for _ in range(rnd.randrange(n)))
    rules = {(c, p): (i, rnd.random() < .4) for c in "xyz" for i, p in enumerate({word(9) for _ in range(40)} | {"", "/é", "/a" * 50})}
    urls = [(c, f"https://e.com{word(14)}") for c in "xyzw" for _ in range(120)] + [("x", "https://e.com/é/b"), ("x", "https://e.com")]
    prefixes = spark.createDataFrame([(c, p, i, a) for (c, p), (i, a) in rules.items()], "crawl_id string, prefix string, seq int, allow boolean")
    got = robots_verdicts(spark.createDataFrame(urls, "crawl_id string, url string"), prefixes, together=together).collect()
    assert len(got) == len(urls)
    for r in got:
        path = r.url.removeprefix("https://e.com") or "/"
        first = min((v for (c, p), v in rules.items() if c == r.crawl_id and path.startswith(p)), default=(0, True))
        assert r.allowed == first[1], r


def test_a_file_of_many_lengths_costs_rows_by_urls(spark):
    """4,000 rules of as many lengths: a row for each URL and rule, not for each URL and length."""
    rules = spark.range(1, 4001).selectExpr("'c' AS crawl_id", "concat('/', repeat('a', CAST(id AS int))) AS prefix", "CAST(id AS int) AS seq", "id % 2 = 0 AS allow")
    urls = spark.range(2000).selectExpr("'c' AS crawl_id", "concat('https://e.com/', repeat('a', CAST(id + 1 AS int)), 'b', id) AS url")
    assert robots_verdicts(urls, rules).where("NOT allowed").count() == 2000
    later = rules.withColumn("seq", 5000 - F.col("seq"))  # the longest rule comes first
    found = robots_verdicts(urls, later).withColumn("n", F.length(F.regexp_extract("url", "/(a+)b", 1)))
    assert found.where("allowed != (n % 2 = 0)").count() == 0
