"""Policy validation and host classes."""

import ipaddress
import math
import random

from pagetab.operators.policies import GLOBAL_V6_EXCEPTIONS, NOT_GLOBAL_V6, host_class, refused, usable, validate, with_defaults
from pagetab.sources import schemas


def errors(spark, **change):
    row = dict.fromkeys([c.split()[0] for c in schemas.POLICIES.split(", ")])
    row.update({"crawl_id": "c", "start_url": "https://example.com/", "allowed_origin": "https://example.com", **change})
    df = spark.createDataFrame([tuple(row.values())], schemas.POLICIES)
    return validate(with_defaults(df)).first()


def test_defaults_and_normal_forms(spark):
    row = errors(spark, start_url="HTTPS://Example.com:443/x#f", allowed_origin="https://EXAMPLE.com/")
    assert row.errors == [] and row.start_url == "https://example.com/x" and row.allowed_origin == "https://example.com"
    assert (row.max_pages, row.max_requests, row.max_candidates, row.max_body_bytes, row.max_text_chars) == (20, 25, 500, 2_000_000, 5000)
    assert (row.delay, row.timeout, row.allow_loopback) == (0.5, 10.0, False)


def test_limits(spark):
    cases = [({"max_pages": 0}, "invalid_max_pages"), ({"max_requests": 2001}, "invalid_max_requests"),
             ({"max_candidates": 10001}, "invalid_max_candidates"), ({"max_body_bytes": 10_000_001}, "invalid_max_body_bytes"),
             ({"max_text_chars": 100_001}, "invalid_max_text_chars"), ({"delay": math.nan}, "invalid_delay"),
             ({"delay": 60.5}, "invalid_delay"), ({"delay": -1.0}, "invalid_delay"), ({"timeout": math.inf}, "invalid_timeout"),
             ({"timeout": 0.0}, "invalid_timeout"), ({"timeout": math.nan}, "invalid_timeout"),
             ({"start_url": "https://sub.example.com/"}, "start_outside_allowed_origin"),
             ({"allowed_origin": "https://example.com/x"}, "allow_origin_must_not_include_path_query_or_fragment"),
             ({"allowed_origin": "https://example.com/?q"}, "allow_origin_must_not_include_path_query_or_fragment"),
             ({"allowed_origin": "https://example.com#f"}, "allow_origin_must_not_include_path_query_or_fragment")]
    for change, error in cases:
        assert errors(spark, **change).errors == [error], change


def test_hosts(spark):
    for host, flag, want in [("127.0.0.1", None, ["non_public_ip_literal"]), ("127.0.0.1", True, []), ("10.0.0.1", True, ["non_public_ip_literal"]),
                             ("169.254.169.254", None, ["non_public_ip_literal"]), ("8.8.8.8", None, []), ("[::1]", True, []),
                             ("[fe80::1]", True, ["non_public_ip_literal"]), ("[2606:4700::1111]", None, []),
                             ("localhost", None, ["loopback_requires_explicit_flag"]), ("localhost", True, [])]:
        row = errors(spark, start_url=f"http://{host}/", allowed_origin=f"http://{host}", allow_loopback=flag)
        assert row.errors == want, host


def test_split_into_usable_and_refused(spark):
    df = spark.createDataFrame([("a", "https://e.com/", "https://e.com", 5), ("b", "https://e.com/", "https://e.com", 0)],
                               "crawl_id string, start_url string, allowed_origin string, max_pages int")
    checked = validate(with_defaults(df))
    assert [r.crawl_id for r in usable(checked).collect()] == ["a"] and [r.crawl_id for r in refused(checked).collect()] == ["b"]


def test_ipv4_classes_agree_with_library(spark):
    rnd = random.Random(5)
    edges = [int(ipaddress.ip_address(a)) + d for a in ("0.0.0.0", "10.0.0.0", "11.0.0.0", "100.64.0.0", "100.128.0.0", "127.0.0.0", "128.0.0.0",
             "169.254.0.0", "172.16.0.0", "172.32.0.0", "192.0.0.0", "192.0.0.8", "192.0.0.11", "192.0.2.0", "192.168.0.0", "198.18.0.0", "198.20.0.0",
             "198.51.100.0", "203.0.113.0", "224.0.0.0", "240.0.0.0") for d in range(-2, 3)]
    numbers = [n for n in edges + [rnd.randrange(2**32) for _ in range(2000)] if 0 <= n < 2**32]
    hosts = [str(ipaddress.ip_address(n)) for n in numbers] + ["1.2.3", "01.2.3.4", "1.2.3.256", "a.b"]
    df = spark.createDataFrame([(h, f"http://{h}/") for h in hosts], "h string, url string")
    for host, got in df.select("h", host_class("url")).collect():
        try:
            a = ipaddress.ip_address(host)
            want = "global" if a.is_global else "loopback" if a.is_loopback else "not_global"
        except ValueError:
            want = "name"
        assert got == want, host


def test_ipv6_classes_agree_with_library(spark):
    rnd = random.Random(6)
    edges = [int(n[i]) + d for n in map(ipaddress.ip_network, NOT_GLOBAL_V6 + GLOBAL_V6_EXCEPTIONS) for i in (0, -1) for d in range(-2, 3)]
    mapped = [0xFFFF << 32 | int(ipaddress.ip_address(a)) + d for a in ("10.0.0.0", "100.64.0.0", "127.0.0.0", "8.8.8.8", "192.0.0.9", "255.255.255.255") for d in (-1, 0, 1)]
    numbers = [n for n in edges + mapped + [rnd.randrange(2**128) >> rnd.randrange(128) for _ in range(500)] if 0 <= n < 2**128]
    hosts = [f(ipaddress.IPv6Address(n)) for n in numbers for f in (str, lambda a: a.exploded, lambda a: a.compressed.upper())]
    hosts += [f"{':'.join(str(ipaddress.IPv6Address(n)).split(':')[:-2])}:1.2.3.4" for n in numbers[:40]]
    letters = ["", ":", "::", "0", "1", "ab", "ffff", "12345", "1.2.3.4", "1.2.3.256", "01.2.3.4", "%", "%1", "g", "/"]
    hosts += ["".join(rnd.choice([":", ""]) + rnd.choice(letters) for _ in range(rnd.randrange(1, 11))) for _ in range(3000)]
    hosts += [":".join(rnd.choice(["0", "1", "fe80", "", "ABCD", "00ab"]) for _ in range(rnd.randrange(2, 11))) for _ in range(3000)]
    df = spark.createDataFrame([(h, f"http://[{h}]/") for h in set(hosts) if h], "h string, url string")
    seen = set()
    for host, got in df.select("h", host_class("url")).collect():
        try:
            a = ipaddress.IPv6Address(host)
            want = "global" if a.is_global else "loopback" if a.is_loopback else "not_global"
        except ValueError:
            want = "name"
        seen.add(want)
        assert got == want, host
    assert len(seen) == 4
    assert "Python" not in df.select(host_class("url"))._jdf.queryExecution().executedPlan().toString()
