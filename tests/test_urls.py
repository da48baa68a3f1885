"""URL columns against cases worked by hand, properties of normal forms, and the standard join."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagetab.functions.urls import (
    admit, has_sensitive_query, normalize_url, percent_decode, request_url, resolve_url,
)


def evaluate(spark, values, *columns):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)],
                                 "i int, " + ", ".join(f"v{n} string" for n in range(len(values[0]))))
    return [r[1] for r in rows.select("i", *columns).orderBy("i").collect()]


LONGEST = 4096
#: Worked by hand: a URL and its normal form, None where there is none.
STATED = [
    ("HtTp://Docs.Example.NET:80", "http://docs.example.net/"),
    ("https://docs.example.net:443?z=1&y=2#part", "https://docs.example.net/?z=1&y=2"),
    ("https://docs.example.net:80/x", "https://docs.example.net:80/x"),
    ("http://docs.example.net:443/x", "http://docs.example.net:443/x"),
    ("https://docs.example.net:00443/", "https://docs.example.net/"),
    ("https://docs.example.net:/", "https://docs.example.net/"),
    ("https://docs.example.net:70000/", None),
    ("https://docs.example.net:8o/", None),
    ("gopher://docs.example.net/", None),
    ("data:text/plain,x", None),
    ("//docs.example.net/", None),
    ("docs.example.net", None),
    ("https:///no-host", None),
    ("", None),
    ("https://me@docs.example.net/", None),
    ("https://me:too@docs.example.net/", None),
    ("https://docs.example.net/a@b", "https://docs.example.net/a@b"),
    ("https://docs.example.net/up/../down/./", "https://docs.example.net/up/../down/./"),
    ("https://docs.example.net//twice//", "https://docs.example.net//twice//"),
    ("https://docs.example.net/%7Euser;v=1", "https://docs.example.net/%7Euser;v=1"),
    ("https://docs.example.net/back\\slash", None),
    ("https://docs.example.net/bell\x07", None),
    (" \thttps://docs.example.net", None),
    ("  https://docs.example.net", "https://docs.example.net/"),
    ("https://docs.example.net/in ner", "https://docs.example.net/in ner"),
    ("https://docs.example.net/?", "https://docs.example.net/"),
    ("https://docs.example.net/?secret=", "https://docs.example.net/?secret="),
    ("https://docs.example.net/?secret", "https://docs.example.net/?secret"),
    ("https://docs.example.net/?page=3&Secret=x", None),
    ("https://docs.example.net/?p%61ssword=x", None),
    ("https://docs.example.net/?pass+word=x", "https://docs.example.net/?pass+word=x"),
    ("https://docs.example.net/?page=secret", "https://docs.example.net/?page=secret"),
    ("https://docs.example.net/#secret=x", "https://docs.example.net/"),
    ("http://Österreich.example/ö", "http://xn--sterreich-z7a.example/ö"),
    ("http://日本.example:8080/", "http://xn--wgv71a.example:8080/"),
    ("http://two..dots.example/", None),
    ("http://" + "l" * 64 + ".example/", None),
    ("http://" + "l" * 63 + ".example/", "http://" + "l" * 63 + ".example/"),
    ("http://last.dot.example./", "http://last.dot.example./"),
    ("http://192.0.2.7:80/", "http://192.0.2.7/"),
    ("http://[2001:DB8::7]:8080/", "http://[2001:db8::7]:8080/"),
    ("http://[2001:db8::7]:80", "http://[2001:db8::7]/"),
    ("http://[::192.0.2.7]/", "http://[::192.0.2.7]/"),
    ("http://[2001:db8:7]/", None),
    ("http://[2001:db8::7/", None),
    ("http://[192.0.2.7]/", None),
    ("http://docs.example.net/" + "p" * (LONGEST - 24), "http://docs.example.net/" + "p" * (LONGEST - 24)),
    ("http://docs.example.net/" + "p" * (LONGEST - 23), None),
]


def test_normalize_stated_cases(spark):
    got = evaluate(spark, [(u,) for u, _ in STATED], normalize_url(F.col("v0")))
    assert got == [want for _, want in STATED]


def test_normal_forms_have_the_properties_of_normal_forms(spark):
    """Random URLs: normalising again changes nothing, and the parts are as they should be."""
    rnd = random.Random(23)
    parts = (
        ["http", "https", "HTTPS"], ["://"], ["Docs.Example.NET", "a.example", "10.1.2.3", "[::1]", "[2001:DB8::A]", "größe.example", "a..b", "u@h"],
        ["", ":", ":80", ":443", ":8443", ":99999", ":x"], ["", "/", "/a/./b", "/A b", "/ä;p", "//"],
        ["", "?", "?a=1&b=2", "?a=1&token=2", "?TOKEN=", "?api_key=1", "?q=token"], ["", "#", "#frag?token=1"],
    )
    urls = sorted({"".join(map(rnd.choice, parts)) for _ in range(6000)})
    once = evaluate(spark, [(u,) for u in urls], normalize_url(F.col("v0")))
    normal = [n for n in once if n is not None]
    assert evaluate(spark, [(n,) for n in normal], normalize_url(F.col("v0"))) == normal
    for url, n in zip(urls, once):
        sensitive = any(k.lower() in ("token", "api_key") and v for k, _, v in (
            p.partition("=") for p in url.partition("#")[0].partition("?")[2].split("&")))
        wrong = any(x in url for x in ("@", "a..b", ":99999", ":x"))
        assert (n is None) == (sensitive or wrong), url
        if n is not None:
            scheme, _, rest = n.partition("://")
            host, _, path = rest.partition("/")
            assert scheme == url.partition(":")[0].lower() and host == host.lower() and host.isascii() and "#" not in n
            assert not host.endswith((":", {"http": ":80", "https": ":443"}[scheme])) and not n.endswith("?")
            assert ("/" + path).startswith("/") and rest[len(host)] == "/"
            asked = url.partition("#")[0].partition("?")[2]
            assert n.partition("?")[2] == asked


def test_admit_exact_origin(spark):
    outside = ["https://sub.example.com", "https://example.com.evil.invalid", "http://example.com",
               "https://example.com:8443"]
    rows = [(u, "https://example.com") for u in outside + ["https://example.com/x#y", "http://[", "/relative"]]
    got = evaluate(spark, rows, admit(F.col("v0"), F.col("v1")))
    assert [r["reason"] for r in got] == ["outside_origin"] * 4 + [None] + ["invalid_or_sensitive_url"] * 2
    assert got[4]["url"] == "https://example.com/x"


def test_sensitive_query(spark):
    got = evaluate(spark, [("a=1&token=x",), ("token=",), ("token",), ("a=b",), ("",)], has_sensitive_query(F.col("v0")))
    assert got == [True, False, False, False, False]


def test_resolve_agrees_with_urljoin(spark):
    """Targets are those of the standard join, compared in their normal forms."""
    rnd = random.Random(31)
    bases = ["https://docs.example.net", "https://docs.example.net/one/two", "https://docs.example.net/one/two/?k=v",
             "http://docs.example.net:81/one;p/two;q?k", "https://docs.example.net/one//./two/../three"]
    atoms = ["x", "x;y", "x/y", "/", "//", "//else.example", "./", "../", "..", ".", ";", "?k=v", "?", "#", "#f", ":", "ö", " ",
             "http:", "https:", "tel:1"]
    pairs = sorted({(rnd.choice(bases), "".join(rnd.choices(atoms, k=rnd.randint(0, 4)))) for _ in range(12000)})

    def joined(base, href):
        try:
            return urljoin(base, href)
        except ValueError:
            return ""

    got = evaluate(spark, pairs, normalize_url(resolve_url(F.col("v0"), F.col("v1"))))
    want = evaluate(spark, [(joined(*p),) for p in pairs], normalize_url(F.col("v0")))
    assert [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w] == []


@pytest.mark.parametrize("text, want", [
    ("https://e.com/für x?q='é'", "https://e.com/f%C3%BCr%20x?q=%27%C3%A9%27"),
    ("https://e.com/a%20b?x=1", "https://e.com/a%20b?x=1"),
    ("http://[::1]/[x]|", "http://[::1]/%5Bx%5D%7C"),
    ("https://e.com/it's", "https://e.com/it's"),
])
def test_request_url(spark, text, want):
    assert evaluate(spark, [(text,)], request_url(F.col("v0"))) == [want]


def test_percent_decode_keeps_plus_and_broken_escapes(spark):
    got = evaluate(spark, [("a%20b+c",), ("%zz%41",), ("100%",), ("%C3%BC",), ("plain",)], percent_decode(F.col("v0")))
    assert got == ["a b+c", "%zzA", "100%", "ü", "plain"]
