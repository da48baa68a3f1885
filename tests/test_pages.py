"""Page-text job on stated documents and malformed markup."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagetab.functions.html import scan_page
from pagetab.functions.text import clean_text, csv_guard, is_longer, limited, utc_iso
from pagetab.operators.pages import decide_links, extract_pages, link_rows, with_document_columns


@pytest.mark.parametrize("html, title, text", [
    ("<html><title>Dense</title><main><p>a</p><p>b</p></main></html>", "Dense", "a b"),
    ("<title>A &amp; <b>B</title>x<!--c-->y &lt; 5 < 6", "A & <b>B", "x y < 5 < 6"),
    ("<head><title>t</title><p>body<article>one<article>two</article>three</article>four<main>five</main>", "t", "one two three"),
    ("<body>no title<script>var a='<main>';</script><style>p{}</style><noscript>n</noscript><template>t</template>", "", "no title"),
    ("<main>in<main>nested</main>still</main>out", "", "in nested still"),
    ("<p>unclosed<p>next<b>bold", "", "unclosed next bold"),
    ("text in no element", "", "text in no element"),
    ("<head>stray text<title>late</title>", "late", "stray text late"),
    ("<main>a<span>b</main>c", "", "a b"),
    ("<!doctype html><HTML><HEAD><TITLE> Two\n lines </TITLE></HEAD><BODY><MAIN>X</MAIN></BODY>", "Two lines", "X"),
    ("<title>first</title><svg><title>second</title></svg>", "first", "second"),
    ("<title>never closed <p>text", "never closed <p>text", ""),
    ("", "", ""),
    ("<", "", "<"),
    ("<main>&nbsp;a&#160;b</main>", "", "a b"),
    ("<article>a</article><main>b</main>", "", "a"),
    ("<textarea><b>raw &amp; kept</b></textarea>", "", "<b>raw & kept</b>"),
])
def test_title_and_text(html, title, text):
    assert scan_page(html)[:2] == (title, text)


@pytest.mark.parametrize("html, hrefs", [
    ("<a href>e</a><a name=x>n</a><A HREF='/x>y'>z</A><a title=it's href=\"/q\">w</a>", ["", "/x>y", "/q"]),
    ("<a href=\"?a=1&copy=2&amp;b&lt;\">", ["?a=1&copy=2&b<"]),
    ("<a href=/bare>b<a href='/again' href='/second'>", ["/bare", "/again"]),
    ("<script><a href='/no'></script><!-- <a href='/no'> --><noscript><a href='/yes'></noscript>", ["/yes"]),
    ("<a\nhref\n=\n'/spaced'/>", ["/spaced"]),
    ("<a data-x='a=b>' href='/after'>", ["/after"]),
    ("<a href='/whole'>x<a href='/cut off", ["/whole"]),
])
def test_anchors(html, hrefs):
    assert scan_page(html)[3] == hrefs


def test_base_of_links(spark):
    rows = [(1, "https://e.com/a/b", "<base href='/docs/'><a href='x'>1</a>"), (2, "https://e.com/a/b", "<a href='x'>1</a>"),
            (3, "https://e.com/a/b", "<base href='https://o.org/'><a href='x'>1</a>"), (4, "https://e.com/a/b", None)]
    df = spark.createDataFrame(rows, "id int, url string, html string").withColumn("own", F.lit("https://e.com"))
    got = decide_links(link_rows(extract_pages(df, "html"), "id", "own"), "own").orderBy("id").collect()
    assert [(r.id, r.url, r.reason) for r in got] == [
        (1, "https://e.com/docs/x", None), (2, "https://e.com/a/x", None), (3, None, "outside_origin")]


def test_bytes_charset_and_limits(spark):
    rows = [("<main>für</main>".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("<main>für</main>".encode(), "text/html"),
            ("<main>für</main>".encode(), "text/html; charset=nonsense"), (b"<main>f\xffr</main>", "text/html")]
    df = spark.createDataFrame(rows, "body binary, type string")
    pages = with_document_columns(extract_pages(df, "body", "type"), F.lit(2)).collect()
    assert [p.text for p in pages] == ["fü", "fü", "fü", "f�"]
    assert all(p.text_truncated and p.title_missing for p in pages)
    assert pages[0].content_sha256 == hashlib.sha256("für".encode()).hexdigest()


def test_text_columns(spark):
    space = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    values = [space + "a" + space + "b" + space, "​a", "x😀y", "=NOW()", "  +3 apples", "\t@home", "-minus", "\ufeff=x", "plain words", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    rows = df.select(clean_text(F.col("v")).alias("c"), csv_guard(F.col("v")).alias("g"), limited(F.col("v"), F.lit(2)).alias("l"),
                     is_longer(F.col("v"), F.lit(3)).alias("t")).collect()
    assert [r.c for r in rows[:2]] == [" ".join(v.split()) for v in values[:2]]
    assert (rows[2].l, rows[2].t) == ("x😀", False)
    assert [r.g for r in rows[3:8]] == ["'" + v for v in values[3:8]]
    assert [r.g for r in rows[8:]] == ["plain words", ""]


def test_iso_time(spark):
    df = spark.sql("select timestamp'2024-05-01 02:03:04' a, timestamp'2024-05-01 02:03:04.5' b")
    assert df.select(utc_iso(F.col("a")), utc_iso(F.col("b"))).first()[:] == ("2024-05-01T02:03:04+00:00", "2024-05-01T02:03:04.500000+00:00")
