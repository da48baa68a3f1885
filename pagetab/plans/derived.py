"""Inputs that the registered queries derive from the given tables.

The tables hold no captures, robots files or limits, so these are computed from
them, row by row, without leaving rows out. The SQL oracles state the same rules.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagetab.functions.batches import batch_limits, column, frugal
from pagetab.sources.capture import as_responses, read_table

# The three robots files that derived crawls use, by length of the origin modulo 3.
ROBOTS_BODIES = (
    "User-agent: *\nDisallow: /de\nDisallow: /the\n",
    "# staging rules\nUser-agent: other\nDisallow: /\n\nUser-agent: PageTab\nUser-agent: backup\n"
    "Allow: /fr/1\nDisallow: /fr\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\n",
    "Disallow: /before-any-agent\nUser-agent: *\nCrawl-delay: 1\nDisallow: /es/ # spanish\nAllow: /en\nDisallow: /en/9\n",
)

# Fixed value: the robots file of the origins whose crawls may not start, as it asks for too long a delay.
SLOW_BODY = "User-agent: *\nDisallow: /en\nCrawl-delay: 75\n"

# First two groups of the IPv6 literals that orders are read as.
V6_STARTS = (
    (0x2606, 0x4700), (0x2001, 0x0), (0x2001, 0xDB8), (0x2001, 0x1), (0x2001, 0x3), (0x2001, 0x20), (0x2001, 0x3F), (0x2001, 0x40),
    (0x2001, 0x1FF), (0x2001, 0x200), (0x2002, 0x1), (0xFE80, 0x0), (0xFEBF, 0x1), (0xFEC0, 0x0), (0xFC00, 0x0), (0xFDFF, 0x9),
    (0x64, 0xFF9B), (0x100, 0x0), (0x0, 0x0), (0xFF02, 0x0), (0x2A00, 0x1450),
)

CATALOG = "https://catalog.example.com"


def by_length(text: Column, modulus: int) -> Column:
    return F.length(text) % modulus


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_responses(read_table(spark, sf_dir, "pages"))


def page_responses(captures: DataFrame) -> DataFrame:
    """Captured pages with some statuses, types, encodings and redirects set by page number."""
    n = F.col("capture_id")
    status = F.when(n % 17 == 3, F.lit(503)).when(n % 13 == 5, F.lit(302)).otherwise(F.lit(200))
    location = (
        F.when(n % 4 == 0, F.concat(F.lit("/moved/"), n.cast("string")))
        .when(n % 4 == 1, F.lit("https://elsewhere.example.org/x"))
        .when(n % 4 == 2, F.col("url"))
        .when(n % 8 == 7, F.lit("/next?token=1"))
    )
    return captures.withColumns({
        "http_status": status,
        "content_type": F.when(n % 19 == 7, F.lit("image/png")).when(n % 29 == 13, F.lit(None)).when(
            n % 31 == 5, F.lit("application/octet-stream")).otherwise(F.col("content_type")),
        "content_encoding": F.when(n % 23 == 11, F.lit("unknown")),
        "location": F.when(status == 302, location),
    })


def origins(captures: DataFrame) -> DataFrame:
    return captures.select("crawl_id").distinct()


def _packed(responses: DataFrame) -> DataFrame:
    """Bodies of every seventh page packed, unless their encoding is set already or they might be too large even so."""
    batch_limits(responses.sparkSession)
    names = responses.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codings = batch.column("capture_id").to_pylist(), batch.column("content_encoding").to_pylist()
            bodies = batch.column("body").to_pylist()
            packs = [c is None and i % 7 == 2 and len(b) <= 24_000 for i, c, b in zip(ids, codings, bodies, strict=True)]
            bodies = [gzip.compress(b) if p else b for p, b in zip(packs, bodies, strict=True)]
            new = {"body": column(bodies, pa.binary()), "content_encoding": column(["gzip" if p else c for p, c in zip(packs, codings, strict=True)], pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return responses.mapInArrow(frugal(run), responses.schema)


def site_responses(captures: DataFrame) -> DataFrame:
    """``page_responses``, some packed, plus one start page per origin."""
    html = F.concat(
        F.lit("<title>Site index</title><main>Captured pages of "), F.col("crawl_id"), F.lit("</main>")
    )
    start = origins(captures).select(
        "crawl_id",
        F.lit(-1).cast("bigint").alias("capture_id"),
        F.concat("crawl_id", F.lit("/")).alias("url"),
        F.lit(200).alias("http_status"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("content_encoding"),
        F.lit(None).cast("string").alias("location"),
        html.cast("binary").alias("body"),
        F.expr("timestamp_seconds(1704067200)").alias("fetched_at"),
        F.lit(None).cast("string").alias("error_type"),
    )
    return _packed(page_responses(captures)).unionByName(start)


def site_anchors(captures: DataFrame) -> DataFrame:
    """Links from every start page to the captured pages of its origin, in page order, and after them some that are refused."""
    n = F.col("capture_id")
    elsewhere = F.when(n % 3 == 0, F.struct((n + 10**12).alias("pos"), F.concat(F.lit("https://elsewhere.example.org/"), n).alias("href")))
    secret = F.when(n % 5 == 0, F.struct((n + 2 * 10**12).alias("pos"), F.concat(F.lit("/next?token="), n).alias("href")))
    own = F.struct(n.alias("pos"), F.col("url").alias("href"))
    return captures.select("crawl_id", F.explode(F.array_compact(F.array(own, elsewhere, secret))).alias("a")).select(
        "crawl_id",
        F.lit(-1).cast("bigint").alias("capture_id"),
        F.concat("crawl_id", F.lit("/")).alias("url"),
        F.lit(None).cast("string").alias("base_href"),
        "a.pos", "a.href",
    )


def site_policies(captures: DataFrame, tight: bool = False) -> DataFrame:
    """One policy per origin: the largest budgets a policy may have, or for every other one small ones that vary with the name's length."""
    name = F.col("crawl_id")
    wide = (by_length(name, 2) == 0) | F.lit(not tight)
    return origins(captures).select(
        "crawl_id",
        F.concat(name, F.lit("/")).alias("start_url"),
        name.alias("allowed_origin"),
        F.when(wide, 1000).otherwise(F.lit(4) + by_length(name, 17)).alias("max_pages"),
        F.when(wide, 2000).otherwise(F.lit(6) + by_length(name, 13)).alias("max_requests"),
        F.when(wide, 10000).otherwise(F.lit(5) + by_length(name, 29) * 2).alias("max_candidates"),
        F.lit(12000).alias("max_body_bytes"),
        F.lit(600).alias("max_text_chars"),
        F.lit(None).cast("double").alias("delay"),
        F.lit(None).cast("double").alias("timeout"),
        F.lit(False).alias("allow_loopback"),
    )


def site_robots(captures: DataFrame) -> DataFrame:
    """One robots answer per origin; some are missing or unavailable."""
    name = F.col("crawl_id")
    body = F.when(by_length(name, 10) == 5, F.lit(SLOW_BODY)).otherwise(
        F.element_at(F.array(*map(F.lit, ROBOTS_BODIES)), by_length(name, 3) + 1))
    status = F.when(by_length(name, 10) == 7, F.lit(404)).when(by_length(name, 10) == 9, F.lit(503)).otherwise(F.lit(200))
    return origins(captures).select(
        "crawl_id",
        status.alias("http_status"),
        F.lit("text/plain; charset=utf-8").alias("content_type"),
        F.lit(None).cast("string").alias("content_encoding"),
        body.alias("body"),
        F.lit(None).cast("string").alias("error_type"),
    )


def catalog_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl of the catalog per region."""
    return read_table(spark, sf_dir, "region").select(
        F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("crawl_id"),
        F.concat(F.lit(f"{CATALOG}/region/"), F.col("r_regionkey").cast("string")).alias("start_url"),
        F.lit(CATALOG).alias("allowed_origin"),
        F.lit(1000).alias("max_pages"),
        F.lit(2000).alias("max_requests"),
        F.lit(10000).alias("max_candidates"),
    )


def catalog_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's link graph: region to nation to supplier to part and back to the supplier.

    Every row is crawl_id, src_url, pos, url, deeper. Each link belongs to the
    crawl of the region its supplier lies in.
    """
    nation = read_table(spark, sf_dir, "nation")
    supplier = read_table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    supplied = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))

    def page(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{CATALOG}/{kind}/"), F.col(key).cast("string"))

    def link(rows: DataFrame, source: Column, key: str, target: Column) -> DataFrame:
        return rows.select(
            F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("crawl_id"),
            source.alias("src_url"), F.col(key).cast("bigint").alias("pos"), target.alias("url"), F.lit(1).alias("deeper"),
        )

    # both ways of a pair at once, so that pairs are counted and joined once
    there, back = page("supplier", "l_suppkey"), page("part", "l_partkey")
    ways = F.array(
        F.struct(there.alias("s"), F.col("l_partkey").alias("p"), back.alias("t")),
        F.struct(back.alias("s"), F.col("l_suppkey").alias("p"), there.alias("t")))
    both = link(supplied.select("n_regionkey", F.inline(ways)), F.col("s"), "p", F.col("t"))
    return (
        link(nation, page("region", "n_regionkey"), "n_nationkey", page("nation", "n_nationkey"))
        .unionByName(link(supplier, page("nation", "n_nationkey"), "s_suppkey", page("supplier", "s_suppkey")))
        .unionByName(both)
    )


def customer_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(starts, links): one crawl per nation, whose customers in order of their keys each link to the next."""
    customer = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"))
    crawl, page = F.concat(F.lit("nation-"), F.col("n").cast("string")), lambda k: F.concat(F.lit(f"{CATALOG}/customer/"), k.cast("string"))
    following = F.lead("k").over(Window.partitionBy("n").orderBy("k"))
    links = customer.withColumn("next", following).where(F.col("next").isNotNull()).select(
        crawl.alias("crawl_id"), page(F.col("k")).alias("src_url"), F.lit(0).cast("bigint").alias("pos"),
        page(F.col("next")).alias("url"), F.lit(1).alias("deeper"),
    )
    starts = customer.groupBy("n").agg(F.min("k").alias("k")).select(
        crawl.alias("crawl_id"), page(F.col("k")).alias("start_url"), F.lit(CATALOG).alias("allowed_origin"),
        F.lit(1000).alias("max_pages"), F.lit(2000).alias("max_requests"), F.lit(10000).alias("max_candidates"),
    )
    return starts, links


def ipv6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IPv6 literal from every order key, written in one of five ways, one of which is no address."""
    key = F.col("o_orderkey")
    first, second = (F.element_at(F.array(*map(F.lit, x)), (key % len(V6_STARTS) + 1).cast("int")) for x in zip(*V6_STARTS, strict=True))
    low = [(F.floor(key / 16) % 3).cast("int"), (F.floor(key / 48) % 2).cast("int")]
    digits = lambda n: F.lower(F.hex(n))
    whole = [first, second, *([F.lit(0)] * 4), low[1], low[0]]
    quad = F.concat_ws(".", *[p.cast("string") for p in (key % 256, (key * 7) % 256, (key * 13 + 5) % 256, (key * 3) % 256)])
    form = (F.floor(key / 7) % 5).cast("int")
    host = (
        F.when(form == 0, F.concat_ws(":", *map(digits, whole)))
        .when(form == 1, F.concat(digits(first), F.lit(":"), digits(second), F.lit("::"), digits(low[1]), F.lit(":"), digits(low[0])))
        .when(form == 2, F.upper(F.concat_ws(":", *[F.lpad(digits(g), 4, "0") for g in whole])))
        .when(form == 3, F.concat(F.lit("::ffff:"), quad))
        .otherwise(F.concat(digits(first), F.lit("::"), digits(second), F.lit("::"), digits(low[0])))
    )
    return read_table(spark, sf_dir, "orders").select("o_orderkey", form.alias("form"), host.alias("host"))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a request ledger, one crawl per user."""
    kind, value = F.col("event_type"), F.col("value")
    host = F.when((kind == "click") & (value < 5), F.lit("https://other.example.com")).otherwise(
        F.lit("https://site.example.com")
    )
    tail = F.when((kind == "view") & (value < 3), F.lit("?token=x")).otherwise(F.lit(""))
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("crawl_id"),
        F.concat(host, F.lit("/"), kind, F.lit("/"), F.col("event_id").cast("string"), tail).alias("url"),
        F.when((kind == "error") & (value > 60), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).alias("time"),
        F.when(value > 90, F.lit("session")).alias("cookie"),
        F.when((kind == "signup") & (value > 80), F.lit("Basic")).alias("authorization"),
    )


def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages compressed in different ways by page number, some of them damaged."""
    batch_limits(spark)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = (
            (None, lambda b: b),
            ("gzip", gzip.compress),
            ("X-GZip", gzip.compress),
            ("deflate", zlib.compress),
            ("deflate", lambda b: zlib.compress(b, wbits=-15)),
            ("gzip, deflate", lambda b: zlib.compress(gzip.compress(b))),
            ("unknown, gzip", gzip.compress),
            ("gzip", lambda b: b"not compressed " + b),
            ("gzip", lambda b: gzip.compress(b)[:-4]),
        )
        for batch in batches:
            ids = batch.column("page_id").to_pylist()
            chosen = [ways[i % len(ways)] for i in ids]
            bodies = [f(h.encode()) for (_, f), h in zip(chosen, batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), column([e for e, _ in chosen], pa.string()), column(bodies, pa.binary())],
                ["page_id", "content_encoding", "body"],
            )

    return pages.mapInArrow(frugal(run), "page_id bigint, content_encoding string, body binary")
