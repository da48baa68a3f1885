"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagetab.functions.text import clean_text, content_sha256, csv_guard, is_longer, limited, utc_iso
from pagetab.functions.urls import admit, has_sensitive_query, normalize_url, url_origin
from pagetab.operators import audits, frontier as fr, policies as pol, reconcile as rec, reports as rp, robots as rb
from pagetab.operators.bodies import decode_bodies, plain_bodies
from pagetab.operators.classify import classify, first_captures, has_residual
from pagetab.operators.pages import decide_links, extract_pages, link_rows
from pagetab.plans import derived as d
from pagetab.plans.crawl import CrawlRun, crawl
from pagetab.sources.capture import located_pages, read_table, split_pages
from pagetab.sources.shared import shared_folder, written
from pagetab.sources.sinks import TargetExists, document_cells, write_run

# Ways in which the URL queries rewrite every page URL.
URL_FORMS: dict[str, Callable[[Column], Column]] = {
    "plain": lambda u: u,
    "upper": F.upper,
    "default_port": lambda u: F.regexp_replace(u, r"^(https)(://[^/]+)", "$1$2:0443"),
    "other_port": lambda u: F.regexp_replace(u, r"^(https?://[^/]+)", "$1:8443"),
    "bad_port": lambda u: F.regexp_replace(u, r"^(https?://[^/]+)", "$1:65536"),
    "word_port": lambda u: F.regexp_replace(u, r"^(https?://[^/]+)", "$1:wrong"),
    "userinfo": lambda u: F.replace(u, F.lit("://"), F.lit("://me@")),
    "secret": lambda u: F.concat(F.regexp_replace(u, "[?#].*", ""), F.lit("?a=1&%74oken=x")),
    "blank_secret": lambda u: F.concat(F.regexp_replace(u, "[?#].*", ""), F.lit("?TOKEN=")),
    "upper_secret": lambda u: F.concat(F.regexp_replace(u, "[?#].*", ""), F.lit("?Api_Key=1&b=2")),
    "late_fragment": lambda u: F.concat(F.regexp_replace(u, "#.*", ""), F.lit("#?token=1")),
    "other_scheme": lambda u: F.regexp_replace(u, "^https?", "ftp"),
    "newline": lambda u: F.concat(u, F.lit("\n")),
    "backslash": lambda u: F.concat(u, F.lit("\\x")),
    "led_by_spaces": lambda u: F.concat(F.lit("  "), u),
    "empty_label": lambda u: F.replace(u, F.lit(".example."), F.lit("..example.")),
    "no_path": lambda u: F.regexp_extract(u, "^https?://[^/]+", 0),
    "bare_query": lambda u: F.concat(F.regexp_extract(u, "^https?://[^/]+", 0), F.lit("?")),
    "too_long": lambda u: F.concat(u, F.repeat(F.lit("x"), 4096)),
}

# References built from every anchor's path, to be resolved against its page.
LINK_FORMS: dict[str, Callable[[Column], Column]] = {
    "as_is": lambda h: h,
    "relative": lambda h: F.substring(h, F.lit(2), F.length(h)),
    "up": lambda h: F.concat(F.lit("../"), F.substring(h, F.lit(2), F.length(h))),
    "here": lambda h: F.concat(F.lit("./"), F.substring(h, F.lit(2), F.length(h))),
    "query": lambda h: F.concat(F.lit("?q="), F.substring(h, F.lit(2), F.length(h))),
    "fragment": lambda h: F.concat(F.lit("#"), F.substring(h, F.lit(2), F.length(h))),
    "other_host": lambda h: F.concat(F.lit("//other.example.org"), h),
    "script": lambda h: F.concat(F.lit("javascript:"), h),
    "padded": lambda h: F.concat(F.lit(" \n"), h),
    "empty": lambda h: F.lit(""),
}


def _forms(value: Column, forms: dict[str, Callable[[Column], Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("form"), f(value).alias("value")) for n, f in forms.items()]))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages")


def _url_forms(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).select("page_id", F.col("url").alias("page_url"))
    return pages.select("page_id", "page_url", _forms(F.col("page_url"), URL_FORMS).alias("f")).select(
        "page_id", "page_url", "f.form", F.col("f.value").alias("url")
    )


def normalize_url_q(spark: SparkSession, sf: str) -> DataFrame:
    return _url_forms(spark, sf).select("page_id", "form", normalize_url("url").alias("normal"))


def admit_reason(spark: SparkSession, sf: str) -> DataFrame:
    rows = _url_forms(spark, sf).withColumn("allowed", url_origin(normalize_url("page_url")))
    return rows.withColumn("d", admit("url", "allowed")).select("page_id", "form", "d.url", "d.reason")


def origin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _url_forms(spark, sf).select("page_id", url_origin(normalize_url("url")).alias("origin"))
        .where(F.col("origin").isNotNull()).groupBy("origin")
        .agg(F.count(F.lit(1)).alias("urls"), F.countDistinct("page_id").alias("pages"))
    )


def sensitive_query(spark: SparkSession, sf: str) -> DataFrame:
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    return _url_forms(spark, sf).select("page_id", "form", has_sensitive_query(query).alias("sensitive"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract_pages(_pages(spark, sf), "html")


def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("page_id", "title", (F.col("title") == "").alias("title_missing"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("page_id", "url", "text")


def content_sha256_q(spark: SparkSession, sf: str) -> DataFrame:
    pages = _extracted(spark, sf).select("page_id", content_sha256(F.col("text")).alias("content_sha256"))
    return pages


def text_truncated(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.lit(pol.DEFAULTS["max_text_chars"])
    return read_table(spark, sf, "documents").select(
        "doc_id", limited(F.col("text"), limit).alias("text"), is_longer(F.col("text"), limit).alias("text_truncated")
    )


def clean_text_q(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("  \t")), F.lit("　\n"))
    return read_table(spark, sf, "documents").select("doc_id", clean_text(spaced).alias("text"))


def csv_guard_q(spark: SparkSession, sf: str) -> DataFrame:
    led = F.array(*map(F.lit, ["", "=", " +", "\t@", "-", "﻿=", "x="]))
    rows = read_table(spark, sf, "documents").select("doc_id", F.posexplode(led).alias("form", "lead"), "text")
    return rows.select("doc_id", "form", csv_guard(F.concat("lead", "text")).alias("cell"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    return link_rows(_extracted(spark, sf), "page_id").select("page_id", "pos", "href")


def links_resolved(spark: SparkSession, sf: str) -> DataFrame:
    pages = located_pages(_pages(spark, sf)).drop("normal")
    rows = link_rows(extract_pages(pages, "html"), "page_id", "crawl_id").withColumn("f", _forms(F.col("href"), LINK_FORMS))
    rows = rows.select("page_id", "crawl_id", "url", "base_href", "pos", "f.form", F.col("f.value").alias("href"))
    return decide_links(rows, "crawl_id").select("page_id", "pos", "form", "url", "reason")


def links_uncaptured(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct admitted link targets of which there is no capture."""
    pages = located_pages(_pages(spark, sf))
    rows = link_rows(extract_pages(pages, "html"), "crawl_id")
    targets = decide_links(rows, "crawl_id").where(F.col("url").isNotNull()).select("crawl_id", "url").distinct()
    captured = pages.select("crawl_id", F.col("normal").alias("url"))
    return targets.join(captured, ["crawl_id", "url"], "left_anti")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = plain_bodies(d.page_responses(d.page_captures(spark, sf))).drop("body")
    return classify(rows.withColumn("max_body_bytes", F.lit(12000)).withColumn("allowed_origin", F.col("crawl_id")))


def classify_response(spark: SparkSession, sf: str) -> DataFrame:
    return first_captures(_outcomes(spark, sf)).select("crawl_id", "url", "capture_id", "kind", "http_status", "error_type")


def redirects(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).where(F.col("kind") == "redirect").select(
        "capture_id", "url", "redirect_status", "redirect_to"
    )


def residual_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return d.page_responses(d.page_captures(spark, sf)).select("capture_id", has_residual(F.col("content_encoding")).alias("rejected"))


def body_limit(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("body")
    return d.page_responses(d.page_captures(spark, sf)).select(
        "capture_id", size.cast("bigint").alias("body_bytes"), (size > 3000).alias("too_large")
    )


def decode_bodies_q(spark: SparkSession, sf: str) -> DataFrame:
    return decode_bodies(d.encoded_pages(spark, sf), F.lit(10_000_000)).select(
        "page_id", content_sha256(F.col("body")).alias("body_sha256"), "residual_encoding", "decode_error", "decode_truncated"
    )


def _policy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Policies derived from customers, many of them faulty."""
    n, balance = F.col("c_nationkey"), F.col("c_acctbal")
    host = (
        F.when(n == 0, F.lit("localhost")).when(n == 1, F.lit("127.0.0.1")).when(n == 2, F.lit("10.0.0.1"))
        .when(n == 3, F.lit("8.8.8.8")).otherwise(F.concat(F.lit("n"), n.cast("string"), F.lit(".example.com")))
    )
    whole = F.floor(balance).cast("int")
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("crawl_id"),
        F.concat(F.lit("https://"), host, F.when(n == 4, F.lit(":8443")).otherwise(F.lit("")), F.lit("/start")).alias("start_url"),
        F.concat(
            F.lit("https://"), host,
            F.when(n == 5, F.lit("/path")).when(n == 6, F.lit("#x")).when(n == 7, F.lit(":wrong")).otherwise(F.lit("")),
        ).alias("allowed_origin"),
        F.when(balance >= 0, F.floor(balance / 8).cast("int")).alias("max_pages"),
        F.when(balance >= 1000, F.floor(balance / 4).cast("int")).alias("max_requests"),
        (whole + 500).alias("max_candidates"),
        F.when(n > 10, whole * 1100).alias("max_body_bytes"),
        F.when(n > 12, whole * 11).alias("max_text_chars"),
        F.when(n > 20, F.floor(balance / 100).cast("double")).alias("delay"),
        F.when(n > 22, F.floor(balance / 150).cast("double")).alias("timeout"),
        F.when(F.col("c_mktsegment").startswith("A"), F.lit(True)).alias("allow_loopback"),
    )


def policy_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return pol.with_defaults(_policy_rows(spark, sf)).select("crawl_id", *pol.DEFAULTS)


def policy_errors(spark: SparkSession, sf: str) -> DataFrame:
    checked = pol.validate(pol.with_defaults(_policy_rows(spark, sf)))
    return checked.select("crawl_id", F.array_join("errors", ",").alias("errors"))


def rejected_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Policies that no run starts, with the reasons."""
    refused = pol.refused(pol.validate(pol.with_defaults(_policy_rows(spark, sf))))
    return refused.select("crawl_id", F.size("errors").alias("n_errors"), F.array_join("errors", ",").alias("errors"))


def host_literal(spark: SparkSession, sf: str) -> DataFrame:
    """Class of the IPv4 literal made from every order key."""
    key = F.col("o_orderkey")
    parts = [key % 256, (key * 7) % 256, (key * 13 + 5) % 256, (key * 3) % 256]
    url = F.concat(F.lit("http://"), F.concat_ws(".", *[p.cast("string") for p in parts]), F.lit("/"))
    return read_table(spark, sf, "orders").select("o_orderkey", pol.host_class(url).alias("host_class"))


def ipv6_literal(spark: SparkSession, sf: str) -> DataFrame:
    """Class of the IPv6 literal made from every order key."""
    url = F.concat(F.lit("http://["), F.col("host"), F.lit("]/"))
    return d.ipv6_hosts(spark, sf).select("o_orderkey", "form", pol.host_class(url).alias("host_class"))


def rejected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that cannot be used, with the reason: every page's URL in many forms, and without."""
    pages = _pages(spark, sf).select("page_id", F.lit("absent").alias("form"), F.lit(None).cast("string").alias("url"))
    forms = _url_forms(spark, sf).select("page_id", "form", "url").unionByName(pages)
    return split_pages(forms, f"{shared_folder(spark)}/pages")[1].select("page_id", "form", "url", "reason")


def robots_rules_q(spark: SparkSession, sf: str) -> DataFrame:
    return rb.named_rules(rb.robots_groups(d.site_robots(d.page_captures(spark, sf)))).select(
        "crawl_id", F.col("grp").cast("int").alias("grp"), "seq", F.array_join("agents", ",").alias("agents"), "directive", "value"
    )


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    captures = d.page_captures(spark, sf)
    policies = pol.usable(pol.validate(pol.with_defaults(d.site_policies(captures))))
    return rb.robots_gate(policies, d.site_robots(captures))


def robots_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gates(spark, sf).select("crawl_id", "robots_status", "robots_http_status", "robots_error")


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    return rb.effective_rules(rb.robots_groups(d.site_robots(d.page_captures(spark, sf))))


def robots_delay(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _gates(spark, sf).join(rb.crawl_delays(_effective(spark, sf)), "crawl_id", "left")
        .select("crawl_id", "robots_delay", rb.delay_gate(F.col("delay"), F.col("robots_delay")).alias("effective_delay"))
    )


def _prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Path rules as a table, because the lookup reads them twice."""
    return written(rb.path_rules(_effective(spark, sf)), f"{shared_folder(spark)}/prefixes")


def robots_blocked(spark: SparkSession, sf: str) -> DataFrame:
    urls = located_pages(_pages(spark, sf)).select("crawl_id", F.col("normal").alias("url")).distinct()
    return rb.robots_verdicts(urls, _prefixes(spark, sf)).select("crawl_id", "url", "allowed")


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Every admitted link of every page, with the page number as the parent's place."""
    pages = located_pages(_pages(spark, sf)).withColumn("page_url", F.col("normal"))
    rows = link_rows(extract_pages(pages, "html"), "crawl_id", "page_id")
    admitted = decide_links(rows, "crawl_id").where(F.col("url").isNotNull())
    return admitted.select("crawl_id", "url", F.col("page_id").alias("parent_seq"), F.col("pos").cast("bigint").alias("pos"))


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return fr.first_mentions(_mentions(spark, sf)).select("crawl_id", "url", "parent_seq", "pos", "mentions")


def _capped(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.lit(3) + d.by_length(F.col("crawl_id"), 19)
    # A table, because numbering reads it twice and the pages are to be parsed once.
    firsts = written(fr.first_mentions(_mentions(spark, sf)), f"{shared_folder(spark)}/firsts")
    return fr.cap_candidates(firsts.withColumns({"taken": F.lit(0).cast("bigint"), "max_candidates": limit}))


def candidate_cap(spark: SparkSession, sf: str) -> DataFrame:
    return _capped(spark, sf).select("crawl_id", "url", F.col("seq").cast("bigint").alias("seq"))


def page_budget(spark: SparkSession, sf: str) -> DataFrame:
    judged = rb.robots_verdicts(_capped(spark, sf), _prefixes(spark, sf))
    wave = judged.withColumns({
        "blocked": ~F.col("allowed"),
        "request_url": F.col("url"),
        "attempts_before": F.lit(0).cast("bigint"),
        "page_budget": fr.page_budget(F.lit(20), F.lit(5) + d.by_length(F.col("crawl_id"), 7)),
    })
    return fr.spend_budget(wave).select("crawl_id", "url", F.col("seq").cast("bigint").alias("seq"), "blocked", "processed")


def frontier_depth(spark: SparkSession, sf: str) -> DataFrame:
    """The whole catalog crawled per region: every candidate with its parent, depth and place."""
    no_rules = spark.createDataFrame([], "crawl_id string, prefix string, seq int, allow boolean")
    found = fr.expand(d.catalog_starts(spark, sf), no_rules, d.catalog_edges(spark, sf), shared_folder(spark), block=4096, ahead=4)
    return found.select("crawl_id", "url", "discovered_from", "depth", F.col("seq").cast("bigint").alias("seq"), "processed")


def chain_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation as one chain of pages, crawled from its first page: one level for each page."""
    starts, links = d.customer_chains(spark, sf)
    no_rules = spark.createDataFrame([], "crawl_id string, prefix string, seq int, allow boolean")
    found = fr.expand(starts, no_rules, links, shared_folder(spark))
    return found.select("crawl_id", "url", "discovered_from", "depth", F.col("seq").cast("bigint").alias("seq"), "processed")


_RUNS: dict[tuple[str, str, bool], CrawlRun] = {}


def site_crawl(spark: SparkSession, sf: str, tight: bool = False) -> CrawlRun:
    """All origins of the page table crawled from their start pages, with the widest budgets or, for half of them, tight ones.

    The queries on a run read the tables of one and the same run; ``forget_runs``
    makes the next one start anew.
    """
    key = (spark.sparkContext.applicationId, sf, tight)
    if key not in _RUNS:
        _RUNS[key] = _new_site_crawl(spark, sf, tight)
    return _RUNS[key]


def forget_runs() -> None:
    _RUNS.clear()


def _new_site_crawl(spark: SparkSession, sf: str, tight: bool) -> CrawlRun:
    captures = d.page_captures(spark, sf)
    return crawl(
        d.site_policies(captures, tight), d.site_robots(captures), d.site_responses(captures),
        anchors=d.site_anchors(captures),
    )


def crawl_records(spark: SparkSession, sf: str) -> DataFrame:
    return site_crawl(spark, sf).records.select(
        "crawl_id", F.col("seq").cast("bigint").alias("seq"), "kind", "url", "discovered_from", "depth", "http_status",
        "title", "title_missing", "text", "text_truncated", "content_sha256", "redirect_status", "redirect_to",
        "error_type", "phase", utc_iso(F.col("fetched_at")).alias("fetched_at"),
    )


def documents_export(spark: SparkSession, sf: str) -> DataFrame:
    return document_cells(site_crawl(spark, sf).records)


def record_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rp.record_counts(site_crawl(spark, sf).records)


def link_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return site_crawl(spark, sf, tight=True).exclusions


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return site_crawl(spark, sf, tight=True).states.select("crawl_id", "stop_reason", "status")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = rp.run_summaries(site_crawl(spark, sf).reports)
    return summary.withColumns({
        "record_counts": F.to_json("record_counts"), "excluded_link_counts": F.to_json("excluded_link_counts")
    })


def report_json(spark: SparkSession, sf: str) -> DataFrame:
    return rp.report_json(site_crawl(spark, sf).reports)


def outputs_written(spark: SparkSession, sf: str) -> DataFrame:
    """A run's outputs written together, read back, and written again, which must be refused."""
    run, target = site_crawl(spark, sf), f"{shared_folder(spark)}/outputs"
    write_run(run.records, run.reports, target)
    try:
        write_run(run.records, run.reports, target)
        refused = False
    except TargetExists:
        refused = True
    parts = {
        "documents": (spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(f"{target}/documents"), F.length("url")),
        "records": (spark.read.schema("url string").json(f"{target}/records"), F.length("url")),
        "reports": (spark.read.schema("crawl_id string").json(f"{target}/reports"), F.length("crawl_id")),
    }
    rows = [
        table.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size.cast("bigint")).alias("chars")).select(
            F.lit(name).alias("output"), "n_rows", "chars", F.lit(refused).alias("second_refused"))
        for name, (table, size) in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def part_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as the list of what should be there; those ordered 50 at a time, some altered or twice, and suppliers as what is."""
    part = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    name = lambda lead, k: F.concat(F.lit(lead), k.cast("string")).alias("path")
    listed = part.select(name("Part_", key), size.alias("bytes"), F.sha2("p_name", 256).alias("sha256"))
    ordered = read_table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    there = part.join(ordered, "p_partkey").select(
        name("part.-", key), F.when(key % 11 == 0, size + 1).otherwise(size).alias("bytes"),
        F.sha2(F.when(key % 17 == 0, F.lit("")).otherwise(F.col("p_name")), 256).alias("sha256"),
        F.explode(F.sequence(F.lit(1), F.when(key % 13 == 0, 2).otherwise(1))).alias("again"))
    extra = read_table(spark, sf, "supplier").select(
        name("PART__s", F.col("s_suppkey")), F.lit(1).cast("bigint").alias("bytes"), F.sha2("s_name", 256).alias("sha256"))
    return listed, there.drop("again").unionByName(extra)


def part_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    listed, present = part_tables(spark, sf)
    return rec.reconcile(listed, present, "path", ["bytes", "sha256"])


def part_all_match(spark: SparkSession, sf: str) -> DataFrame:
    return rec.all_match(part_reconcile(spark, sf))


def part_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rec.missing_keys(part_reconcile(spark, sf))


def manifest_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers as the list of what should be there, orders and suppliers as what is."""
    customer = read_table(spark, sf, "customer")
    listed = customer.select(
        F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string")).alias("path"),
        F.col("c_nationkey").cast("bigint").alias("bytes"), F.sha2(F.col("c_name"), 256).alias("sha256"),
    )
    ordered = read_table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("customer.-"), F.col("o_custkey").cast("string")).alias("path"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit(0)).otherwise(F.col("c_nationkey")).cast("bigint").alias("bytes"),
        F.sha2(F.col("c_name"), 256).alias("sha256"),
    )
    supplied = read_table(spark, sf, "supplier").select(
        F.concat(F.lit("Supplier__"), F.col("s_suppkey").cast("string")).alias("path"),
        F.col("s_nationkey").cast("bigint").alias("bytes"), F.sha2(F.col("s_name"), 256).alias("sha256"),
    )
    return listed, ordered.unionByName(supplied)


def manifest_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    listed, present = manifest_tables(spark, sf)
    return rec.reconcile(listed, present, "path", ["bytes", "sha256"])


def manifest_all_match(spark: SparkSession, sf: str) -> DataFrame:
    return rec.all_match(manifest_reconcile(spark, sf))


def manifest_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rec.missing_keys(manifest_reconcile(spark, sf))


def _expectations(spark: SparkSession, sf: str) -> DataFrame:
    """What each origin's run should give by its captures alone, against what it gave."""
    run = site_crawl(spark, sf)
    is_error = F.col("kind") == "download_error"
    failed = rp.record_counts(run.records).groupBy("crawl_id").agg(
        F.sum(F.when(is_error, F.col("n")).otherwise(0)).alias("download_errors"),
        F.sum(F.when(~is_error, F.col("n")).otherwise(0)).alias("other_records"))
    # the ledger: the robots file, and every page that left a record of a request
    ledger = run.records.where((F.col("kind") != "blocked_robots") & (F.col("seq") > 0)).groupBy("crawl_id").agg(
        (F.count(F.lit(1)) + 1).alias("attempts"))
    exits = F.when(F.col("status") == "failed", 1).when(F.col("status") == "partial", 2).otherwise(0)
    actual = run.states.join(failed, "crawl_id", "left").join(ledger, "crawl_id", "left").select(
        F.col("crawl_id").alias("name"), "status", exits.alias("exit"), F.col("http_attempts").alias("requests"), "documents",
        "stop_reason", F.lit(None).cast("string").alias("document_hash"),
        F.coalesce("attempts", F.lit(1)).alias("attempts"), "download_errors", "other_records",
    )
    pages = run.outcomes.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("kind") == "document").alias("documents"))
    expected = pages.select(
        F.col("crawl_id").alias("name"), F.lit("partial").alias("status"), F.lit(2).alias("exit"),
        (F.col("urls") + 1).alias("requests"), "documents", F.lit("max_requests").alias("stop_reason"),
        F.lit(None).cast("string").alias("document_hash"),
    )
    return rec.check_expectations(expected, actual)


def expectation_check(spark: SparkSession, sf: str) -> DataFrame:
    return _expectations(spark, sf).select("name", F.array_join("errors", "; ").alias("errors"), "passed")


def expectations_passed(spark: SparkSession, sf: str) -> DataFrame:
    return rec.all_passed(_expectations(spark, sf))


def scope_violations(spark: SparkSession, sf: str) -> DataFrame:
    requests = d.event_requests(spark, sf)
    # crawls whose number ends in 7 have no policy
    known = requests.where(~F.col("crawl_id").endswith("7")).select("crawl_id").distinct()
    policies = known.withColumn("allowed_origin", F.lit("https://site.example.com"))
    return audits.scope_violations(requests, policies).select("request_id", "crawl_id", "url", "violation")


def request_gaps(spark: SparkSession, sf: str) -> DataFrame:
    requests = d.event_requests(spark, sf)
    delays = requests.select("crawl_id").distinct().withColumn("effective_delay", F.lit(1800.0))
    return audits.spacing_violations(requests, delays).select(
        "request_id", "crawl_id", F.round(F.col("gap") * 1_000_000).cast("bigint").alias("gap_micros")
    )


def ledger_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """The run's own attempts against a ledger in which every failed page was asked for twice."""
    run = site_crawl(spark, sf)
    asked = run.records.where(F.col("kind") != "blocked_robots").select("crawl_id", "url", "kind")
    files = run.gates.select("crawl_id", F.concat("allowed_origin", F.lit("/robots.txt")).alias("url"))
    again = asked.where(F.col("kind") == "http_error")
    pages = asked.where(~F.col("url").endswith("/robots.txt")).unionByName(again).select("crawl_id", "url")
    blocked = run.records.where(F.col("kind") == "blocked_robots").select("crawl_id", "url")
    return audits.ledger_reconcile(run.states, pages.unionByName(files), blocked).select(
        "crawl_id", "http_attempts", "logged", "repeated_urls", "blocked_requested", "consistent"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_url": normalize_url_q,
    "origin_counts": origin_counts,
    "admit_reason": admit_reason,
    "sensitive_query": sensitive_query,
    "policy_defaults": policy_defaults,
    "policy_errors": policy_errors,
    "rejected_policies": rejected_policies,
    "host_literal": host_literal,
    "ipv6_literal": ipv6_literal,
    "rejected_pages": rejected_pages,
    "clean_text": clean_text_q,
    "page_title": page_title,
    "page_text": page_text,
    "content_sha256": content_sha256_q,
    "text_truncated": text_truncated,
    "csv_guard": csv_guard_q,
    "links": links,
    "links_resolved": links_resolved,
    "links_uncaptured": links_uncaptured,
    "decode_bodies": decode_bodies_q,
    "residual_encoding": residual_encoding,
    "body_limit": body_limit,
    "classify_response": classify_response,
    "redirects": redirects,
    "robots_rules": robots_rules_q,
    "robots_gate": robots_gate,
    "robots_delay": robots_delay,
    "robots_blocked": robots_blocked,
    "first_seen": first_seen,
    "candidate_cap": candidate_cap,
    "page_budget": page_budget,
    "frontier_depth": frontier_depth,
    "chain_depth": chain_depth,
    "crawl_records": crawl_records,
    "documents_export": documents_export,
    "record_counts": record_counts,
    "link_exclusions": link_exclusions,
    "run_status": run_status,
    "run_summary": run_summary,
    "report_json": report_json,
    "outputs_written": outputs_written,
    "manifest_reconcile": manifest_reconcile,
    "manifest_all_match": manifest_all_match,
    "manifest_missing": manifest_missing,
    "part_reconcile": part_reconcile,
    "part_all_match": part_all_match,
    "part_missing": part_missing,
    "expectation_check": expectation_check,
    "expectations_passed": expectations_passed,
    "scope_violations": scope_violations,
    "request_gaps": request_gaps,
    "ledger_reconcile": ledger_reconcile,
}
