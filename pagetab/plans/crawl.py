"""A whole run: policies, robots files and captured responses to records and reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pagetab.operators import frontier as fr, reports as rp, robots as rb
from pagetab.operators.bodies import decode_bodies, plain_bodies
from pagetab.operators.classify import classify, first_captures, may_be_document
from pagetab.operators.pages import decide_links, extract_pages, link_rows, with_document_columns
from pagetab.operators.policies import refused, usable, validate, with_defaults
from pagetab.sources.shared import shared_folder, written

KEYS = ("crawl_id", "url", "capture_id")


class CrawlRun(NamedTuple):
    """The tables of one run; ``refused`` has the policies that were not run, with their errors."""

    gates: DataFrame
    outcomes: DataFrame
    frontier: DataFrame
    records: DataFrame
    exclusions: DataFrame
    states: DataFrame
    reports: DataFrame
    refused: DataFrame


def gate_crawls(policies: DataFrame, robots: DataFrame, folder: str, user_agent: str = rb.USER_AGENT) -> tuple[DataFrame, DataFrame]:
    """(gates, path rules): usable policies with robots status and delay, and the rules that apply."""
    gated = written(rb.robots_gate(usable(validate(with_defaults(policies))), robots), f"{folder}/robots")
    loaded = gated.where(F.col("robots_status") == "loaded").select("crawl_id", F.col("robots_body").alias("body"))
    effective = written(rb.effective_rules(rb.robots_groups(loaded), user_agent), f"{folder}/rules")
    gates = (
        gated.drop("robots_body")
        .join(rb.crawl_delays(effective), "crawl_id", "left")
        .withColumn("effective_delay", rb.delay_gate(F.col("delay"), F.col("robots_delay")))
    )
    return written(gates, f"{folder}/gates"), rb.path_rules(effective)


def parse_responses(responses: DataFrame, gates: DataFrame, folder: str, encoded: bool = True) -> DataFrame:
    """Decode and parse every response of the gated crawls once, and keep the result as a table.

    Limits and origin of the crawl come onto the row first, so that bodies are
    expanded no further than their policy allows and texts are hashed and cut to
    the policy's limit before anything is exchanged. Pages of crawls that may not
    start are not parsed.
    """
    limits = gates.select("crawl_id", "max_body_bytes", "max_text_chars", "allowed_origin", may_start().alias("startable"))
    limited = responses.join(limits, "crawl_id")
    bodies = decode_bodies(limited, F.col("max_body_bytes")) if encoded else plain_bodies(limited)
    readable = bodies.withColumn("body", F.when(F.col("startable") & may_be_document(bodies), F.col("body")))
    pages = extract_pages(readable, "body", "content_type")
    return written(with_document_columns(pages, F.col("max_text_chars")), f"{folder}/parsed")


def may_start() -> Column:
    """Whether a gated crawl may request pages."""
    return (F.col("robots_status") != "unavailable") & F.col("effective_delay").isNotNull()


def _decided(parsed: DataFrame, anchors: DataFrame | None, documents: DataFrame) -> DataFrame:
    """Decided links of ``documents``; the origin is on the page's row before its links are expanded."""
    pages = parsed.select(*KEYS, "allowed_origin", "base_href", "hrefs").join(documents.select(*KEYS), list(KEYS), "left_semi")
    rows = link_rows(pages, "crawl_id", "capture_id", "allowed_origin").withColumn("pos", F.col("pos").cast("bigint"))
    if anchors is not None:
        rows = rows.unionByName(anchors.join(pages.select(*KEYS, "allowed_origin"), list(KEYS)))
    return decide_links(rows, "allowed_origin").drop("allowed_origin")


def crawl(
    policies: DataFrame,
    robots: DataFrame,
    responses: DataFrame,
    anchors: DataFrame | None = None,
    encoded: bool = True,
    folder: str | None = None,
    user_agent: str = rb.USER_AGENT,
    buckets: int = 16,
    block: int = fr.BLOCK,
) -> CrawlRun:
    """Run all crawls over their captured responses.

    ``anchors`` may add links beyond those in the HTML (crawl_id, url, capture_id,
    base_href, pos, href). ``encoded`` tells whether bodies still carry their
    content encoding. Tables that are read more than once are written below
    ``folder``, by default a new folder in the cluster's shared one. ``buckets``
    (a power of two) sets how finely the links are laid out; use about one per gigabyte
    of links. ``block``: see ``expand``.
    """
    folder = folder or shared_folder(responses.sparkSession)
    gates, prefixes = gate_crawls(policies, robots, folder, user_agent)
    parsed = parse_responses(responses, gates, folder, encoded)
    slim = parsed.drop("title", "text", "base_href", "hrefs", "content_sha256", "title_missing", "text_truncated")
    outcomes = written(first_captures(classify(slim)), f"{folder}/outcomes")
    links = written(_decided(parsed, anchors, outcomes.where(F.col("kind") == "document")), f"{folder}/links")
    frontier = fr.expand(gates.where(may_start()), prefixes, fr.edges(links, outcomes), folder, buckets, block)
    records = written(fr.crawl_records(frontier, outcomes, parsed, gates), f"{folder}/records")
    reached = written(fr.reached_documents(frontier, outcomes), f"{folder}/reached")
    ends = reached.where(F.col("redirect_to").isNull()).select("crawl_id", F.col("url").alias("src_url"), "capture_id")
    followed = links.join(ends, ["crawl_id", "src_url", "capture_id"], "left_semi")
    exclusions = written(fr.link_exclusions(frontier, followed, reached), f"{folder}/exclusions")
    states = rp.run_states(rp.run_totals(gates, frontier, records, exclusions))
    return CrawlRun(
        gates, outcomes, frontier, records, exclusions, states, rp.reports(states, records, exclusions),
        refused(validate(with_defaults(policies))),
    )
