"""Roll-ups of a run: counts, stop reason, status, one report row per crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagetab.functions.text import utc_iso

# Record kinds that make a crawl incomplete.
INCOMPLETE_KINDS = ("http_error", "download_error", "robots_error", "blocked_robots", "unsupported_content")
SCHEMA_VERSION = 1
TOOL = "pagetab"


def record_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("crawl_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _count_map(counts: DataFrame, key: str, name: str) -> DataFrame:
    """One map per crawl; there are only a few kinds and reasons, so the maps are small."""
    entries = F.array_sort(F.collect_list(F.struct(key, "n")))
    return counts.groupBy("crawl_id").agg(F.map_from_entries(entries).alias(name))


def run_totals(gates: DataFrame, frontier: DataFrame, records: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per crawl: attempts, remaining candidates and the facts that decide stop reason and status."""
    queue = frontier.groupBy("crawl_id").agg(
        F.count_if(F.col("processed") & ~F.col("blocked") & ~F.col("aborts")).alias("document_attempts"),
        F.count_if(~F.col("processed")).alias("remaining_candidates"),
        F.max("aborts").alias("aborted"),
    )
    out_of_scope = F.coalesce(F.col("redirect_status") != "in_scope", F.lit(False))
    facts = records.groupBy("crawl_id").agg(
        F.count_if(F.col("kind") == "document").alias("documents"),
        F.count_if(F.col("kind").isin(*INCOMPLETE_KINDS) | out_of_scope).alias("problems"),
    )
    full = exclusions.where(F.col("reason") == "max_candidates").select("crawl_id", F.lit(True).alias("capped"))
    zero = F.lit(0).cast("bigint")
    return (
        gates.join(queue, "crawl_id", "left").join(facts, "crawl_id", "left").join(full, "crawl_id", "left")
        .withColumns({
            "document_attempts": F.coalesce("document_attempts", zero),
            "remaining_candidates": F.coalesce("remaining_candidates", zero),
            "documents": F.coalesce("documents", zero),
            "problems": F.coalesce("problems", zero),
            "aborted": F.coalesce("aborted", F.lit(False)),
            "capped": F.coalesce("capped", F.lit(False)),
        })
        .withColumn("http_attempts", F.col("document_attempts") + 1)
    )


def stop_reason() -> Column:
    """Why a crawl ended; the request limit is tested before the page limit."""
    return (
        F.when(F.col("robots_status") == "unavailable", F.lit("robots_unavailable"))
        .when(F.col("effective_delay").isNull(), F.lit("robots_delay_exceeds_limit"))
        .when(F.col("aborted"), F.lit("download_scope_violation"))
        .when((F.col("remaining_candidates") > 0) & (F.col("http_attempts") >= F.col("max_requests")), F.lit("max_requests"))
        .when(F.col("remaining_candidates") > 0, F.lit("max_pages"))
        .when(F.col("capped"), F.lit("max_candidates"))
        .otherwise(F.lit("frontier_exhausted"))
    )


def run_status() -> Column:
    """failed without a document, partial with any shortfall, else complete_within_scope."""
    return (
        F.when(F.col("documents") == 0, F.lit("failed"))
        .when((F.col("stop_reason") != "frontier_exhausted") | (F.col("problems") > 0), F.lit("partial"))
        .otherwise(F.lit("complete_within_scope"))
    )


def run_states(totals: DataFrame) -> DataFrame:
    return totals.withColumn("stop_reason", stop_reason()).withColumn("status", run_status())


def reports(states: DataFrame, records: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The report row of every crawl; records stay in their own table.

    A run lasts from the first to the last of its responses; without any it has no times.
    """
    times = records.groupBy("crawl_id").agg(
        utc_iso(F.min("fetched_at")).alias("started_at"), utc_iso(F.max("fetched_at")).alias("finished_at"))
    kinds = _count_map(record_counts(records), "kind", "record_counts")
    reasons = _count_map(exclusions, "reason", "excluded_link_counts")
    empty = F.create_map().cast("map<string,bigint>")
    policy = F.struct(
        "start_url", "allowed_origin", "max_pages", "max_requests", "max_candidates", "max_body_bytes",
        "max_text_chars", "delay", "timeout", "allow_loopback",
    )
    return (
        states.join(kinds, "crawl_id", "left").join(reasons, "crawl_id", "left").join(times, "crawl_id", "left")
        .select(
            "crawl_id",
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.lit(TOOL).alias("tool"),
            "status", "stop_reason",
            policy.alias("policy"),
            "robots_status",
            F.col("robots_delay").alias("robots_crawl_delay"),
            "http_attempts", "document_attempts", "remaining_candidates",
            F.coalesce("record_counts", empty).alias("record_counts"),
            F.coalesce("excluded_link_counts", empty).alias("excluded_link_counts"),
            "started_at", "finished_at",
        )
    )


def run_summaries(report_rows: DataFrame) -> DataFrame:
    """Report rows without the policy, as printed at the end of a run."""
    return report_rows.drop("policy")


def report_json(report_rows: DataFrame) -> DataFrame:
    """crawl_id and the report as one line of JSON."""
    rest = [c for c in report_rows.columns if c != "crawl_id"]
    return report_rows.select("crawl_id", F.to_json(F.struct(*rest)).alias("report"))
