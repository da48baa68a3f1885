"""Audits of a request ledger against the limits of its crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagetab.functions.urls import admit
from pagetab.sources.shared import shared_folder, written

_MICROS = 1_000_000


def scope_violation(allowed_origin: str) -> Column:
    """First rule a request breaks (its admission reason, method, cookie, authorization), or null."""
    return (
        F.coalesce(
            admit("url", allowed_origin)["reason"],
            F.when(~F.col("method").eqNullSafe("GET"), F.lit("method")),
            F.when(F.coalesce(F.col("cookie"), F.lit("")) != "", F.lit("cookie")),
            F.when(F.coalesce(F.col("authorization"), F.lit("")) != "", F.lit("authorization")),
        )
    )


def scope_violations(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests that should not have been made, with the rule they break.

    A request of a crawl that has no policy breaks the rule ``no_policy``.
    """
    known = policies.select("crawl_id", "allowed_origin", F.lit(True).alias("_known"))
    scoped = requests.join(known, "crawl_id", "left")
    rule = F.when(F.col("_known").isNull(), F.lit("no_policy")).otherwise(scope_violation("allowed_origin"))
    return (
        scoped.withColumn("violation", rule)
        .where(F.col("violation").isNotNull())
        .drop("allowed_origin", "_known")
    )


def laid_out(requests: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """The ledger as a table in ``parts`` (by default the shuffle partitions) ranges of about equal row count.

    Ranges follow crawl, time and request_id, so that a crawl of any share of the
    rows, or a single busy second of it, is spread over as many ranges as its rows fill. Adds ``_micros``
    and the number of the range, ``_part``.
    """
    parts = parts or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = requests.withColumn("_micros", F.round(F.col("time") * _MICROS).cast("bigint"))
    ranged = timed.repartitionByRange(parts, "crawl_id", "_micros", "request_id")
    return written(ranged.withColumn("_part", F.spark_partition_id()), f"{folder}/ledger")


def request_gaps(requests: DataFrame, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Add ``gap`` in seconds to the previous request of the same crawl (by time, then request_id).

    The ledger is sorted within ranges of equal row count (see ``laid_out``), a table below ``folder``, by
    default the cluster's shared one. The first request of a crawl in a range takes the
    last time of the crawl's range before, found among one row per crawl and range.
    """
    ledger = laid_out(requests, folder or shared_folder(requests.sparkSession), parts)
    keys = ["crawl_id", "_part"]
    edges = (
        ledger.groupBy(*keys).agg(F.max("_micros").alias("_last"))
        .withColumn("_carried", F.lag("_last").over(W.partitionBy("crawl_id").orderBy("_part")))
        .drop("_last")
    )
    inside = F.lag("_micros").over(W.partitionBy(*keys).orderBy("_micros", "request_id"))
    return (
        ledger.withColumn("_inside", inside).join(edges, keys)
        .withColumn("gap", (F.col("_micros") - F.coalesce("_inside", "_carried")) / F.lit(_MICROS))
        .drop("_micros", "_part", "_inside", "_carried")
    )


def spacing_violations(requests: DataFrame, delays: DataFrame) -> DataFrame:
    """Requests sent sooner after the one before than their crawl's effective delay."""
    return request_gaps(requests).join(delays, "crawl_id").where(F.col("gap") < F.col("effective_delay"))


def ledger_reconcile(reports: DataFrame, requests: DataFrame, blocked: DataFrame) -> DataFrame:
    """Per crawl: attempts reported against requests logged, repeated and blocked requests.

    ``reports`` has crawl_id and http_attempts, ``requests`` crawl_id and url,
    ``blocked`` crawl_id and url of what the robots file forbids.
    """
    per_url = requests.groupBy("crawl_id", "url").agg(F.count(F.lit(1)).alias("n"))
    forbidden = blocked.select("crawl_id", "url").distinct().withColumn("forbidden", F.lit(True))
    logged = (
        per_url.join(forbidden, ["crawl_id", "url"], "left").groupBy("crawl_id")
        .agg(
            F.sum("n").alias("logged"),
            F.count_if(F.col("n") > 1).alias("repeated_urls"),
            F.count_if(F.coalesce("forbidden", F.lit(False))).alias("blocked_requested"),
        )
    )
    zero = F.lit(0).cast("bigint")
    filled = {c: F.coalesce(c, zero) for c in ("http_attempts", "logged", "repeated_urls", "blocked_requested")}
    return (
        reports.select("crawl_id", F.col("http_attempts").cast("bigint").alias("http_attempts"))
        .join(logged, "crawl_id", "full_outer")
        .withColumns(filled)
        .withColumn(
            "consistent",
            (F.col("http_attempts") == F.col("logged")) & (F.col("repeated_urls") == 0) & (F.col("blocked_requested") == 0),
        )
    )
