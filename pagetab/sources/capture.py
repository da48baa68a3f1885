"""Readers and adapters for the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagetab.functions.urls import normalize_url, request_url, url_origin


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_pages(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) pages, from one pass over ``pages``.

    Both are parts of one table below ``folder``: usable ones have ``normal`` and
    ``crawl_id`` as ``located_pages`` adds them, rejected ones a ``reason``: no_url, or invalid_or_sensitive_url.
    """
    normal = F.col("normal")
    reason = F.when(F.col("url").isNull(), F.lit("no_url")).when(normal.isNull(), F.lit("invalid_or_sensitive_url"))
    judged = pages.withColumn("normal", normalize_url("url")).withColumns({
        "crawl_id": url_origin("normal"), "reason": reason, "usable": normal.isNotNull()})
    judged.write.mode("errorifexists").partitionBy("usable").parquet(folder)
    table = pages.sparkSession.read.schema(judged.schema).parquet(folder)
    return table.where("usable").drop("usable", "reason"), table.where("NOT usable").drop("usable", "normal", "crawl_id")


def located_pages(pages: DataFrame) -> DataFrame:
    """Add normal (normalised URL) and crawl_id (its origin) to a table of page_id, url, html; ``split_pages`` keeps what this leaves out."""
    return (
        pages.withColumn("normal", normalize_url("url"))
        .withColumn("crawl_id", url_origin("normal"))
        .where(F.col("normal").isNotNull())
    )


def as_responses(pages: DataFrame) -> DataFrame:
    """Read a page table as captured responses: status 200, HTML, nothing encoded."""
    return located_pages(pages).select(
        "crawl_id",
        F.col("page_id").alias("capture_id"),
        request_url("normal").alias("url"),
        F.lit(200).alias("http_status"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.lit(None).cast("string").alias("content_encoding"),
        F.lit(None).cast("string").alias("location"),
        F.col("html").cast("binary").alias("body"),
        F.expr("timestamp_seconds(1704067200 + page_id)").alias("fetched_at"),
        F.lit(None).cast("string").alias("error_type"),
    )
