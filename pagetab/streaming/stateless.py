"""Page transforms without state: the same code for a table and for a stream of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetab.functions.urls import normalize_url, request_url, url_origin
from pagetab.operators.bodies import decode_bodies
from pagetab.operators.classify import classify, download_error, may_be_document, response_kind
from pagetab.operators.pages import decide_links, extract_pages, link_rows, with_document_columns
from pagetab.operators.policies import DEFAULTS
from pagetab.sources import schemas


def read_captures(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of captured responses from a folder of Parquet files."""
    return spark.readStream.schema(schemas.RESPONSES).option("maxFilesPerTrigger", max_files).parquet(path)


def parsed_captures(responses: DataFrame, max_body_bytes: Column | None = None) -> DataFrame:
    """Decode and parse every response; adds allowed_origin, the origin of the response itself, and max_body_bytes."""
    limit = F.lit(DEFAULTS["max_body_bytes"]) if max_body_bytes is None else max_body_bytes
    located = responses.withColumn("normal", normalize_url("url")).withColumn("allowed_origin", url_origin("normal"))
    located = located.withColumns({"url": request_url("normal"), "max_body_bytes": limit}).drop("normal")
    bodies = decode_bodies(located, F.col("max_body_bytes"))
    return extract_pages(bodies.withColumn("body", F.when(may_be_document(bodies), F.col("body"))), "body", "content_type")


def capture_outcomes(parsed: DataFrame) -> DataFrame:
    """Kind, redirect and error columns of parsed captures."""
    return classify(parsed)


def _documents(parsed: DataFrame) -> DataFrame:
    """The captures that count as documents: what failed, or is too large, has neither a document row nor links."""
    kind = response_kind(F.col("http_status"), F.col("content_type"), F.col("url"))
    return parsed.where(download_error(F.col("max_body_bytes")).isNull() & (kind == "document") & F.col("text").isNotNull())


def capture_documents(parsed: DataFrame, max_text_chars: Column | None = None) -> DataFrame:
    """Document columns of the captures that hold HTML."""
    limit = F.lit(DEFAULTS["max_text_chars"]) if max_text_chars is None else max_text_chars
    pages = _documents(parsed).select("crawl_id", "capture_id", "url", "fetched_at", "title", "text")
    return with_document_columns(pages, limit)


def capture_links(parsed: DataFrame) -> DataFrame:
    """Resolved and admitted (or refused) links of parsed captures."""
    return decide_links(link_rows(_documents(parsed), "crawl_id", "capture_id", "allowed_origin"), "allowed_origin").drop("allowed_origin")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to a Parquet table, exactly once across restarts."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
