"""Sort responses into record kinds and resolve redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagetab.functions.urls import admit, resolve_url

# Media types read as HTML, and media types other than text/* read as text.
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml")
TEXT_TYPES = (
    "application/json",
    "application/xml",
    "application/atom+xml",
    "application/rdf+xml",
    "application/rss+xml",
    "application/javascript",
    "application/x-javascript",
    "application/x-json",
)

# Types that say nothing about the content.
GENERIC_TYPES = ("application/octet-stream", "unknown/unknown")

# Names recorded for responses that could not be used.
BAD_ENCODING = "IgnoreRequest"
BODY_TOO_LARGE = "DownloadCancelledError"
NOT_CAPTURED = "NotCaptured"


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def stated_type(content_type: Column, url: Column) -> Column:
    """Media type of a response: a missing or generic one is told by the URL's extension.

    ``.html``, ``.htm``, ``.xhtml`` and a last part without extension stand for HTML,
    ``.txt`` for text; other extensions leave the type unknown. Bodies are not looked at.
    """
    kind = media_type(content_type)
    path = F.regexp_replace(url, r"[?#][\s\S]*\z", "")
    name = F.lower(F.regexp_extract(path, r"\Ahttps?://[^/]*(?:/[^/]*)*?/?([^/]*)\z", 1))
    extension = F.regexp_extract(name, r"\.([^.]*)\z", 1)
    told = F.when(extension.isin("", "html", "htm", "xhtml"), F.lit(HTML_TYPES[0])).when(extension == "txt", F.lit("text/plain"))
    return F.when(F.coalesce(kind, F.lit("")).isin("", *GENERIC_TYPES), told).otherwise(kind)


def is_html(kind: Column) -> Column:
    """``kind``: a media type, see ``stated_type``."""
    return F.coalesce(kind.isin(*HTML_TYPES), F.lit(False))


def is_plain_text(kind: Column) -> Column:
    """Text, but not HTML."""
    return F.coalesce((kind.startswith("text/") & ~kind.isin(*HTML_TYPES)) | kind.isin(*TEXT_TYPES), F.lit(False))


def has_residual(residual_encoding: Column) -> Column:
    """True when an encoding is left that nothing here could undo."""
    return F.coalesce(F.trim(residual_encoding) != "", F.lit(False))


def download_error(max_body_bytes: Column) -> Column:
    """Why a response counts as a failed download, or null.

    Needs error_type, body_bytes, decoded_bytes, decode_error and residual_encoding.
    """
    return (
        F.when(F.col("error_type").isNotNull(), F.col("error_type"))
        .when(F.col("body_bytes") > max_body_bytes, F.lit(BODY_TOO_LARGE))
        .when(F.col("decoded_bytes") > max_body_bytes, F.lit(BAD_ENCODING))
        .when(F.col("decode_error").isNotNull(), F.col("decode_error"))
        .when(has_residual(F.col("residual_encoding")), F.lit(BAD_ENCODING))
    )


def response_kind(status: Column, content_type: Column, url: Column) -> Column:
    """redirect, http_error, unsupported_content or document, tested in this order."""
    return (
        F.when(status.between(300, 399), F.lit("redirect"))
        .when(~status.between(200, 299), F.lit("http_error"))
        .when(~is_html(stated_type(content_type, url)), F.lit("unsupported_content"))
        .otherwise(F.lit("document"))
    )


def may_be_document(df: DataFrame) -> Column:
    """True for rows worth parsing: nothing known before the policy's size limit rules them out."""
    return (
        (response_kind(F.col("http_status"), F.col("content_type"), F.col("url")) == "document")
        & F.col("error_type").isNull()
        & F.col("decode_error").isNull()
        & ~has_residual(F.col("residual_encoding"))
    )


def classify(responses: DataFrame) -> DataFrame:
    """Outcome of every response: kind, redirect and error columns.

    ``responses`` carries the policy's max_body_bytes and allowed_origin on each row.
    """
    error = F.col("download_error")
    kind = F.when(error.isNotNull(), F.lit("download_error")).otherwise(
        response_kind(F.col("http_status"), F.col("content_type"), F.col("url"))
    )
    is_redirect = F.col("kind") == "redirect"
    located = F.coalesce(F.col("location"), F.lit("")) != ""
    decided = (
        responses.withColumn("download_error", download_error(F.col("max_body_bytes")))
        .withColumn("kind", kind)
        .withColumn("resolved", F.when(is_redirect & located, resolve_url("url", "location")))
        .withColumn(
            "target",
            F.when(is_redirect & located, admit("resolved", "allowed_origin")),
        )
    )
    status = (
        F.when(is_redirect & ~located, F.lit("missing_location"))
        .when(is_redirect, F.coalesce(F.col("target.reason"), F.lit("in_scope")))
    )
    failed = F.col("kind") == "download_error"
    return decided.select(
        "crawl_id", "capture_id", "url", "kind",
        F.when(~failed, F.col("http_status")).alias("http_status"),
        F.when(~failed, F.col("fetched_at")).alias("fetched_at"),
        status.alias("redirect_status"),
        F.when(is_redirect, F.col("target.url")).alias("redirect_to"),
        F.col("download_error").alias("error_type"),
        F.when(~failed, F.col("decode_truncated")).alias("decode_truncated"),
    )


def first_captures(outcomes: DataFrame) -> DataFrame:
    """One outcome per crawl and URL, with the number of its captures: that with the lowest capture_id.

    The minimum is aggregated before the shuffle, so a URL captured very often
    costs one row per input task.
    """
    rest = [c for c in outcomes.columns if c not in ("crawl_id", "url")]
    return (
        outcomes.groupBy("crawl_id", "url")
        .agg(F.min_by(F.struct(*rest), "capture_id").alias("first"), F.count(F.lit(1)).alias("captures"))
        .select("crawl_id", "url", "first.*", "captures")
    )
