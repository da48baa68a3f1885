"""Schemas of the input tables and of the record table."""

from __future__ import annotations

POLICIES = (
    "crawl_id string, start_url string, allowed_origin string, max_pages int, max_requests int, "
    "max_candidates int, max_body_bytes int, max_text_chars int, delay double, timeout double, "
    "allow_loopback boolean"
)

# capture_id orders the captures of one URL; the lowest one counts.
RESPONSES = (
    "crawl_id string, capture_id bigint, url string, http_status int, content_type string, "
    "content_encoding string, location string, body binary, fetched_at timestamp, error_type string"
)

ROBOTS = (
    "crawl_id string, http_status int, content_type string, content_encoding string, "
    "body string, error_type string"
)

REQUESTS = (
    "crawl_id string, url string, path string, method string, time double, "
    "cookie string, authorization string"
)

MANIFEST = "path string, bytes bigint, sha256 string"

EXPECTED = (
    "name string, status string, exit int, requests bigint, documents bigint, "
    "stop_reason string, document_hash string"
)

RECORDS = (
    "crawl_id string, seq bigint, kind string, url string, discovered_from string, depth int, "
    "http_status int, fetched_at timestamp, title string, title_missing boolean, text string, "
    "text_truncated boolean, content_sha256 string, redirect_status string, redirect_to string, "
    "error_type string, phase string"
)
