"""Text columns: white space, limits, hashes, spreadsheet guard, UTC time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space: ASCII white space, the
# four ASCII separators, next line, and all Unicode separators.
WHITE_SPACE = r"[\s\x1C-\x1F\x{85}\p{Z}]+"


def clean_text(value: Column) -> Column:
    """Collapse every run of white space to one space and trim both ends."""
    return F.trim(F.regexp_replace(value, WHITE_SPACE, " "))


def limited(text: Column, max_chars: Column) -> Column:
    """The first ``max_chars`` code points, for output columns with a stated limit."""
    return F.substring(text, F.lit(1), max_chars)


def is_longer(text: Column, max_chars: Column) -> Column:
    return F.length(text) > max_chars


def content_sha256(text: Column) -> Column:
    """Hex SHA-256 of the whole text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def csv_guard(value: Column) -> Column:
    """Make a cell safe for spreadsheets: formula-like cells get a leading quote, null is empty."""
    cell = F.coalesce(value, F.lit(""))
    return F.when(cell.rlike(r"\A[ \t\r\n\x{feff}]*[=+@\-]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def python_bool(flag: Column) -> Column:
    """True / False as CSV exports spell them."""
    return F.initcap(flag.cast("string"))


def utc_iso(ts: Column) -> Column:
    """ISO-8601 text of a timestamp in UTC; the fraction is left out when it is zero."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(utc, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit("+00:00"))
