"""Page-text job: title, text, anchors and hash of every HTML document, in one narrow pass."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagetab.functions.batches import BATCH_BYTES, batch_limits, column, frugal
from pagetab.functions.html import scan_page
from pagetab.functions.reuse import reusable
from pagetab.functions.text import content_sha256, is_longer, limited
from pagetab.functions.urls import normalize_url, refusal, resolve_url

_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s\"';]+)", re.I)

_PAGE_FIELDS = [
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("base_href", T.StringType()),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
]


def _decoded(body: str | bytes, content_type: str | None) -> str:
    if isinstance(body, str):
        return body
    stated = _CHARSET.search(content_type or "")
    try:
        name = codecs.lookup(stated[1]).name if stated else "utf-8"
        return body.decode(name, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def extract_pages(df: DataFrame, source: str = "body", content_type: str | None = None) -> DataFrame:
    """Replace the HTML column ``source`` by title, text, base_href and hrefs.

    Rows with a null source get nulls. Each record batch is handled where it was
    read: there is no shuffle, the other columns pass through as Arrow data, and
    the HTML is dropped here so that no later exchange carries it.
    """
    batch_limits(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != source]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = batch.column(content_type) if content_type else [None] * batch.num_rows
            start, held, pages = 0, 0, []
            for i, (body, kind) in enumerate(zip(batch.column(source), types, strict=True)):
                html = body.as_py()
                pages.append((None,) * 4 if html is None else scan_page(_decoded(html, kind.as_py() if content_type else None)))
                held += 0 if html is None else len(html)
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(n).slice(start, len(pages)) for n in names]
                        + [column(v, k) for v, k in zip(zip(*pages, strict=True), kinds, strict=True)],
                        names + [f.name for f in _PAGE_FIELDS],
                    )
                    start, held, pages = i + 1, 0, []

    return df.mapInArrow(frugal(run), T.StructType(kept + _PAGE_FIELDS))


def with_document_columns(pages: DataFrame, max_text_chars: Column) -> DataFrame:
    """Add the hash of the whole text, the limited text and the two flags of a document row."""
    text = F.col("text")
    return pages.withColumns({
        "title_missing": F.col("title") == "",
        "content_sha256": content_sha256(text),
        "text_truncated": is_longer(text, max_text_chars),
        "text": limited(text, max_text_chars),
    })


def link_rows(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per anchor with its position; needs url, base_href and hrefs."""
    return pages.select(*keys, "url", "base_href", F.posexplode("hrefs").alias("pos", "href"))


@reusable
def page_base(url: Column, base_href: Column) -> Column:
    """The URL against which the links of a page are resolved."""
    return F.when(F.coalesce(base_href, F.lit("")) == "", url).otherwise(resolve_url(url, F.trim(base_href)))


def decide_links(links: DataFrame, allowed_origin: str) -> DataFrame:
    """Resolve and admit every anchor: adds target, url (admitted) and reason (refused)."""
    reason = refusal(F.col("normal"), F.col(allowed_origin))
    return (
        links.withColumn("base", page_base("url", "base_href"))
        .withColumn("target", resolve_url("base", "href"))
        .withColumn("normal", normalize_url("target"))
        .withColumnRenamed("url", "src_url")
        .withColumn("reason", reason)
        .select(
            *[c for c in links.columns if c not in ("url", "base_href")],
            "src_url", "target", F.when(F.col("reason").isNull(), F.col("normal")).alias("url"), "reason",
        )
    )
