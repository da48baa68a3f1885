"""Page transforms give the same rows on a stream as on a table, and only documents have documents and links."""

import gzip
from datetime import datetime

from pagetab.sources import schemas
from pagetab.sources.capture import as_responses, read_table
from pagetab.streaming.stateless import (
    capture_documents, capture_links, capture_outcomes, parsed_captures, read_captures, write_available,
)


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "captures")
    columns = [c.split()[0] for c in schemas.RESPONSES.split(", ")]
    as_responses(read_table(spark, "/root/testdata/sf0.001", "pages")).select(*columns).repartition(3).write.parquet(source)
    batch, stream = spark.read.schema(schemas.RESPONSES).parquet(source), read_captures(spark, source, max_files=1)
    for name, transform in [("documents", capture_documents), ("links", capture_links), ("outcomes", capture_outcomes)]:
        query = write_available(transform(parsed_captures(stream)), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        query.awaitTermination(120)
        got, want = spark.read.parquet(str(tmp_path / name)), transform(parsed_captures(batch))
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_only_documents_have_documents_and_links(spark, tmp_path):
    html = b'<title>t</title><main>text</main><a href="/next">n</a>'
    kinds = {
        "document": (200, "text/html", None, html, None), "too-large": (200, "text/html", None, html + b" " * 3_000_000, None),
        "too-large-unpacked": (200, "text/html", "gzip", gzip.compress(html + b" " * 3_000_000), None),
        "redirect": (302, "text/html", None, html, None), "error": (500, "text/html", None, html, None),
        "failed": (200, "text/html", None, html, "TimeoutError"), "coded": (200, "text/html", "compress", html, None),
        "packed": (200, "text/html", "gzip", gzip.compress(html), None), "image": (200, "image/png", None, html, None),
    }
    rows = [("c", n, f"https://e.com/{name}", status, kind, coding, None, body, datetime(2024, 1, 1), error)
            for n, (name, (status, kind, coding, body, error)) in enumerate(kinds.items())]
    source = str(tmp_path / "captures")
    spark.createDataFrame(rows, schemas.RESPONSES).write.parquet(source)
    for transform in (capture_documents, capture_links):
        name = transform.__name__
        query = write_available(transform(parsed_captures(read_captures(spark, source))), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        query.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.capture_id for r in got.collect()) == [list(kinds).index("document"), list(kinds).index("packed")]
    outcomes = {r.url.rpartition("/")[2]: r.kind for r in capture_outcomes(parsed_captures(spark.read.schema(schemas.RESPONSES).parquet(source))).collect()}
    assert {k for k, v in outcomes.items() if v == "document"} == {"document", "packed"}
