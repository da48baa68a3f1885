"""Body-decode job: undo content encodings, batch by batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagetab.functions.batches import BATCH_BYTES, batch_limits, column, frugal
from pagetab.functions.codecs import decode_body

_ADDED = [
    T.StructField("body", T.BinaryType()),
    T.StructField("residual_encoding", T.StringType()),
    T.StructField("decoded_bytes", T.LongType()),
    T.StructField("decode_error", T.StringType()),
    T.StructField("decode_truncated", T.BooleanType()),
]


def decode_bodies(df: DataFrame, limit: Column) -> DataFrame:
    """Decode ``body`` by ``content_encoding``.

    Adds body_bytes (as received), residual_encoding, decoded_bytes (largest
    size met while decoding, 0 when nothing was encoded), decode_error and
    decode_truncated (a damaged tail was dropped after good data). ``limit`` is the
    row's own body limit: nothing is expanded further than one byte past it. A null
    limit expands nothing that is encoded. A batch ends at ``BATCH_BYTES`` decoded bytes, as
    many small bodies may grow to much more than they take compressed.
    """
    batch_limits(df.sparkSession)
    sized = df.withColumns({
        "body_bytes": F.octet_length("body").cast("bigint"), "_limit": F.coalesce(limit, F.lit(0)).cast("bigint"),
    })
    kept = [f for f in sized.schema.fields if f.name not in ("body", "content_encoding", "_limit")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column("body"), batch.column("content_encoding"), batch.column("_limit"))
            start, held, rows = 0, 0, []
            for i, values in enumerate(zip(*columns, strict=True)):
                rows.append(decode_body(*(v.as_py() for v in values)))
                held += len(rows[-1][0] or b"")
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    added = zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(n).slice(start, len(rows)) for n in names] + [column(v, k) for v, k in added],
                        names + [f.name for f in _ADDED],
                    )
                    start, held, rows = i + 1, 0, []

    return sized.mapInArrow(frugal(run), T.StructType(kept + _ADDED))


def plain_bodies(df: DataFrame) -> DataFrame:
    """The same columns for bodies stored without any encoding applied; a stated encoding stays residual."""
    return df.select(
        "*",
        F.octet_length("body").cast("bigint").alias("body_bytes"),
        F.col("content_encoding").alias("residual_encoding"),
        F.lit(0).cast("bigint").alias("decoded_bytes"),
        F.lit(None).cast("string").alias("decode_error"),
        F.lit(False).alias("decode_truncated"),
    ).drop("content_encoding")
