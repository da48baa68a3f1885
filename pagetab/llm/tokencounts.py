"""Token counts with a cache of digests.

A count depends on the text as the tokenizer sees it and on the tokenizer. The cache
is a Parquet table of (version, digest, n_tokens): the digest of the tokenizer's file
and library, the digest of the normalised text, the count. Digests of a table's texts
are joined with it; of the texts that it lacks, one per digest is encoded, and their
counts are appended. A second run over the same texts encodes nothing, and texts that
occur often are encoded once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetab.llm.common import dropped, resource_path, scratch, slices, stored, tidied

SCHEMA = "version string, digest binary, n_tokens long"
#: Missing digests, of 32 bytes each, up to which they are broadcast to pick their texts before any shuffle.
FEW = 100_000
#: Texts, and their bytes, that are handed to the tokenizer at a time.
_TEXTS, _BYTES = 64, 1 << 20


def tokenizer_version(path: str) -> str:
    """SHA-256 of a tokenizer's file and of the name and version of the library that runs it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        found = hashlib.sha256(f.read())
    found.update(f"\n{library} {metadata.version(library)}".encode())
    return found.hexdigest()


@functools.cache
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts, without added tokens; a worker keeps the tokenizer for its next tasks."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def normalised(text: Column, path: str) -> Column:
    """The text as far as the tokenizer tells texts apart; null is empty.

    A model that writes a space as U+2581 counts both alike.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    if not path.endswith(".model"):
        return text
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    alike = pieces.normalize("a b▁c d") == pieces.normalize("a▁b c▁d")
    return F.replace(text, F.lit(" "), F.lit("▁")) if alike else text


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one version; a cache that is not there yet is empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    table = spark.read.schema(SCHEMA).parquet(cache) if there else spark.createDataFrame([], SCHEMA)
    return table.where(F.col("version") == version).select("digest", "n_tokens")


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in slices(batches, _TEXTS):
            found, some, held = [], [], 0
            for text in batch.column(1):
                some.append(text.as_py())
                held += len(some[-1])
                if held >= _BYTES:
                    found += count(some)
                    some, held = [], 0
            found += count(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(tidied(run), "digest binary, n_tokens long")


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id",
    text_col: str = "text", few: int = FEW,
) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_tokens, over_limit); ``cache`` is the path of the cache, made if absent.

    Whole texts are counted as the tokenizer's library gives them, without begin, end
    or added tokens, truncation or padding; special strings inside texts are handled as
    its default does. A null text is empty (0 bytes, the count of an empty text). Rows
    that repeat are counted alike, null ids are kept, other columns are not read, and
    an empty table gives an empty table. A very long text is one call of the library.
    Two runs that append at the same time may both store a digest; it is read once.

    Counts are kept by 256-bit digests, so that equal digests are taken for equal texts.
    Texts cross the network once, and only one per missing digest and task.
    """
    spark, path = docs.sparkSession, resource_path(tokenizer)
    version, folder = tokenizer_version(path), scratch(docs.sparkSession, "tokens")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(normalised(F.col(text_col), path), 256))
    rows = stored(
        docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), f"{folder}/rows")
    asked = stored(rows.select("digest").distinct(), f"{folder}/asked")
    missing = stored(asked.join(_cached(spark, cache, version), "digest", "left_anti"), f"{folder}/missing")
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(digest.alias("digest"), text.alias("text"))
        if n_missing <= few:  # a checked size: the texts of known digests stay where they are
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        one = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if few < n_missing < asked.count():
            one = one.join(missing, "digest", "left_semi")
        encode_misses(one, path).select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy(
            "version").parquet(cache)
    counts = _cached(spark, cache, version).join(asked, "digest", "left_semi").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    counts = stored(counts, f"{folder}/counts")
    dropped(spark, f"{folder}/asked", f"{folder}/missing")
    return rows.join(counts, "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
