"""Helpers of this subpackage: folders for intermediate tables, words, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; ``bytes.split()`` cuts at the same six characters.
SPACES = "\\x20\\x09-\\x0D"


@functools.cache
def _own_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="pagetab-llm-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a session without that setting that runs inside one process (tests, a
    notebook) gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _own_root(context.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a written table: later steps don't recompute it, and lost executors don't lose it."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows: what a task makes of a batch is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_HELD: list = []


def held(cache):
    """Mark a cached function whose results a worker holds between tasks, until a task comes that does not use them."""
    _HELD.append(cache)
    return cache


def let_go(uses: tuple = ()) -> None:
    """Empty the marked caches of this worker, but those in ``uses``."""
    for cache in _HELD:
        if cache not in uses:
            cache.cache_clear()


def tidied(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: tuple = ()
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving its memory back when it ends: Spark keeps a worker for later tasks, next to an executor that needs the room.

    Before it begins, the worker lets go of what earlier tasks held, but for the caches in ``uses``.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(uses)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return tidy


def resource_path(name_or_path: str) -> str:
    """Path of a public tokenizer file: a path as it is, a bare file name below the installed vocabularies."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Connected components of undirected ``edges`` (u long, v long).

    Returns (node, root): every node of an edge with the smallest node that it
    reaches. Alternates large-star and small-star steps, each a grouped minimum
    and a join, until nothing changes; the number of steps grows with the
    logarithm of the longest chain. Every step is a table in ``folder``. Minima
    are stored before they are joined, so that both sides of a join are plain
    exchanges and a node with very many edges can be split. Null ends and loops
    are left out; an empty table gives an empty table.
    """
    spark, step = edges.sparkSession, 0

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{folder}/{name}-{step}"
        return stored(df, path), path

    mark = (F.count(F.lit(1)), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0L)"))
    # u > v throughout
    pairs, at = keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = tuple(pairs.agg(*mark).first())
    while before[0]:
        step += 1
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_at = keep(
            both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").withColumnRenamed("u", "v"), "least"
        )
        large, large_at = keep(
            pairs.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large"
        )
        down, down_at = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1"), "down")
        moved = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stay = large.join(down, "u", "left").where("m IS NULL OR v = m").select("u", "v")
        small, small_at = keep(stay.unionByName(moved).distinct(), "small")
        after = tuple(small.agg(*mark).first())
        dropped(spark, at, least_at, large_at, down_at)
        pairs, at = small, small_at
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("u"), "v").distinct()
    return pairs.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
