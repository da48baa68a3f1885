"""Near-duplicate documents by SimHash with pigeonhole blocks.

A fingerprint has 64 bits. Fingerprints that differ in at most ``distance`` bits
agree in at least ``BLOCKS - distance`` of ``BLOCKS`` blocks of bits, so each
distinct fingerprint is keyed by every choice of that many blocks, equal keys are
joined and the Hamming distance is verified. Keys that more than ``CROWD``
fingerprints share are not joined in pairs: their fingerprints are keyed by the
values one bit away. Two fingerprints at distance one or two have such a value in
common, two that have one in common are at most two bits apart, and at most 65
fingerprints share a value, so a crowd of any size gives all its links in work
that is linear in its fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetab.llm.common import components, dropped, scratch, stored

SEED = 42
BLOCKS = 5
#: Fingerprints of one key up to which pairs are joined; more take the other way, with the same links.
CROWD = 48
#: Shingles whose bits are counted at a time.
_SLICE = 1 << 15


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash of ``width``-word shingles, repeats counted; 0 without words.

    A-Z are lowered, words end at ASCII white space, and a text of fewer words is
    one shingle. A bit is set if it is set in over half of the XXH64 values.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, width = b" ".join(words), min(width, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[at: at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([fingerprint(x.as_py(), width) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("fp", T.LongType())]))


def _masks(distance: int) -> list[int]:
    """Signed masks of every choice of ``BLOCKS - distance`` blocks."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in itertools.combinations(blocks, BLOCKS - distance)]


def near_links(fps: DataFrame, folder: str, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect what links of at most ``distance`` (0 to 2) bits connect.

    ``fps`` has distinct, non-null longs in ``fp``. Every edge is a true link. Not
    every link is an edge, but linked fingerprints always share a component.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    masks = _masks(distance)
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("k.i", "k.key", "fp")
    shared = stored(keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{folder}/shared")
    met = stored(keyed.join(shared, ["i", "key"]), f"{folder}/met")
    few = met.where(F.col("n") <= crowd).select("i", "key", "fp")
    pairs = (
        few.join(few.withColumnRenamed("fp", "other"), ["i", "key"])
        .where("fp < other").where(F.expr(f"bit_count(fp ^ other) <= {distance}"))
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )
    crowded = met.where(F.col("n") > crowd).select("fp").distinct()
    # a value within one bit of both is shared by exactly those within two bits
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
    if distance == 2:
        balls = crowded.select("fp", F.explode(flips).alias("ball"))
        stars = (
            balls.groupBy("ball").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
            .select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v")
        )
    else:  # within one bit: a value that is itself a fingerprint
        balls = crowded.select(F.col("fp").alias("u"), F.explode(flips).alias("v")).where("u <> v")
        stars = balls.join(crowded.withColumnRenamed("fp", "v"), "v", "left_semi").select("u", "v")
        stars = stars if distance else stars.where("false")
    return pairs.unionByName(stars)


def simhash_groups(
    docs: DataFrame, width: int = 5, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD
) -> DataFrame:
    """One row per row of ``docs``: (id, fp, component, keep).

    ``component`` is the smallest id reachable over links of at most ``distance``
    bits, ``keep`` marks the row whose id it is. Texts that are null or have no
    word have fingerprint 0 and link like any other. Null ids are kept as rows and
    never name a component unless the whole component has none. Rows with an equal
    id and text are in one component. Other columns of ``docs`` are not read. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "simhash")
    rows = stored(fingerprints(docs, width, id_col, text_col), f"{folder}/rows")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), f"{folder}/classes")
    roots = stored(
        components(near_links(classes.select("fp"), folder, distance, crowd), folder).withColumnRenamed("node", "fp"),
        f"{folder}/roots",
    )
    named = stored(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), f"{folder}/named")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component")), f"{folder}/least")
    member = stored(named.join(least, "root").select("fp", "component"), f"{folder}/member")
    dropped(spark, *(f"{folder}/{x}" for x in ("classes", "shared", "met", "roots", "named", "least")))
    return rows.join(member, "fp").select(
        "id", "fp", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("keep")
    )
