"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Every vector has a home cell, that of the centroid with the largest inner product.
A pair of unit vectors with cosine at least ``threshold`` is at most
``sqrt(2 - 2 * threshold)`` apart, so a vector whose partner may live in another
cell lies within that distance of the plane between the two centroids. Such
vectors visit the other cell too, if its number is lower than their home's. Every
pair within reach so meets in exactly one cell, and links are found exactly,
whatever the centroids are. These are fitted on a bounded sample. Cells are cut
into blocks, and a task multiplies one pair of blocks, so that no task holds a
whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetab.llm.common import components, dropped, scratch, stored

#: Vectors of the sample that the centroids are fitted on.
SAMPLE = 8192
#: Rows of a block; two blocks and their products are what a task holds.
BLOCK = 1024
MOST_CELLS = 256
#: Allowance for rounding when a visit is decided; links are decided by the cosine alone.
_SLACK = 1e-9


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large and very small components."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """``k`` unit centroids (fewer if rows are fewer) by Lloyd's rounds on inner products."""
    start = np.random.default_rng(seed).permutation(len(units))[: min(k, len(units))]
    centroids = units[np.sort(start)].copy()
    for _ in range(rounds):
        nearest = (units @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            total = units[nearest == c].sum(axis=0)
            length = np.sqrt((total * total).sum())
            if length > 1e-12:  # an empty or balanced cell keeps its centroid
                centroids[c] = total / length
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the given pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        fresh = label.copy()
        np.minimum.at(fresh, u, least)
        np.minimum.at(fresh, v, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str | None = "label", block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component, kept).

    Vectors of one label (of all, without ``label_col``) and one length link when
    their cosine is at least ``threshold``, which must be over 0. ``n_links``
    counts other rows linked directly, ``component`` is the smallest id reachable,
    ``kept`` marks the row with that id. Rows with a null label, a null or empty
    vector, a zero vector or a null or non-finite component link with nothing: they
    have no links and are their own component. Equal vectors are compared once and
    counted as often as they occur. Null ids never name a component. Other columns
    are not read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    folder = scratch(spark, "vectors")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = stored(
        rows.where(usable).groupBy("label", "v").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
        .withColumn("uid", F.monotonically_increasing_id()), f"{folder}/classes")
    widths = classes.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).orderBy(F.desc("n"), "dim").limit(16).collect()
    centroids = {}
    for w in widths:  # lengths beyond the 16 most frequent have one cell each
        cells = min(MOST_CELLS, -(-w["n"] // (w["labels"] * block)))
        if cells > 1:
            drawn = classes.where(F.size("v") == w["dim"]).orderBy(F.xxhash64("v"), "v").limit(sample).select("v").collect()
            centroids[w["dim"]] = spherical_kmeans(unit_rows(np.array([r["v"] for r in drawn])), cells)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(uid, cell, home) for the home cell of each vector and for each cell that it visits."""
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            uid, cell, home = [], [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                ids = batch.column(0).to_numpy()[at]
                if dim not in centroids:
                    uid.append(ids), cell.append(np.zeros(len(at), np.int32)), home.append(np.ones(len(at), bool))
                    continue
                c = centroids[dim]
                dots = unit_rows(_matrix(batch.column(1).take(pa.array(at)))) @ c.T
                own = dots.argmax(axis=1)
                gap = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0))
                far = dots[np.arange(len(at)), own][:, None] - dots
                near = (far <= (reach + _SLACK) * gap[own] + _SLACK) & (np.arange(len(c))[None] < own[:, None])
                r, k = np.nonzero(near)
                uid += [ids, ids[r]]
                cell += [own.astype(np.int32), k.astype(np.int32)]
                home += [np.ones(len(at), bool), np.zeros(len(r), bool)]
            if uid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (uid, cell, home)], names=["uid", "cell", "home"])

    placed = classes.select("uid", "v").mapInArrow(visits, "uid long, cell int, home boolean")
    placed = stored(
        placed.join(classes.select("uid", "label", "v", "size"), "uid").withColumn("dim", F.size("v")), f"{folder}/placed")
    key = ["label", "dim", "cell"]
    blocks = stored(placed.groupBy(*key).agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("hs"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("ps"),
    ).where("hs > 0"), f"{folder}/blocks")
    tiled = placed.join(blocks, key).withColumn("b", F.expr("pmod(xxhash64(uid), if(home, hs, ps))").cast("int"))
    # a task is a pair of home blocks (i <= j), or a home block j and a block i of visitors, numbered from hs on
    tasks = F.expr("""
        if(home,
           concat(transform(sequence(0, hs - 1), o -> struct(greatest(o, b) AS j, least(o, b) AS i)),
                  if(ps > 0, transform(sequence(0, ps - 1), o -> struct(b AS j, hs + o AS i)), array())),
           transform(sequence(0, hs - 1), o -> struct(o AS j, hs + b AS i)))""")
    tiled = tiled.withColumn("t", F.explode(tasks)).select(*key, "t.i", "t.j", "uid", "home", "b", "size", "v")

    def compare(table: pa.Table) -> pa.Table:
        """Links of one pair of blocks: weighted counts per vector and a spanning forest of the links."""
        table = table.combine_chunks()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x = unit_rows(_matrix(table["v"].combine_chunks()))
        uid, size = table["uid"].to_numpy(), table["size"].to_numpy()
        home, b = table["home"].to_numpy(zero_copy_only=False), table["b"].to_numpy()
        right = np.flatnonzero(home & (b == j))
        left = right if i == j else np.flatnonzero(home & (b == i)) if home.all() else np.flatnonzero(~home)
        counts, us, vs = np.zeros(len(x), np.int64), [], []
        for at in range(0, len(left), BLOCK):
            l = left[at: at + BLOCK]
            for to in range(0, len(right), BLOCK):
                r = right[to: to + BLOCK]
                p, q = np.nonzero(x[l] @ x[r].T >= threshold)
                p, q = l[p], r[q]
                if i == j:
                    p, q = p[p < q], q[p < q]
                np.add.at(counts, p, size[q])
                np.add.at(counts, q, size[p])
                root = _spanning(p, q, len(x))
                moved = np.flatnonzero(root != np.arange(len(x)))
                us.append(moved), vs.append(root[moved])
        met = np.flatnonzero(counts)
        u, v = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (us, vs))
        return pa.table({
            "u": np.concatenate([uid[met], uid[u]]),
            "v": pa.array(np.concatenate([uid[met], uid[v]])),
            "n": np.concatenate([counts[met], np.zeros(len(u), np.int64)]),
        })

    found = stored(tiled.groupBy(*key, "i", "j").applyInArrow(compare, "u long, v long, n long"), f"{folder}/found")
    roots = stored(components(found.where("u <> v").select("u", "v"), folder).withColumnRenamed("node", "uid"), f"{folder}/roots")
    links = found.where("n > 0").groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("n"))
    named = stored(
        classes.join(links, "uid", "left").join(roots, "uid", "left")
        .select("label", "v", "least", F.coalesce("root", "uid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")),
        f"{folder}/named")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component")), f"{folder}/least")
    member = stored(named.join(least, "root").select("label", "v", "n_links", "component"), f"{folder}/member")
    dropped(spark, *(f"{folder}/{x}" for x in ("classes", "placed", "blocks", "found", "roots", "named", "least")))
    out = rows.withColumn("usable", usable).join(member.withColumn("met", F.lit(True)), ["label", "v"], "left")
    component = F.when(F.col("met"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
