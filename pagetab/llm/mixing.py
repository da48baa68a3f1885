"""Mix sources to target token totals by entropy balancing, with DataFrame functions only.

A document of ``size`` tokens gets the rate ``min(cap, exp(tilt * size / mean))``,
where ``mean`` is the mean size of its source and ``tilt`` the source's
multiplier. These rates stay as close as possible, in relative entropy, to taking
every document once while every source meets its target and no document exceeds
``cap`` times. The multipliers solve the convex dual by Newton steps, all sources
at once: a step is one grouped sum over the table of (source, size, count), kept
between bounds that each step narrows. Sums are taken over decimals, so that
reruns agree to the last bit.

Rates become copies by systematic rounding along cells of at most a few hundred
documents of one source and one size: running totals, summed up level by level, are rounded per cell, and in
a cell the documents with the smallest hash take the copies left over. A source
with a third of all documents, or a size that a third of them share, is spread
over many cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetab.llm.common import SPACES, dropped, scratch, stored

#: Documents of one cell, about, and cells of one block.
CELL, CELLS = 256, 1024
#: Largest relative miss of a source's target at which steps end, and the most steps; halving alone needs fewer.
CLOSE, STEPS = 1e-6, 100
_BOUND = 60.0
_EXACT = "decimal(38,9)"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACES}]+", "")
    parts = F.split(trimmed, f"[{SPACES}]+")
    return F.when(F.length(trimmed) == 0, 0).otherwise(
        F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs).

    Sources in code point order, null last, take ``weights`` in turn and share the
    sum of all sizes; a target stops at ``cap`` times its source's size and what is
    over goes to the others by weight, until none is above. In the end every target
    is ``min(cap * size, weight * level)``: in order of ``cap * size / weight`` a
    first part of the sources is full, the rest share what is left. One row per
    source is windowed as a whole, nothing else.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, weights))
    w = F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w.cast("double")).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    ranked = Window.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), "source")
    whole, before = Window.partitionBy(), ranked.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the first source that its share does not fill sets the level
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") < F.col("full"))
    set_by = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(set_by.isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("w") * set_by))
    return rows.select("source", "source_size", "docs", target.alias("target"))


def _rate(tilt: Column, z: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(tilt * z, F.lit(50.0))))


def tilts(spark: SparkSession, sizes: DataFrame, targets: DataFrame, cap: int, folder: str) -> DataFrame:
    """(source, tilt): multipliers of the dual. ``sizes``: (source, size, n). Null tilt: every rate is ``cap``."""
    z = F.col("size") * F.col("docs") / F.col("source_size")
    state = targets.where("source_size > 0").withColumns({
        "full": F.col("target") >= cap * F.col("source_size") * (1 - 1e-12),
        "tilt": F.lit(0.0), "low": F.lit(-_BOUND), "high": F.lit(_BOUND), "done": F.lit(False),
    })
    state, at = stored(state, f"{folder}/tilt-0"), f"{folder}/tilt-0"
    for step in range(1, STEPS + 1):
        active = state.where("NOT full AND NOT done")
        rate = _rate(F.col("tilt"), z, cap)
        sums = (
            sizes.join(active, sizes["source"].eqNullSafe(active["source"])).select(
                active["source"].alias("key"),
                (F.col("n") * F.col("size") * rate).cast(_EXACT).alias("f"),
                F.when(rate < cap, F.col("n") * F.col("size") * z * rate).otherwise(0.0).cast(_EXACT).alias("d"),
            ).groupBy("key").agg(F.sum("f").cast("double").alias("f"), F.sum("d").cast("double").alias("d"), F.lit(True).alias("summed"))
        )
        miss = F.col("f") - F.col("target")
        low = F.when(miss <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.nullif(F.col("d"), F.lit(0.0))
        fresh = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = F.abs(miss) <= CLOSE * F.col("target")
        moved = state.join(sums, state["source"].eqNullSafe(sums["key"]), "left").select(
            "source", "source_size", "docs", "target", "full",
            F.when(F.col("summed") & ~done, fresh).otherwise(F.col("tilt")).alias("tilt"),
            F.when(F.col("summed"), low).otherwise(F.col("low")).alias("low"),
            F.when(F.col("summed"), high).otherwise(F.col("high")).alias("high"),
            F.coalesce(F.when(F.col("summed"), done), F.col("done")).alias("done"),
        )
        path = f"{folder}/tilt-{step}"
        state = stored(moved, path)
        dropped(spark, at)
        at = path
        if state.where("NOT full AND NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"targets are not met to {CLOSE} after {STEPS} steps")
    return state.select("source", "docs", "source_size", F.when(~F.col("full"), F.col("tilt")).alias("tilt"), "full")


def running(cells: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` up to and with each cell, in the order of size and cell within its source.

    Cells are summed in blocks, blocks within their size, sizes within their source, so that
    no task has more of a source than its distinct sizes, its blocks of one size, or one block. Sums are
    of decimals and exact. ``cells`` should be a table, as it is read once for each level.
    """
    part = "decimal(34,9)"
    source, size = ["none", "source"], ["none", "source", "size"]
    blocked = cells.withColumn("_v", value.cast("decimal(28,9)")).withColumn("_block", F.floor(F.col("cell") / CELLS))
    blocks = blocked.groupBy(*size, "_block").agg(F.sum("_v").alias("_b"))
    sizes = blocks.groupBy(*size).agg(F.sum("_b").cast(part).alias("_s"))

    def before(column: str, keys: list[str], order: str) -> Column:
        return (F.sum(column).over(Window.partitionBy(*keys).orderBy(order)) - F.col(column)).cast(part)

    sizes = sizes.select(*size, before("_s", source, "size").alias("_sizes"))
    blocks = blocks.withColumn("_b", F.col("_b").cast(part)).select(*size, "_block", before("_b", size, "_block").alias("_blocks"))
    inside = F.sum("_v").over(Window.partitionBy(*size, "_block").orderBy("cell")).cast(part)
    return (
        blocked.withColumn("_cells", inside).join(blocks, [*size, "_block"]).join(sizes, size)
        .withColumn(name, F.col("_sizes") + F.col("_blocks") + F.col("_cells")).drop("_v", "_block", "_sizes", "_blocks", "_cells")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", cell: int = CELL,
) -> DataFrame:
    """One row per row of ``docs``: (id, h, size, source_size, target, rate, copies).

    ``size`` is the number of words (0 for a null text), ``copies`` (0 to ``cap``)
    the number of times the mix takes the document, ``h`` a hash of id and text.
    Null sources are a source of their own. Documents without words have rate and
    copies 1: they cost nothing. A source without words has target 0. Rows that
    agree in id, text and source are exchangeable, so ties change nothing in the
    result. A very long text is one document of many words. Null ids are kept as rows. Other columns are not read. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "mix")
    text = F.col(text_col).cast("string")
    light = stored(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("text")).select(
            "id", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"),
            word_count(F.col("text")).alias("size"), F.xxhash64("id", "text").alias("h")), f"{folder}/light")
    sizes = stored(
        light.groupBy(F.when(~F.col("none"), F.col("source")).alias("source"), "size").agg(F.count(F.lit(1)).alias("n")), f"{folder}/sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    targets = stored(source_targets(totals, weights, cap), f"{folder}/targets")
    tilt = tilts(spark, sizes, targets, cap, folder)
    z = F.col("size") * F.col("docs") / F.col("source_size")
    rate = F.when(F.col("full"), float(cap)).otherwise(_rate(F.col("tilt"), z, cap))
    rates = stored(
        sizes.join(tilt.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key"))).where("size > 0").select(
            F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "size",
            F.round(rate, 9).cast("decimal(20,9)").alias("rate"), F.ceil(F.col("n") / cell).cast("int").alias("cells")),
        f"{folder}/rates")
    key = ["none", "source", "size"]
    # a stored table, so that the documents of one size can be dealt out by cell
    celled = stored(
        light.where("size > 0").join(rates, key).withColumn("cell", F.expr("pmod(h, cells)").cast("int")).drop("cells"), f"{folder}/celled")
    counts = stored(celled.groupBy(*key, "cell").agg(F.count(F.lit(1)).alias("m"), F.first("rate").alias("rate")), f"{folder}/counts")
    share = (F.col("m") * F.col("rate")).cast("decimal(28,9)")
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    rounded = running(counts, share, "end").select(*key, "cell", "m", (whole(F.col("end")) - whole(F.col("end") - share)).alias("take"))
    rounded = stored(rounded, f"{folder}/rounded")
    # what rounding leaves of a source's target goes to, or comes from, its shortest documents
    given = rounded.groupBy("none", "source").agg(F.sum(F.col("take") * F.col("size")).alias("given"))
    goal = targets.select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), F.round("target").cast("long").alias("goal"))
    goal = goal.join(given, ["none", "source"]).select("none", "source", (F.col("goal") - F.col("given")).alias("left"))
    slots = F.when(F.col("left") > 0, F.least(F.col("m"), cap * F.col("m") - F.col("take"))).otherwise(F.least("m", "take"))
    slotted = stored(rounded.join(goal, ["none", "source"]).withColumn("slots", slots), f"{folder}/slotted")
    spent = F.col("upto").cast("long") - F.col("slots") * F.col("size")
    moved = F.greatest(F.lit(0), F.least(F.col("slots"), F.floor((F.abs("left") - spent) / F.col("size"))))
    cells = stored(
        running(slotted, F.col("slots") * F.col("size"), "upto")
        .select(*key, "cell", "m", (F.col("take") + F.signum("left").cast("long") * moved).alias("take")), f"{folder}/cells")
    place = F.row_number().over(Window.partitionBy(*key, "cell").orderBy("h", "id"))
    copies = F.floor(F.col("take") / F.col("m")) + F.when(F.col("place") <= F.col("take") % F.col("m"), 1).otherwise(0)
    picked = celled.withColumn("place", place).join(cells, [*key, "cell"]).select(
        "id", "h", "none", "source", "size", F.col("rate").cast("double").alias("rate"), copies.cast("long").alias("copies"))
    wordless = light.where("size = 0").select(
        "id", "h", "none", "source", "size", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    per = targets.select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target")
    dropped(spark, *(f"{folder}/{x}" for x in ("sizes", "rates", "counts", "rounded", "slotted")))
    return picked.unionByName(wordless).join(per, ["none", "source"]).select(
        "id", "h", "size", "source_size", "target", "rate", "copies")
