"""Spelling variants: words that differ by one edit, grouped under their most frequent form.

Words at distance one agree before the edit and after it. A block therefore holds the
words of two neighbouring lengths that agree up to some place and after another, and
an edit between the two places joins words of one block only. Blocks of too many words
are cut into two with narrower places, as often as needed, so that no block grows with
the vocabulary.

Within a block the words stand sorted, and the edit matrix of a query and the list is
computed in rows, one for each character of the list's words. A band of three cells
holds all distances up to one. Neighbours in the list share the rows of their longest
common prefix, so a row is computed once for each range of words that share it, for
all queries at once; a range whose row exceeds one edit is left out with all its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetab.llm.common import dropped, scratch, slices, stored, tidied

#: Words of a block beyond which it is cut.
BLOCK = 512
#: Different words that a task counts before it passes them on.
_MOST_WORDS = 1 << 18
#: Rows, cells of their characters, and pairs of queries and words that are looked at together.
_ROWS, _CELLS, _PAIRS = 1 << 15, 1 << 22, 1 << 21


def word_counts(
    docs: DataFrame, least_chars: int = 6, least_n: int = 5, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): runs of Latin letters of all whole texts, A-Z lowered, of enough characters and occurrences.

    With ``damage``, a run whose CRC-32 of ``<id>:<run>`` it divides loses the character
    at that number modulo the run's length (a known error to find again). Null texts
    have no words, a null id is written as nothing. Repeated rows count each time.
    """
    find = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars).findall

    def flushed(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        known = counts.get
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = find((text.as_py() or b"").lower().decode("utf-8", "replace"))
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word in words:
                    if damage:
                        h = zlib.crc32(word.encode(), start)
                        if not h % damage:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_chars:
                                continue
                    counts[word] = known(word, 0) + 1
                if len(counts) > _MOST_WORDS:
                    yield flushed(counts)
                    counts.clear()
        yield flushed(counts)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(tidied(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def pairs_within(chars: np.ndarray, lengths: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of words of one block at distance one; words are sorted within their blocks.

    ``chars`` has a row of code points for each word, with zeros after its end, one at least.
    """
    n, width = chars.shape
    wide = np.concatenate([chars, np.zeros((n, 2), chars.dtype)], axis=1)
    first = np.concatenate([[True], block[1:] != block[:-1]])
    of_block = np.cumsum(first) - 1
    sizes = np.bincount(of_block)[of_block]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // _PAIRS)) + 1, [n]])
    left, right = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        # a range has the words that share their first characters; rows of a query and a range: cells d - 1, d, d + 1
        new, starts = first, np.flatnonzero(first)
        q = np.arange(a, b)
        node = of_block[a:b]
        low, mid = np.full(b - a, 2, np.int8), np.zeros(b - a, np.int8)
        high = np.where(lengths[a:b] > 0, 1, 2).astype(np.int8)
        for d in range(width):
            new = new.copy()
            new[1:] |= chars[1:, d] != chars[:-1, d]
            inner = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            begin = np.searchsorted(inner, starts)
            many = (np.searchsorted(inner, ends) - begin)[node]
            rows = np.repeat(np.arange(len(q)), many)
            child = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + begin[node][rows]
            later = np.append(inner[1:], n)[child] > q[rows]
            rows, child = rows[later], child[later]
            c = chars[inner[child], d]
            over = c == 0
            if over.any():
                r, i = rows[over], inner[child[over]]
                apart = lengths[q[r]] - d
                hit = np.where(apart == 0, mid[r], np.where(apart == 1, high[r], np.where(apart == -1, low[r], 2))) == 1
                left.append(q[r[hit]])
                right.append(i[hit])
                rows, child, c = rows[~over], child[~over], c[~over]
            at, size = q[rows], lengths[q[rows]]
            r0, r1, r2 = low[rows], mid[rows], high[rows]
            n0 = np.minimum(r1 + 1, r0 + (wide[at, max(d - 1, 0)] != c))
            n0[d > size] = 2
            n1 = np.minimum(np.minimum(r2, n0) + 1, r1 + (wide[at, d] != c))
            n1[d + 1 > size] = 2
            n2 = np.minimum(n1 + 1, r2 + (wide[at, d + 1] != c))
            n2[d + 2 > size] = 2
            go = np.minimum(np.minimum(n0, n1), n2) <= 1
            q, node = at[go], child[go]
            low, mid, high = (np.minimum(x[go], 2).astype(np.int8) for x in (n0, n1, n2))
            starts = inner
            if not len(q):
                break
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def _near(words: list[str], n: np.ndarray, block: list[str], m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best) of whole blocks: how many near words each has there, and the foremost of them."""
    after = np.maximum(m - hi, 0)
    inner = [w[a: len(w) - z] for w, a, z in zip(words, lo.tolist(), after.tolist(), strict=True)]
    order = sorted(range(len(words)), key=lambda i: (block[i], inner[i]))
    inner = [inner[i] for i in order]
    lengths = np.fromiter(map(len, inner), np.int64, len(inner))
    width = int(lengths.max()) + 1
    chars = np.array(inner, dtype=f"U{width}").view(np.uint32).reshape(len(inner), width)
    keys = [block[i] for i in order]
    number = np.cumsum([False, *(a != b for a, b in zip(keys[1:], keys[:-1], strict=True))])
    u, v = pairs_within(chars, lengths, number)
    order = np.array(order)
    place = order[u]
    short = np.minimum(lengths[u], lengths[v]) == m[place] - lo[place] - after[place]
    # the edit is where the words first differ; other places of it are for other blocks
    here = (chars[u] != chars[v]).argmax(axis=1) < hi[place] - lo[place]
    u, v = order[u[short & here]], order[v[short & here]]
    if not len(u):
        return None
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((rank[v], -n[v], u))
    u, v = u[by], v[by]
    head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    many = np.diff(np.append(head, len(u)))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in u[head].tolist()], pa.string()), pa.array(many), pa.array(n[v[head]]),
         pa.array([words[i] for i in v[head].tolist()], pa.string())], names=["word", "n_near", "best_n", "best"])


def _keyed(rows: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi) with the key of its block: what words agree on before ``lo`` and after ``hi``."""
    after = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return rows.withColumn("key", F.concat_ws(
        ":", "m", "lo", "hi", F.expr("substring(word, 1, lo)"), F.when(after > 0, F.right("word", after)).otherwise(F.lit(""))))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row with the first and with the second half of its places for the edit."""
    middle = F.expr("lo + (hi - lo) div 2").cast("int")
    both = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    return rows.withColumn("half", F.explode(both)).select("word", "n", "m", "half.lo", "half.hi")


def near_words(words: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of (word, n): words at distance one, their number, and the foremost by n, then by code points.

    Words without any are left out. ``words`` has distinct, non-null words.
    """
    spark = words.sparkSession
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(lengths).alias("m")).where("m > 0").select(
        "word", "n", "m", F.lit(0).alias("lo"), (F.col("m") + 1).alias("hi"))
    ready, step = [], 0
    rows = _halves(rows)
    while True:
        at = [f"{folder}/{x}-{step}" for x in ("keyed", "sizes", "ready")]
        keyed = stored(_keyed(rows), at[0])
        sizes = keyed.groupBy("key", "m").agg(
            F.count(F.lit(1)).alias("size"), F.min(F.length("word")).alias("least"), F.first(F.col("hi") - F.col("lo")).alias("places"))
        sizes = stored(sizes.where((F.col("size") > 1) & (F.col("least") == F.col("m"))).select("key", "size", "places"), at[1])
        large = (F.col("size") > block) & (F.col("places") > 1)
        small = stored(keyed.join(sizes.where(~large).select("key"), "key"), at[2])
        ready.append(small)
        if sizes.where(large).isEmpty():
            break
        rows = _halves(keyed.join(sizes.where(large).select("key"), "key"))
        step += 1
    blocks = ready[0]
    for more in ready[1:]:
        blocks = blocks.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; whole blocks are looked at, some at a time."""
        held: list[list] = [[] for _ in range(6)]
        cells = 0

        def near(upto: int) -> Iterator[pa.RecordBatch]:
            key, word, n, m, lo, hi = (x[:upto] for x in held)
            for x in held:
                del x[:upto]
            found = _near(word, np.array(n), key, *(np.array(x) for x in (m, lo, hi))) if upto > 1 else None
            if found:
                yield found

        for batch in batches:
            last = held[0][-1] if held[0] else None
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    if len(held[0]) >= _ROWS or cells >= _CELLS:
                        yield from near(len(held[0]))
                        cells = 0
                    last = row[0]
                for x, y in zip(held, row, strict=True):
                    x.append(y)
                cells += row[5] - row[4] + 2
        yield from near(len(held[0]))

    sorted_blocks = blocks.select("key", "word", "n", "m", "lo", "hi").repartition("key").sortWithinPartitions("key")
    found = sorted_blocks.mapInArrow(tidied(run), "word string, n_near long, best_n long, best string")
    # the foremost: greatest n, then smallest word
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    found = stored(found, f"{folder}/found").groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    near = stored(found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")), f"{folder}/near")
    dropped(spark, f"{folder}/found", *(f"{folder}/{x}-{i}" for x in ("keyed", "sizes", "ready") for i in range(step + 1)))
    return near


def spelling_groups(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per word of (word, n): (word, form, root, n, n_near, form_n).

    Near words differ by one inserted, deleted or replaced character. ``form`` is the
    near word of greatest ``n`` (ties: the smallest by code points), if that is at
    least ``ratio`` (over one) times the word's own, else null. ``root`` is where forms lead: they grow
    in ``n``, so they end; a word without a form is its own root. Words must be
    distinct; null words are left out, an empty table gives an empty table, other columns are not
    read. Very long words cost their length in each of their blocks.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variants")
    spark, folder = words.sparkSession, scratch(words.sparkSession, "spelling")
    words = stored(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), f"{folder}/words")
    near = near_words(words, folder, block)
    has = F.col("best_n") >= ratio * F.col("n")
    named = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), f"{folder}/named")
    step, at = 0, f"{folder}/root-0"
    roots = stored(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), at)
    while True:  # the way doubles with each step, and n grows by the ratio on each part of it
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step, before, at = step + 1, at, f"{folder}/root-{step + 1}"
        nearer = stored(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), at)
        roots = nearer.select("word", "root")
        moved = not nearer.where("moved").isEmpty()
        dropped(spark, before)
        if not moved:
            break
    dropped(spark, f"{folder}/near")
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
