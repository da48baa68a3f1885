"""Repeated passages: seeds on winnowed anchors, extended both ways.

A window is ``window`` consecutive words. Word hashes are combined to hashes of
``SEED`` consecutive words, and every window elects the smallest of the seeds in
it (the first of equals): its anchor. Equal windows elect equal anchors at equal
places, so windows are compared only where anchors meet. An anchor occurrence
carries the hash of its whole surroundings, all words that any of its windows can
hold. The steps:

1. seed: occurrences are counted by anchor and surroundings, partly before the
   shuffle. Anchors seen once end here. Occurrences with equal surroundings repeat
   with all their windows: a match that already extends as far both ways as it can
   count.
2. extend: where one anchor has different surroundings, one occurrence of each is
   extended to the left and right in every way that its windows allow, and equal
   extensions are counted. A crowd of occurrences is a grouped count, never pairs.
3. words that a repeated window covers are marked, neighbours and overlaps joined
   to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetab.llm.common import dropped, scratch, slices, stored, tidied

#: Words of a seed; shorter windows have a seed of half their length.
SEED = 16
#: Odd multipliers of the rolling sums for seeds, surroundings and windows.
_SEED_BASE, _AROUND_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_MOST_WORDS = 1 << 18
_MASK = (1 << 64) - 1


class _WordHashes(dict):
    """XXH64 of words, remembered for as long as they are few enough to hold."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 11)
        if len(self) < _MOST_WORDS and len(word) < 64:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums P and inverse powers R with ``(P[b] - P[a]) * R[a]`` the same for equal words h[a:b] at any place."""
    n = len(h)
    power = np.cumprod(np.full(n + 1, base, np.uint64), dtype=np.uint64) * np.uint64(pow(base, -1, 1 << 64))
    back = np.cumprod(np.full(n + 1, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64) * np.uint64(base)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], dtype=np.uint64, out=total[1:])
    return total, back


def _spans(prefix: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total, back = prefix
    return _mixed((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))


def anchors(h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, hash) of each anchor: the seed's place and the first and last window that elect it."""
    span = window - seed + 1
    n = len(h) - window + 1
    at = np.arange(len(h) - seed + 1)
    seeds = _spans(_prefix(h, _SEED_BASE), at, at + seed)
    chosen = np.empty(n, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(seeds, span)
    for a in range(0, n, 1 << 16):  # the views are copied a slice at a time
        chosen[a: a + (1 << 16)] = views[a: a + (1 << 16)].argmin(axis=1)
    chosen += np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    place = chosen[first]
    return place, first, last, seeds[place]


def _around(h: np.ndarray, place: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Hash of all words within reach of an anchor, and of where the text ends within that reach."""
    reach = window - seed
    a, b = np.maximum(place - reach, 0), np.minimum(place + window, len(h))
    ends = (place - a).astype(np.uint64) * np.uint64(_WINDOW_BASE) + (b - place).astype(np.uint64)
    return _mixed(_spans(_prefix(h, _AROUND_BASE), a, b) ^ _mixed(ends))


def _hashed(words: list[bytes], known: _WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def repeated_spans(docs: DataFrame, window: int, folder: str) -> DataFrame:
    """(h, spans) from (h, text): half-open word ranges that repeated windows cover, sorted and maximal, per text hash.

    ``docs`` has one row per document; documents with an equal ``h`` must have equal texts.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    seed = SEED if window >= 2 * SEED else window // 2

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches):
            rows, gathered = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                if len(words) < window:
                    continue
                h = _hashed(words, known)
                place, first, last, anchor = anchors(h, window, seed)
                rows.append((np.full(len(place), doc), place, first, last, anchor.view(np.int64), _around(h, place, window, seed).view(np.int64)))
                gathered += len(place)
                if gathered >= 1 << 18:
                    yield _batch(rows)
                    rows, gathered = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["h", "place", "first", "last", "anchor", "around"]
        kinds = [np.int64, np.int32, np.int32, np.int32, np.int64, np.int64]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c).astype(k, copy=False)) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = docs.select("h", "text").mapInArrow(tidied(seeds), "h long, place int, first int, last int, anchor long, around long")
    found = stored(found, f"{folder}/found")
    # counted by surroundings, then by anchor: both sums start before their shuffle
    kinds = found.groupBy("anchor", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "place", "first", "last")).alias("one"))
    kinds = stored(kinds, f"{folder}/kinds")
    met = stored(
        kinds.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("ways")).where(F.col("all") > 1), f"{folder}/met")
    kinds = stored(kinds.join(met, "anchor"), f"{folder}/repeated")
    full = found.join(kinds.where("n > 1").select("anchor", "around"), ["anchor", "around"], "left_semi")
    full = full.select("h", "first", (F.col("last") + window).alias("last"))
    # one occurrence of each surroundings is extended: it stands for n of them
    ask = kinds.where("ways > 1").select("one.*", "n")
    asked = ask.groupBy("h").agg(F.collect_list(F.struct("place", "first", "last", "n")).alias("asked"))
    texts = docs.select("h", "text").dropDuplicates(["h"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of the anchors asked for: its hash, how many occurrences it stands for, and where it starts."""
        known = _WordHashes()
        for batch in batches:
            for doc, text, items in zip(
                batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True
            ):
                h = _hashed(text.as_py().split(), known)
                items = items.values
                place, first, last, n = (items.field(k).to_numpy() for k in ("place", "first", "last", "n"))
                many = last - first + 1
                start = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = start.astype(np.int64)
                a, b = _prefix(h, _WINDOW_BASE), _prefix(h, _SEED_BASE)
                yield pa.RecordBatch.from_arrays(
                    [_signed(_spans(a, start, start + window)), _signed(_spans(b, start, start + window)),
                     pa.array(np.repeat(n, many)), pa.array(np.full(len(start), doc)), pa.array(start.astype(np.int32))],
                    names=["w1", "w2", "n", "h", "start"])

    extended = texts.join(asked, "h").select("h", "text", "asked").mapInArrow(tidied(extend), "w1 long, w2 long, n long, h long, start int")
    extended = stored(extended, f"{folder}/extended")
    equal = stored(
        extended.groupBy("w1", "w2").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("ways"))
        .where((F.col("all") > 1) & (F.col("ways") > 1)).select("w1", "w2"), f"{folder}/equal")
    partial = extended.where("n = 1").join(equal, ["w1", "w2"], "left_semi")
    partial = partial.select("h", F.col("start").alias("first"), (F.col("start") + window).alias("last"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of one document, overlaps and neighbours united."""
        for batch in batches:
            out = []
            for items in batch.column(1):
                a, b = (items.values.field(k).to_numpy() for k in ("first", "last"))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                cut = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                out.append(np.stack([a[cut], b[np.concatenate([cut[1:], [len(b)]]) - 1]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["h", "spans"])

    spans = full.unionByName(partial).groupBy("h").agg(F.collect_set(F.struct("first", "last")).alias("all"))
    spans = stored(spans.mapInArrow(joined, "h long, spans array<int>"), f"{folder}/spans")
    dropped(docs.sparkSession, *(f"{folder}/{x}" for x in ("found", "kinds", "met", "repeated", "extended", "equal")))
    return spans


def drop_repeats(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_removed, spans, kept) and the columns in ``keep``.

    ``spans`` lists start and end of each maximal repeat, as word positions;
    ``kept`` is the text without their words, the others joined by one space. A
    word goes if a window of ``window`` words that covers it also starts anywhere
    else, in the same document too. All occurrences go, the first included; windows
    are judged on the input. Texts that are null, empty or shorter than a window
    lose nothing (``kept`` of a null text is empty). Rows with equal texts repeat
    each other, even if their ids agree. Null ids are kept as rows. Other columns
    are not read; ``keep`` may name any but the result's. An empty table gives an
    empty table.
    """
    folder = scratch(docs.sparkSession, "substrings")
    extra = [f for f in docs.schema.fields if f.name in keep]
    # columns to keep go by numbers, so that none clashes with those used here
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *(F.col(f.name).alias(f"k{i}") for i, f in enumerate(extra)))
    rows = rows.withColumn("h", F.xxhash64("text"))
    spans = repeated_spans(rows.select("h", "text"), window, folder)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, kept = [], [], []
            for text, ranges in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().split()
                ranges = ranges or []
                total.append(len(words))
                gone.append(sum(ranges[1::2]) - sum(ranges[::2]))
                stops = [0, *ranges, len(words)]
                kept.append(b" ".join([w for a, b in zip(stops[::2], stops[1::2], strict=True) for w in words[a:b]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column(2),
                 pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[3:]], names=names)

    kinds = [("id", rows.schema["id"].dataType.simpleString()), ("n_words", "long"), ("n_removed", "long"), ("spans", "array<int>"), ("kept", "string")]
    kinds += [(f.name, f.dataType.simpleString()) for f in extra]
    names = [n for n, _ in kinds]
    return rows.join(spans, "h", "left").select("id", "text", "spans", *(f"k{i}" for i in range(len(extra)))).mapInArrow(
        tidied(cut), ", ".join(f"`{n}` {k}" for n, k in kinds))
