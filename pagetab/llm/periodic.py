"""Periodic runs of words, by synchronising sets.

A run of period q repeats its first q words twice or more. Periods below ``DIRECT`` are
found by comparing the text with itself shifted. Longer ones are searched for scale by
scale, periods of Q up to 2Q together:

* seeds are Q / 2 consecutive words; every window of Q words elects the seed with the
  smallest hash (the first of equals). The election depends on the window's words only, so
  equal windows elect equal places: where a run repeats, both places are elected.
* elected places whose seeds are equal and that lie Q to 2Q apart propose a period.
* seeds that have a period of a third of their length or less would be elected in
  crowds and are left out. They lie in runs that smaller scales have found.
  Where no seed is left, a whole period lies in such a run; its
  repetition lies in the next run of the same small period, and the two runs propose the
  periods at which they match.
* a proposal is extended word by word to both sides, so hashes decide nothing.

Many texts are searched as one sequence, with a sign of its own between any two.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetab.llm.common import slices, tidied

#: Periods below it are compared directly; a multiple of 4 that is 24 at least, so that seeds have 12 words.
DIRECT = 24
#: Words of the shortest run.
LEAST = 12
#: Words of texts that are searched together.
_WORDS = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extended(t: np.ndarray, left: int, right: int, q: int) -> tuple[int, int]:
    """The widest [left, right) where words equal those q further; the given one is known to."""
    end, step = len(t) - q, 32
    while right < end:
        stop = min(right + step, end)
        differ = t[right:stop] != t[right + q: stop + q]
        if differ.any():
            right += int(differ.argmax())
            break
        right, step = stop, step * 2
    step = 32
    while left > 0:
        start = max(left - step, 0)
        differ = t[start:left] != t[start + q: left + q]
        if differ.any():
            left -= int(differ[::-1].argmax())
            break
        left, step = start, step * 2
    return left, right


def _direct(t: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all runs of a small period."""
    differ = np.concatenate([[-1], np.flatnonzero(t[:-q] != t[q:]), [len(t) - q]])
    gap = np.diff(differ) - 1
    hit = gap >= max(LEAST, 2 * q) - q
    start = differ[:-1][hit] + 1
    return start, start + gap[hit] + q


def _elected(h: np.ndarray, usable: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash in each window of so many usable seeds, the first of equals."""
    h = np.where(usable, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    at, width = np.arange(len(h)), 1
    while 2 * width <= window:
        a, b = at[:-width], at[width:]
        at, width = np.where(h[a] <= h[b], a, b), 2 * width
    if width < window:
        a, b = at[: len(at) - (window - width)], at[window - width:]
        at = np.where(h[a] <= h[b], a, b)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at[usable[at]]


def _proposed(h: np.ndarray, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of elected places with equal seeds, ``scale`` up to twice as far apart."""
    hashes = h[places]
    order = np.lexsort((places, hashes))
    hashes, places = hashes[order], places[order]
    xs, qs, j = [], [], 1
    while j < len(places):
        apart = places[j:] - places[:-j]
        near = (hashes[j:] == hashes[:-j]) & (apart < 2 * scale)
        if not near.any():
            break
        take = near & (apart >= scale)
        xs.append(places[:-j][take])
        qs.append(apart[take])
        j += 1
    return np.concatenate([*xs, np.zeros(0, np.int64)]), np.concatenate([*qs, np.zeros(0, np.int64)])


def _meeting(t: np.ndarray, runs: list[tuple[int, int]], p: int) -> Iterator[tuple[int, int, int]]:
    """(left, right, period) of what neighbouring runs of period p have in common when one is shifted onto the other."""
    for (a1, b1), (a2, b2) in zip(runs, runs[1:], strict=False):
        if a2 > b1 or min(b1 - a1, b2 - a2) < 6 * p:
            continue
        whole, part = t[a2: a2 + 2 * p].tobytes(), t[a1: a1 + p].tobytes()
        d = whole.find(part)
        while d >= 0 and d % t.itemsize:
            d = whole.find(part, d + 1)
        if d < 0:
            continue
        shift = a2 - a1 + d // t.itemsize
        most, least = min(b1 - a1, b2 - a2), max(DIRECT, 6 * p)
        for q in range(least + (shift - least) % p, most + 1, p):
            left, right = max(a1, a2 - q), min(b1, b2 - q)
            if right - left >= q:
                yield left, right, q


def periodic_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each sequence of word numbers: its runs (start, length, period), by start and period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    t = np.empty(int((lengths + 1).sum()), np.int32)
    for k, i in enumerate(order):
        t[starts[k]: starts[k] + lengths[k]] = texts[i]
        t[starts[k] + lengths[k]] = -1 - k
    found: dict[tuple[int, int], int] = {}

    def reach(least: int) -> int:
        """Where the texts of at least so many words end; they come first."""
        n = int(np.searchsorted(-lengths, -least, side="right"))
        return int(starts[n - 1] + lengths[n - 1] + 1) if n else 0

    for q in range(1, DIRECT):
        if end := reach(max(LEAST, 2 * q)):
            for a, b in zip(*(x.tolist() for x in _direct(t[:end], q)), strict=True):
                found.setdefault((a, b), q)
    longest = int(lengths[0]) if len(texts) else 0
    if 2 * DIRECT <= longest:
        _long_periods(t, found, reach, longest)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, b), q in found.items():
        k = int(np.searchsorted(starts, a, side="right")) - 1
        out[order[k]].append((a - int(starts[k]), b - a, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _long_periods(t: np.ndarray, found: dict[tuple[int, int], int], reach, longest: int) -> None:
    """Add the runs of periods from ``DIRECT`` on to ``found``."""
    end = reach(2 * DIRECT)
    h = _mixed(t[:end].astype(np.uint64) + np.uint64(_BASE))
    back = pow(_BASE, -1, 1 << 64)
    inverse = np.cumprod(np.full(end, back, np.uint64), dtype=np.uint64)
    total = np.zeros(end + 1, np.uint64)
    np.cumsum(h * (np.cumprod(np.full(end, _BASE, np.uint64), dtype=np.uint64)), dtype=np.uint64, out=total[1:])
    waiting: list[tuple[int, int, int]] = []  # (period, left, right)

    def meet(periods: range) -> None:
        runs: dict[int, list[tuple[int, int]]] = {}
        for (a, b), p in found.items():
            if p in periods and b - a >= max(DIRECT, 6 * p):
                runs.setdefault(p, []).append((a, b))
        for p, some in runs.items():
            waiting.extend((q, left, right) for left, right, q in _meeting(t, sorted(some), p))

    meet(range(1, DIRECT))
    scale = DIRECT
    while 2 * scale <= longest:
        end = reach(2 * scale)
        size = scale // 2
        n = end - size + 1
        seeds = _mixed((total[size: end + 1] - total[:n]) * inverse[:n])
        mark = np.zeros(n + 1, np.int32)
        for (a, b), p in found.items():
            if 3 * p <= size <= b - a and a < n:
                mark[a] += 1
                mark[min(b - size + 1, n)] -= 1
        places = _elected(seeds, np.cumsum(mark[:n]) == 0, scale - size + 1)
        x, q = _proposed(seeds, places, scale)
        asked = list(zip(q.tolist(), x.tolist(), x.tolist(), strict=True))
        asked += [w for w in waiting if scale <= w[0] < 2 * scale]
        text, last = t[:end], (0, 0, 0)
        for period, left, right in sorted(asked):
            if period == last[0] and last[1] <= left < last[2]:
                continue
            left, right = _extended(text, left, right, period)
            last = (period, left, right)
            if right - left >= period:
                # of a run's periods that divide one another the smallest is its own
                found[(left, right + period)] = min(period, found.get((left, right + period), period))
        meet(range(scale, 2 * scale))
        scale *= 2


def looped(n: int, h: int) -> np.ndarray:
    """Numbers of the words of a text of n words whose end is made periodic by its key's CRC-32 ``h``, if 10 divides it."""
    at = np.arange(n)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


_OUT = pa.schema([
    *((n, pa.int64()) for n in ("n_words", "n_runs", "start", "length", "period")), ("runs", pa.list_(pa.int64())),
    ("runs_sha256", pa.string()), ("collapsed", pa.string()),
])


def find_runs(docs: DataFrame, loop: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_runs, start, length, period, runs, runs_sha256, collapsed).

    A run is a stretch of words with smallest period q, at least ``LEAST`` and 2q long, that
    no neighbouring word extends. ``runs`` lists start, length and period of each, by
    start, then period; ``start``, ``length`` and ``period`` are those of the longest (ties:
    smallest start, then period), null without any. ``runs_sha256`` is of a line for each run.
    ``collapsed`` has the words that no run contains after its first q words, joined by one space.
    With ``loop``, the end of one text in ten, by the CRC-32 of its id, is made
    periodic first (a known repetition to find again).

    Words end at ASCII white space. Texts that are null or empty have no words and no run.
    A very long text is searched whole, by one task, in memory of about 60 bytes a word.
    Rows that repeat give equal rows, null ids are kept (their key is empty), other columns
    are not read, and an empty table gives an empty table.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"))
    names = ["id", *_OUT.names]

    def searched(ids: list[pa.Array], words: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        out = []
        for own, at, runs in zip(words, numbers, periodic_runs([x[1] for x in numbers]), strict=True):
            kept = np.ones(len(at[0]), bool)
            for start, length, period in runs:
                kept[start + period: start + length] = False
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
            out.append({
                "n_words": len(kept), "n_runs": len(runs), "start": start, "length": length, "period": period,
                "runs": [x for r in runs for x in r], "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
                "collapsed": b" ".join([own[i] for i in at[0][kept].tolist()] if at[2] or not kept.all() else own),
            })
        columns = [pa.array([r[f.name] for r in out], pa.binary() if f.name == "collapsed" else f.type) for f in _OUT]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns[:-1], columns[-1].cast(pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, numbers, known, held = [], [], [], _Numbers(), 0
        for batch in slices(batches):
            for i, (text, key) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True)):
                own = (text.as_py() or b"").split()
                number = np.fromiter(map(known.__getitem__, own), np.int32, len(own))
                h = zlib.crc32(key.encode()) if loop else 1
                at = looped(len(own), h)
                ids.append(batch.column(0).slice(i, 1))
                words.append(own)
                numbers.append((at, number[at], h % 10 == 0))
                held += len(own) + 1
                if held >= _WORDS:
                    yield searched(ids, words, numbers)
                    ids, words, numbers, known, held = [], [], [], _Numbers(), 0
        if ids:
            yield searched(ids, words, numbers)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidied(run), (
        f"id {kind}, n_words long, n_runs long, start long, length long, period long, runs array<long>, runs_sha256 string, collapsed string"))
