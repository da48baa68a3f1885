"""Quality classifier: ordinal regression with cumulative links on graded ratings.

All grades share one linear score on hashed features of the text, and ordered
thresholds cut the score into grades: ``P(grade > k) = sigmoid(score - threshold k)``.
This gives an expected grade, and the tail probability of a grade or better, by
which documents are selected.

Features are the distinct words of a text, without punctuation and in lower case,
the distinct shapes of its words, the distinct runs of four characters of its long words (so that text
without white space has features of all its parts), and its shares of upper case, symbols, repeated
words and repeated lines in coarse steps, each hashed to 48 bits. The model is
fitted on a bounded sample of the rated documents: those with the smallest hashes
of their ids, each with at most ``MOST_FEATURES`` of its features, those with the smallest hashes.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetab.llm.common import slices, tidied

#: Rated documents that the model is fitted on, at most.
SAMPLE = 10_000
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 3
#: Features of a document that the model is fitted on, at most.
MOST_FEATURES = 4096
#: Words remembered with their features, at most.
_MOST_WORDS = 1 << 17
#: Bytes beyond which a word is long: not remembered, and taken apart.
_LONG = 64
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Capitals, digits and other letters (all bytes beyond ASCII count as such) to one sign each.
_SIGNS = bytes(
    65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def _hash(kind: bytes, value: bytes) -> int:
    return xxhash.xxh64_intdigest(value, kind[0]) >> 16


@functools.lru_cache(maxsize=1 << 14)
def _shape(signs: bytes) -> int:
    """Feature of a word's shape: runs of equal signs once."""
    return _hash(b"s", _RUNS.sub(rb"\1", signs))


def _grams(word: bytes) -> list[int]:
    """Features of a long word: its distinct runs of four characters."""
    c = np.frombuffer(word.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(c) - 3), np.uint64)
    for k in range(4):
        h = (h + c[k: len(c) - 3 + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (np.unique(h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(16)).tolist()


class _WordFeatures(dict):
    """The features of a word, those in ``within`` if that is given."""

    def __init__(self, within: dict | None = None):
        super().__init__()
        self.within = within

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        plain = word.strip(_EDGE)
        plain = plain.lower() if plain.isascii() else plain.decode("utf-8", "replace").lower().encode()
        if len(word) <= _LONG:
            found = (_hash(b"w", plain), _shape(word.translate(_SIGNS)))
        else:
            found = (_hash(b"w", plain), _shape.__wrapped__(word.translate(_SIGNS)), *_grams(plain))
        if self.within is not None:
            found = tuple(x for x in found if x in self.within)
        if len(word) <= _LONG:
            if len(self) >= _MOST_WORDS:
                self.clear()
            self[word] = found
        return found


def _step(part: int, whole: int) -> int:
    """0 for none, else steps that double from about 1 in 64."""
    return 0 if not part or not whole else max(1, 8 - int(math.log2(whole / part)))


def features(text: bytes, known: _WordFeatures) -> set[int]:
    """Hashed features of a whole text."""
    words = text.split()
    distinct = set(words)
    found: set[int] = set()
    for w in distinct:
        found.update(known[w])
    n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
    bare = len(text.translate(None, b" \t\n\r\x0b\x0c"))
    shares = {
        b"distinct": _step(len(distinct), n) if n >= 20 else -1,
        b"size": (n + 1).bit_length(),
        b"again": _step(sum(map(operator.eq, words, words[1:])), n),
        b"upper": _step(bare - len(text.translate(None, b" \t\n\r\x0b\x0cABCDEFGHIJKLMNOPQRSTUVWXYZ")), bare),
        b"symbols": _step(bare - len(text.translate(None, b" \t\n\r\x0b\x0c#*$%&|<>!@^_=+~{}[]\\/")), bare),
        b"lines": _step(len(lines) - len(set(lines)), len(lines)),
    }
    fresh = {_hash(b"t", k + b"%d" % v) for k, v in shares.items()}
    return found | (fresh if known.within is None else {x for x in fresh if x in known.within})


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature, and the thresholds between grades in ascending order."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [float(_sigmoid(np.float64(score - t))) for t in self.thresholds]

    def score(self, found: set[int]) -> float:
        return sum(sorted(self.weights[x] for x in found if x in self.weights))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def fit_ordinal(docs: list[np.ndarray], grades: np.ndarray, n_grades: int, prior: float = 1.0, rounds: int = 200, rate: float = 0.05) -> Ordinal:
    """Weights and thresholds of the cumulative-link model, by Adam on the whole sample.

    Weights have a normal prior of variance ``1 / prior``: a squared penalty that weighs less the more documents there are.
    ``docs`` holds the features of each document. Without documents every weight is
    missing and the thresholds are far below zero, so that all have the best grade.
    """
    if not len(docs):
        return Ordinal({}, tuple(-20.0 + k for k in range(n_grades - 1)))
    row = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    names, seen = np.unique(np.concatenate(docs), return_counts=True)
    names = names[seen >= LEAST_DOCS]
    column, kept = [], []
    for d in docs:  # a document at a time, so that what is left out takes no memory
        at = np.minimum(np.searchsorted(names, d), max(0, len(names) - 1))
        there = names[at] == d if len(names) else np.zeros(len(d), bool)
        column.append(at[there].astype(np.int32))
        kept.append(there)
    column, row = np.concatenate(column), row[np.concatenate(kept)]
    n, m = len(docs), len(names)
    penalty = prior / n
    # thresholds start at the shares of the grades: first cut, then logs of the gaps
    below = np.clip(np.array([(grades <= k).mean() for k in range(n_grades - 1)]), 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(n_grades - 1))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    theta = np.concatenate([np.zeros(m), cuts[:1], gaps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, a, g = theta[:m], theta[m], theta[m + 1:]
        cuts = a + np.concatenate([[0.0], np.cumsum(np.exp(g))])
        score = np.bincount(row, w[column], n)
        under = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None] - score[:, None]), np.ones((n, 1))], axis=1)  # P(grade < k)
        high, low = under[np.arange(n), grades + 1], under[np.arange(n), grades]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_score = (d_high - d_low) / n  # of the negative log likelihood
        d_cuts = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_cuts[k] = (-(d_high[grades == k]).sum() + d_low[grades == k + 1].sum()) / n
        tail = np.cumsum(d_cuts[::-1])[::-1]
        grad = np.concatenate([np.bincount(column, d_score[row], m) + penalty * w, tail[:1], tail[1:] * np.exp(g)])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cuts = theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1:]))])
    return Ordinal(dict(zip(names.tolist(), theta[:m].tolist(), strict=True)), tuple(cuts.tolist()))


def rated(labels: DataFrame, grade: Column, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(id, grade) of at most ``sample`` rated documents, those with the smallest hashes of their ids.

    Null ids and null grades are left out; of several ratings the lowest counts.
    """
    rows = labels.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).dropna()
    return rows.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample)


def fit(
    docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
) -> Ordinal:
    """The model for ``ratings``, (id, grade 0 to ``n_grades`` - 1); of more than ``sample`` those with the smallest hashes of their ids.

    So at most ``sample`` ids are broadcast, and ``sample`` x ``MOST_FEATURES`` features collected. A rated document without a row in ``docs`` is left out, a null text is empty; of
    several texts with one id the one with the smallest hash counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordFeatures()
        for batch in slices(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            found = [sorted(features(t or b"", known))[:MOST_FEATURES] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "grade", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ratings = ratings.select("id", "grade").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = rows.join(F.broadcast(ratings), "id").groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    table = rows.mapInArrow(tidied(run), f"id {kind}, grade int, found array<long>").toArrow().sort_by("id")
    found = [x.values.to_numpy() for x in table["found"]]
    return fit_ordinal(found, table["grade"].to_numpy(), n_grades)


def grade_texts(
    docs: DataFrame, model: Ordinal, least_grade: int, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: (id, score, expected_grade, tail, kept) and the columns in ``keep``.

    ``tail`` is the probability of ``least_grade`` or better, ``kept`` whether it is
    at least ``least_tail``. A null or empty text is graded by its lack of words, a very
    long one by all its words, in memory that grows with it.
    Rows that repeat are graded alike, null ids are kept as rows, an empty table
    gives an empty table. ``keep`` may name any other columns but the result's.
    """
    if not 1 <= least_grade <= len(model.thresholds):
        raise ValueError("the least grade is one of the grades above the lowest")
    extra = [f for f in docs.schema.fields if f.name in keep and f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordFeatures(model.weights)
        for batch in slices(batches):
            scores = [model.score(features(t or b"", known)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tails = [model.tails(s) for s in scores]
            chosen = [t[least_grade - 1] for t in tails]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([sum(t) for t in tails], pa.float64()), pa.array(chosen, pa.float64()),
                 pa.array([t >= least_tail for t in chosen], pa.bool_()), *batch.columns[1 if text_col in keep else 2:]],
                names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f.name).alias(f"k{i}") for i, f in enumerate(extra)))
    kind = rows.schema["id"].dataType.simpleString()
    kinds = [("id", kind), ("score", "double"), ("expected_grade", "double"), ("tail", "double"), ("kept", "boolean")]
    kinds += [(text_col, "string")] * (text_col in keep) + [(f.name, f.dataType.simpleString()) for f in extra]
    names = [n for n, _ in kinds]
    return rows.mapInArrow(tidied(run), ", ".join(f"`{n}` {k}" for n, k in kinds))
