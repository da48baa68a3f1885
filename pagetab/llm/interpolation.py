"""Language-model scores by deleted interpolation of word bigrams.

The probability of a word mixes three estimates: the bigram's relative frequency,
the word's relative frequency, and a uniform one over the vocabulary and one more
type for unknown words. The weights of the mixture depend on how often the context
was seen, in buckets of powers of two. They are learned by expectation
maximisation on a tenth of the training documents, held out from the counts that
the learning sees; scores then use the counts of all training documents.

Counts are too many for any one place. Texts are dealt out in chunks of about
``CHUNK`` bytes. A chunk sends each of its distinct words and bigrams once, as a
sorted list of 64-bit hashes for each range of hashes; a range adds up what all
chunks sent and answers every chunk with the totals in the order that it asked in.
A chunk then scores its documents from its texts and the answers. What moves is one
key and one count for each distinct bigram of a chunk, a frequent word once for
each chunk; no task holds more than one chunk or one range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagetab.llm.common import scratch, stored

#: Bytes of text in a chunk, about; a longer text is a chunk of its own size.
CHUNK = 8 << 20
#: One in so many training documents is held out to learn the weights.
DEV = 10
#: Steps of log2 in which ratios of probabilities are counted for the learning.
_FINE = 8
_NEVER = -(1 << 15)
_SEED, _MOST_WORDS = 7, 1 << 20
_END = xxhash.xxh64_intdigest(b" end", _SEED)


class _WordHashes(dict):
    """XXH64 of words, remembered for as long as they are few enough to hold."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, _SEED)
        if len(self) < _MOST_WORDS and len(word) < 64:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unigram keys, bigram keys, lengths) of all tokens, an end after each text's words.

    The first token's context is an end too, as if texts stood in a row.
    """
    known, parts, lengths = _WordHashes(), [], []
    end = np.array([_END], np.uint64)
    for text in texts:
        words = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split()
        parts += [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), end]
        lengths.append(len(words) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.concatenate(parts)
    before = np.concatenate([end, h[:-1]])
    return _mixed(h), _mixed(before * np.uint64(0x9E3779B97F4A7C15) + h), np.array(lengths, np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, lowest first: what is small compresses to little in a shuffle."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind).ravel()


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes starts in sorted ``keys``."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole part of log2."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def learn_weights(cells: np.ndarray, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """Weights (bigram, word, uniform) by bucket, from rows (bucket, log2 ratio of bigram, of word to uniform, count).

    Expectation maximisation; each bucket's counts are joined by ``prior`` counts in
    the shares of all buckets together. The bigram has weight 0 after a context
    never seen. Without rows all estimates weigh the same.
    """
    weights = np.full((66, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    if not len(cells):
        return weights
    bucket, n = cells[:, 0].astype(np.int64), cells[:, 3].astype(np.float64)
    odds = np.ones((len(cells), 3))
    for i in (1, 2):
        odds[:, i - 1] = np.where(cells[:, i] == _NEVER, 0.0, np.exp2(cells[:, i] / _FINE))
    for _ in range(rounds):
        share = weights[bucket] * odds
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, i], 66) for i in range(3)], axis=1)
        seen = sums[1:].sum(axis=0)
        common = seen / seen.sum() if seen.sum() else np.full(3, 1 / 3)
        fresh = sums + prior * common
        fresh[0] = sums[0] + prior * np.array([0.0, 0.5, 0.5])
        fresh[0, 0] = 0.0
        weights = fresh / fresh.sum(axis=1, keepdims=True)
    return weights


def crc_fold(id_col: Column, folds: int = 7) -> Column:
    """CRC-32 of the id as text modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, dev: int = DEV,
) -> DataFrame:
    """One row per row of ``docs``: (id, held_out, n_tokens, n_known, train_tokens, train_types, base_score, score).

    The model learns from the rows where ``held_out`` is false (null counts as
    false). Texts are lowered in A-Z and cut at ASCII white space; one end token
    follows each. A null text is empty: its one token is the end. ``score`` is the
    log10 probability of the text, ``base_score`` that of add-one unigrams,
    ``n_known`` counts tokens seen in training. Without training rows both scores
    are 0. Rows that repeat are counted and scored as often as they occur. Null ids
    are kept. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    chunks = max(1, -(-total // chunk))
    dev_chunks = max(1, -(-chunks // dev))
    mark = F.xxhash64("id", "text")
    is_dev = ~F.col("held_out") & (F.pmod(F.shiftright(mark, 20), F.lit(dev)) == 0)
    # documents of the learning have chunks of their own, numbered from ``chunks`` on
    where = F.when(is_dev, chunks + F.pmod(F.shiftright(mark, 8), F.lit(dev_chunks))).otherwise(F.pmod(mark, F.lit(chunks)))
    dealt = rows.withColumn("chunk", where.cast("long"))

    def ask(table: pa.Table) -> pa.Table:
        """A chunk's distinct keys with their counts in training, for each range of hashes."""
        at = table["chunk"][0].as_py()
        words, pairs, lengths = _tokens(table["text"])
        trains = np.repeat(~table["held_out"].to_numpy(zero_copy_only=False).astype(bool), lengths)
        out = []
        for kind, keys in enumerate((words, pairs)):
            distinct, place = np.unique(keys, return_inverse=True)
            counts = np.bincount(place[trains], minlength=len(distinct)).astype(np.uint32)
            cuts = _cuts(distinct, chunks)
            for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    out.append((kind, part, at, b - a, _planes(np.diff(distinct[a:b], prepend=np.uint64(0))), _planes(counts[a:b])))
        return pa.Table.from_pylist(
            [dict(zip(asked.names, x, strict=True)) for x in out], schema=asked)

    asked = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        """Totals of one range of hashes, for each chunk in its order; what belongs to the learning apart."""
        kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
        table = table.sort_by("chunk")
        sizes, at = table["n"].to_pylist(), table["chunk"].to_pylist()
        keys = np.concatenate([
            np.cumsum(_from_planes(k.as_py(), np.uint64, n), dtype=np.uint64) for k, n in zip(table["keys"], sizes, strict=True)])
        counts = np.concatenate([_from_planes(c.as_py(), np.uint32, n) for c, n in zip(table["counts"], sizes, strict=True)])
        kept = np.where(np.repeat(np.array(at) >= chunks, sizes), 0, counts)  # without what the learning holds out
        distinct, place = np.unique(keys, return_inverse=True)
        whole = np.bincount(place, counts, len(distinct)).astype(np.uint64)
        less = np.bincount(place, kept, len(distinct)).astype(np.uint64)
        out, a = [], 0
        for c, n in zip(at, sizes, strict=True):
            mine = place[a: a + n]
            out.append({"kind": kind, "part": part, "chunk": c, "n": n, "whole": _planes(whole[mine]),
                        "less": _planes(less[mine]) if c >= chunks else None, "stats": None})
            a += n
        if kind == 0:  # tokens and types of training, with and without what is held out
            stats = [int(whole.sum()), int((whole > 0).sum()), int(less.sum()), int((less > 0).sum())]
            out.append({"kind": kind, "part": part, "chunk": -1, "n": 0, "whole": None, "less": None, "stats": stats})
        return pa.Table.from_pylist(out, schema=answers)

    answers = pa.schema([
        ("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("whole", pa.binary()),
        ("less", pa.binary()), ("stats", pa.list_(pa.int64()))])
    sent = dealt.groupBy("chunk").applyInArrow(ask, "kind int, part int, chunk long, n int, keys binary, counts binary")
    told = stored(
        sent.groupBy("kind", "part").applyInArrow(answer, "kind int, part int, chunk long, n int, whole binary, less binary, stats array<long>"),
        f"{folder}/counts")
    stats = told.where("chunk = -1").select(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(4))).first()

    def looked_up(table: pa.Table, replies: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, bigram counts by token, lengths) of a chunk."""
        words, pairs, lengths = _tokens(table["text"])
        replies = replies.sort_by([("kind", "ascending"), ("part", "ascending")])
        found = []
        for kind, keys in enumerate((words, pairs)):
            place = np.unique(keys, return_inverse=True)[1]
            mine = replies.filter(pc.equal(replies["kind"], kind))
            counts = np.concatenate([
                _from_planes(c.as_py(), np.uint64, n) for c, n in zip(mine[column], mine["n"].to_pylist(), strict=True)])
            if place.max() + 1 != len(counts):
                raise ValueError("a chunk's texts are not those that its counts were asked for")
            found.append(counts[place].astype(np.float64))
        word, pair = found
        # a token's context is the token before; the first one's is an end, and the last token is one
        return np.concatenate([word[-1:], word[:-1]]), word, pair, lengths

    def estimates(context, word, pair, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray, float]:
        return pair / np.maximum(context, 1), word / max(tokens, 1), 1 / (types + 1)

    def gather(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Counts of tokens by bucket and rounded ratios, from documents held out for the learning."""
        if not table.num_rows or not replies.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("b", "r2", "r1", "n")})
        context, word, pair, _ = looked_up(table, replies, "less")
        p2, p1, p0 = estimates(context, word, pair, stats["s2"], stats["s3"])
        ratios = []
        for p in (p2, p1):
            seen = p > 0
            r = np.full(len(p), _NEVER, np.int64)
            r[seen] = np.rint(_FINE * np.log2(p[seen] / p0)).astype(np.int64)
            ratios.append(r)
        cells, n = np.unique(np.stack([_bucket(context), *ratios], axis=1), axis=0, return_counts=True)
        return pa.table({"b": cells[:, 0], "r2": cells[:, 1], "r1": cells[:, 2], "n": n})

    learning = dealt.where(F.col("chunk") >= chunks).groupBy("chunk").cogroup(told.where(F.col("chunk") >= chunks).groupBy("chunk"))
    cells = learning.applyInArrow(gather, "b long, r2 long, r1 long, n long").groupBy("b", "r2", "r1").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([tuple(c) for c in cells], np.int64))

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return scored.empty_table()
        context, word, pair, lengths = looked_up(table, replies, "whole")
        tokens, types = stats["s0"], stats["s1"]
        p2, p1, p0 = estimates(context, word, pair, tokens, types)
        w = weights[_bucket(context)]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0 if tokens else np.ones(len(word))
        base = np.log10(word + 1) - math.log10(tokens + types + 1)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return pa.table({
            "id": table["id"], "held_out": table["held_out"], "n_tokens": lengths,
            "n_known": np.add.reduceat((word > 0).astype(np.int64), first),
            "train_tokens": np.full(len(lengths), tokens), "train_types": np.full(len(lengths), types),
            "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first),
        }, schema=scored)

    kind = rows.schema["id"].dataType
    scored = pa.schema([
        ("id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
        ("train_types", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    both = dealt.groupBy("chunk").cogroup(told.where("chunk >= 0").select("kind", "part", "chunk", "n", "whole").groupBy("chunk"))
    return both.applyInArrow(
        score, f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, train_types long, base_score double, score double")
