"""Token ids of documents in files, each id in the fewest bits that the vocabulary needs.

A file holds, all little-endian: the magic, the bits of an id, the ids of a block;
blocks of packed ids (big-endian bit order, padded to whole bytes); the offset of
each block; the document index (doc id, whether there is one, end of its ids); and a
footer with counts and places. Blocks have a fixed number of ids, so the ids of any
document, or any range of ids, are read by unpacking the blocks that hold them.

Documents are written in ascending order of their id: texts are dealt out
by range, and every task streams one file. The manifest, a table, names the file
of every task that succeeded, so files of failed or repeated tasks are never read.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetab.llm.common import resource_path, scratch, stored

MAGIC = b"PGTOKEN1"
_HEAD, _FOOT = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
#: Ids of a block: a multiple of eight, so that every block fills whole bytes.
BLOCK = 1 << 16
#: Words remembered with their ids, and their bytes, beyond which all are forgotten.
_MOST_WORDS, _MOST_BYTES = 1 << 19, 64 << 20
#: Texts whose words are looked up together.
_TEXTS = 512
#: Bytes of ids that make a batch.
_BATCH = 8 << 20


# ---------------------------------------------------------------- packing


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, padded with zeros to a whole byte."""
    if bits > 32 or len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {min(bits, 32)} bits")
    raw = np.ascontiguousarray(ids, dtype=">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, 4 - bits // 8:].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1)[:, 32 - bits:].ravel()).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``pack``'s result, as uint32."""
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, 4 - bits // 8:] = raw[: n * bits // 8].reshape(n, -1)
    else:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, 32 - bits:] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
        wide = np.packbits(wide, axis=1)
    return wide.view(">u4").ravel().astype(np.uint32)


class Writer:
    """Streams documents' ids into one file."""

    def __init__(self, out: pa.NativeFile, bits: int, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block has a multiple of eight ids")
        self.out, self.bits, self.block = out, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets, self.docs, self.ends = [], [], []
        self.at = out.write(_HEAD.pack(MAGIC, bits, block))
        self.at = _HEAD.size

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.docs.append(doc)
        self.ends.append(self.n_ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            data = pack(ids[a: min(a + self.block, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = self.at
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(_FOOT.pack(index, len(self.offsets), len(self.docs), self.n_ids, MAGIC))


class Reader:
    """Random access to one file: ``docs`` (None where there is no id), ``ends`` and any range of ids."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        magic, self.bits, self.block = _HEAD.unpack(file.read_at(_HEAD.size, 0))
        index, blocks, docs, self.n_ids, again = _FOOT.unpack(file.read_at(_FOOT.size, file.size() - _FOOT.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a token file, or one that ends early")
        raw = file.read_at(8 * blocks + 17 * docs, index)
        self.offsets = np.frombuffer(raw, "<u8", blocks)
        ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        there = np.frombuffer(raw, np.uint8, docs, 8 * (blocks + docs))
        self.docs = [int(d) if t else None for d, t in zip(ids, there, strict=True)]
        self.ends = np.frombuffer(raw, "<u8", docs, 8 * (blocks + docs) + docs).astype(np.int64)

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        count = min((last + 1) * self.block, self.n_ids) - first * self.block
        data = self.file.read_at((count * self.bits + 7) // 8, int(self.offsets[first]))
        return unpack(data, self.bits, count)[start - first * self.block: end - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.range(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


# ---------------------------------------------------------------- encoding


#: Stands between words that are encoded in one go; a word that holds it is encoded alone.
_MARK = "\x01"


class _Words:
    """Ids of words as bytes. Words not used for long are forgotten: what was met since the last time stays."""

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.kind, self.held = tokenizer, kind, 0
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        mark = tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def split(self, text: bytes) -> list[bytes]:
        """Words of a text. The vocabulary is one of lower case: A-Z are lowered, but not where an added token might arise."""
        low = text.lower()
        return (text if any(t in low for t in self.added) else low).split()

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        if len(self.now) > _MOST_WORDS or self.held > _MOST_BYTES:
            self.before, self.now, self.held = self.now, {}, 0
        now, before = self.now, self.before
        new = []
        for w in {w for t in texts for w in t}:
            if w not in now:
                if w in before:
                    now[w] = before[w]
                else:
                    new.append(w)
        for a in range(0, len(new), 256):
            self._learn(new[a: a + 256])
        return [b"".join(map(now.__getitem__, t)) for t in texts]

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if b"\x01" not in w and b"<|" not in w] if self.mark is not None else []
        joined = f" {_MARK} ".join([w.decode("utf-8", "replace") for w in plain])
        ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, self.kind)
        ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)] if plain else []
        if len(ends) != len(plain):
            plain, ends = [], []
        data, size, start = ids.tobytes(), ids.itemsize, 0
        for w, end in zip(plain, ends, strict=True):
            self._keep(w, data[start * size: end * size])
            start = end + 1
        rest = [w for w in words if w not in self.now]
        found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        for w, e in zip(rest, found, strict=True):
            self._keep(w, np.array(e.ids, self.kind).tobytes())

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.now[word] = ids
        self.held += len(word) + len(ids)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=1)
def _words(path: str, kind: str) -> _Words:
    """One for all tasks of a worker, so that words are not learned anew for each."""
    return _Words(_tokenizer(path), kind)


def vocabulary_of(tokenizer: str) -> int:
    """Ids of the vocabulary, added tokens included."""
    t = _tokenizer(resource_path(tokenizer))
    return max(t.get_vocab(with_added_tokens=True).values()) + 1


# ---------------------------------------------------------------- files


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """Write the ids of ``docs`` below ``path``, return the manifest: (part, file, n_docs, n_ids, start).

    The tokenizer must drop white space, lower the case and have no token across white
    space, as the word vocabulary does: then a text's ids are those of its words.
    Every document's ids end with ``end_id``; a null or empty text has only that.
    Documents are in ascending order of id, null ids first, equal ids by a hash of
    their texts; rows that agree in both are the same in either order. ``start`` is
    the number of ids in all files before. Other columns are not read. An empty
    table gives an empty manifest. Files of tasks that failed stay unlisted.
    """
    tokens = resource_path(tokenizer)
    bits = bits_for(max(vocabulary_of(tokens), end_id + 1))
    kind = "<u2" if bits <= 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # texts are dealt out before they are encoded, as ranges are found by a pass of their own
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        writer = out = known = None
        name, end = f"{uuid.uuid4().hex}.tok", np.array([end_id], kind).tobytes()
        for whole in batches:
            for a in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(a, _TEXTS)
                if writer is None:
                    known = _words(tokens, kind)
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at.rstrip('/')}/{name}", compression=None)
                    writer = Writer(out, bits, block)
                texts = [known.split(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), known.encode(texts), strict=True):
                    writer.add(doc, np.frombuffer(ids + end, kind).astype(np.uint32))
        if writer is not None:
            writer.close()
            out.close()
            row = [TaskContext.get().partitionId(), name, len(writer.docs), writer.n_ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int32()), pa.array([row[1]]), pa.array([row[2]], pa.int64()), pa.array([row[3]], pa.int64())],
                names=["part", "file", "n_docs", "n_ids"])

    wrote = stored(ordered.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), f"{path.rstrip('/')}/tasks")
    # one row per file
    start = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(wrote.withColumn("start", start.cast("long")), f"{path.rstrip('/')}/manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """(id, start, ids): every document of the files in ``manifest``; ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{at.rstrip('/')}/{file}") as source:
                    reader = Reader(source)
                    first = 0
                    while first < len(reader.docs):
                        begin = int(reader.ends[first - 1]) if first else 0
                        last = max(first + 1, int(np.searchsorted(reader.ends, begin + _BATCH // 4, "right")))
                        ids = reader.range(begin, int(reader.ends[last - 1])).astype("<u4")
                        ends = reader.ends[first:last]
                        starts = np.concatenate([[begin], ends[:-1]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[first:last], pa.int64()), pa.array(starts + start),
                             pa.array([ids[a - begin: b - begin].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                            names=["id", "start", "ids"])
                        first = last

    files = max(1, manifest.count())
    spread = manifest.select("file", "start", "part").repartitionByRange(files, "part").select("file", "start")
    return spread.mapInArrow(run, "id long, start long, ids binary")


def token_files(docs: DataFrame, **options: object) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back; see the two functions above."""
    path = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, **options), path)
