"""Byte-pair encoding by a tokenization automaton, decoding by its arc labels.

The automaton accepts exactly the token sequences that the merges give. It is
built by merge gadgets, one merge after the other. It starts as one state with a
loop for each byte. The gadget of a merge ``u v -> w`` gives ``u`` a state of its
own that the arc ``v`` no longer leaves, and adds the arc ``w`` wherever ``u``
could be taken; it ends where ``v`` after ``u`` used to end. Two facts keep the
table small. The state after a token depends on that token alone, so a state is
named by it. And ``w`` is missing from just the states that lacked ``u`` when the
gadget was added: if tokens are numbered so that each stands before the tokens
which begin with it, the latest first, then what a removed arc takes away is one range
of numbers. The state of ``w`` starts as the state of ``v`` was at that time, so
states share their ranges.

A word is encoded by a run of the automaton over its bytes. At each place the
labels that come next are read off a table of tokens, and the longest whose arc
leaves the state is followed. Only one run of the automaton reads a given prefix, so
a place from which no arc leads on is given up for good, and every place is
expanded once at most. Decoding emits the bytes of the labels.
"""

from __future__ import annotations

import bisect
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetab.llm.common import held, resource_path, slices, tidied

#: Fixed value: how texts are split before merging; white space is Unicode's.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words remembered with their ids, their bytes, and the longest that are remembered.
_MOST_WORDS, _MOST_BYTES, _LONGEST = 1 << 18, 32 << 20, 256
#: Arcs remembered; a token's number fits 24 bits.
_MOST_ARCS = 1 << 19
#: Bytes of ids that make a batch.
_BATCH = 8 << 20


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States and arcs for ``tokens`` (bytes by id) and ``merges`` (left id, right id, result id; in order)."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.bytes = tokens
        self.base = [-1] * 256
        for t, b in tokens.items():
            if len(b) == 1:
                self.base[b[0]] = t
        made: dict[int, tuple[int, int, int]] = {}  # token: left, right, time
        self.removed: dict[int, list[tuple[int, int]]] = {}  # u: (time, v) of each gadget, in order
        children: dict[int, list[int]] = {}
        for time, (u, v, w) in enumerate(merges):
            if w in made or len(tokens[w]) == 1 or self._missing(u, v, made, time):
                continue  # its left and right never meet any more, or another merge makes the token
            made[w] = (u, v, time)
            self.removed.setdefault(u, []).append((time, v))
            children.setdefault(u, []).append(w)
        self.made = made
        # numbers: a token, then what begins with it, latest first
        self.number: dict[int, int] = {}
        self.after: dict[int, int] = {}
        stack = [(t, False) for t in self.base if t >= 0]
        while stack:
            t, left = stack.pop()
            if left:
                self.after[t] = len(self.number)
                continue
            self.number[t] = len(self.number)
            stack.append((t, True))
            stack.extend((c, False) for c in children.get(t, ()))
        self.children = children
        # tokens as nested tables: a byte's entry is (token or -1, table of the bytes that may follow)
        self.labels: dict = {}
        for t in self.number:
            table, b = self.labels, tokens[t]
            for x in b[:-1]:
                table = table.setdefault(x, [-1, {}])[1]
            table.setdefault(b[-1], [-1, {}])[0] = t
        self.states: dict[int, tuple[list[int], list[int]]] = {}
        #: Arcs looked up before, by state and token.
        self.arcs: dict[int, bool] = {}

    def _missing(self, x: int, t: int, made: dict, time: int) -> bool:
        """Whether the arc ``t`` is missing from the state after ``x`` just before gadget ``time``."""
        while True:
            if any(v == t for at, v in self.removed.get(x, ()) if at < time):
                return True
            tx, tt = (made[y][2] if y in made else -1 for y in (x, t))
            if tx < 0 and tt < 0:
                return False
            time = max(tx, tt)
            if tx > tt:
                x = made[x][1]
            else:
                t = made[t][0]

    def state(self, x: int) -> tuple[list[int], list[int]]:
        """Ranges of token numbers whose arcs the state after ``x`` lacks: starts, and the largest end so far."""
        found = self.states.get(x)
        if found is None:
            ranges, y, until = [], x, len(self.made) + len(self.removed) + (1 << 40)
            while True:
                for time, v in self.removed.get(y, ()):
                    if time >= until:
                        break
                    # v, and tokens begun with v after the gadget: those stand first among its children
                    later = [c for c in self.children.get(v, ()) if self.made[c][2] >= time]
                    ranges.append((self.number[v], self.after[later[0]] if later else self.number[v] + 1))
                if y not in self.made:
                    break
                _, y, until = self.made[y]
            ranges.sort()
            ends, most = [], 0
            for _, b in ranges:
                most = max(most, b)
                ends.append(most)
            found = self.states[x] = ([a for a, _ in ranges], ends)
        return found

    def allows(self, x: int, t: int) -> bool:
        """Whether the arc ``t`` leaves the state after ``x``."""
        starts, ends = self.state(x)
        n = self.number[t]
        i = bisect.bisect_right(starts, n)
        return not (i and ends[i - 1] > n)

    def encode(self, word: bytes) -> list[int]:
        """Ids of a pre-split word."""
        arcs, n = self.arcs, len(word)
        if len(arcs) > _MOST_ARCS:
            arcs.clear()
        ids: list[int] = []
        run: list[tuple] = []  # what is left to try at each place before
        closed: set[int] = set()
        at, state = 0, -1
        while at < n:
            table, i, open_ = self.labels, at, []
            while i < n:
                entry = table.get(word[i])
                if entry is None:
                    break
                i += 1
                t, table = entry
                if t >= 0:
                    open_.append((t, i))
            while True:
                t = -1
                while open_:
                    t, i = open_.pop()
                    if i not in closed:
                        if state < 0:
                            break
                        key = state << 24 | t
                        there = arcs.get(key)
                        if there is None:
                            there = arcs[key] = self.allows(state, t)
                        if there:
                            break
                    t = -1
                if t >= 0:
                    break
                closed.add(at)
                at, state, open_ = run.pop()
                ids.pop()
            run.append((at, state, open_))
            ids.append(t)
            at, state = i, t
        return ids


def _vocabulary(path: str) -> tuple[dict, dict[int, bytes], dict[str, int]]:
    """(specification, bytes of each token, ids of added tokens) of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    return spec, {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}, special


class Encoder:
    """Encoding with a vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        spec, tokens, self.special = _vocabulary(path)
        vocabulary = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = Automaton(tokens, [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges])
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """Drop what was remembered: a worker lives on after its task, the automaton is what it may keep."""
        self.words.clear()
        self.automaton.arcs.clear()
        self.held = 0

    def _word(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode(word.encode()), "<u4").tobytes()
        if len(word) <= _LONGEST:
            if len(self.words) >= _MOST_WORDS or self.held > _MOST_BYTES:
                self.words.clear()
                self.held = 0
            self.words[word] = ids
            self.held += len(word) + len(ids)
        return ids

    def _plain(self, text: str, out: list[bytes]) -> None:
        known, fresh = self.words.get, self._word
        out.extend([known(w) or fresh(w) for w in self.split.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; the strings of added tokens have their own ids."""
        out: list[bytes] = []
        at = 0
        if self.cut and any(t in text for t in self.special):
            for m in self.cut.finditer(text):
                self._plain(text[at: m.start()], out)
                out.append(np.array([self.special[m.group()]], "<u4").tobytes())
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)


class Decoder:
    """The labels of all arcs in one run of bytes."""

    def __init__(self, path: str):
        _, tokens, special = _vocabulary(path)
        labels = tokens | {i: t.encode() for t, i in special.items()}
        self.n = max(labels) + 1
        parts = [labels.get(i, b"") for i in range(self.n)] + [b""]  # the last for ids that there are not
        self.length = np.array([len(p) for p in parts], np.int32)
        self.first = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The labels one after another, as UTF-8; what is no UTF-8 becomes U+FFFD, unknown ids nothing."""
        at = np.where((ids >= 0) & (ids < self.n), ids, self.n)
        length = self.length[at]
        end = np.cumsum(length)
        if not len(end) or not end[-1]:
            return ""
        where = np.repeat((self.first[at] - (end - length)).astype(np.int32), length)
        where += np.arange(end[-1], dtype=np.int32)
        return self.bytes[where].tobytes().decode("utf-8", "replace")


@held
@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file: the automaton is built once."""
    return Encoder(path)


@held
@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One decoder per worker and file."""
    return Decoder(path)


def encode_texts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: (id, ids array<int>), the ids of the whole text, and the columns in ``keep``.

    A null text has the ids of an empty one: none. Ids of rows may be null or repeat.
    Other columns are not read; ``keep`` may name any but the result's. An empty
    table gives an empty table.
    """
    path = resource_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        encode = known.encode
        for batch in batches:
            rows, held, at = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                rows.append(encode(text.as_py() or ""))
                held += len(rows[-1])
                if held >= _BATCH or i + 1 == batch.num_rows:
                    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                    ids = pa.array(np.frombuffer(b"".join(rows), "<i4"))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(rows)), pa.ListArray.from_arrays(offsets, ids),
                         *(c.slice(at, len(rows)) for c in batch.columns[2:])], names=["id", "ids", *(f.name for f in extra)])
                    rows, held, at = [], 0, i + 1
        known.forget()

    extra = [f for f in docs.schema.fields if f.name in keep]
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f.name).alias(f"k{i}") for i, f in enumerate(extra)))
    kinds = [("id", rows.schema["id"].dataType.simpleString()), ("ids", "array<int>"), *((f.name, f.dataType.simpleString()) for f in extra)]
    return rows.mapInArrow(
        tidied(run, uses=(encoder, decoder)), ", ".join(f"`{n}` {k}" for n, k in kinds))


def decode_ids(
    encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json", keep: tuple[str, ...] = (), out: str = "text"
) -> DataFrame:
    """(id, ids, ``out``) from (id, ids), and the columns in ``keep``: ``out`` is the text that the ids give.

    Null ids give an empty text, an id that is null or that the vocabulary lacks nothing.
    """
    path = resource_path(tokenizer)
    extra = [f for f in encoded.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path).decode
        for batch in slices(batches):
            column = batch.column(1)
            texts = [decode(x.values.fill_null(-1).to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string()), *batch.columns[2:]], names=names)

    kinds = [("id", encoded.schema["id"].dataType.simpleString()), ("ids", "array<int>"), (out, "string")]
    kinds += [(f.name, f.dataType.simpleString()) for f in extra]
    names = [n for n, _ in kinds]
    return encoded.select("id", "ids", *(F.col(f.name).alias(f"k{i}") for i, f in enumerate(extra))).mapInArrow(
        tidied(run, uses=(encoder, decoder)), ", ".join(f"`{n}` {k}" for n, k in kinds))
