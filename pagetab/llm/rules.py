"""Quality rules on texts: repetition, and the fertility of a public tokenizer.

A text's words are cut into the pieces of a public vocabulary. Fertility is judged by
characters per piece, by the share of pieces that are bytes of characters that the
vocabulary lacks, and by the entropy of the pieces. Each language, or else each
script, has a band of accepted values; they are wide, so that ordinary prose
passes and text which tokenizes like noise or like a loop does not.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetab.llm.common import resource_path

#: Least and most characters per piece, most share of byte pieces, least entropy
#: as a share of what ``ENTROPY_SPAN`` or fewer pieces could have.
BANDS = {
    "en": (1.5, 9.0, 0.10, 0.70), "de": (1.3, 9.0, 0.10, 0.70), "fr": (1.3, 9.0, 0.10, 0.70), "es": (1.3, 9.0, 0.10, 0.70),
    "latin": (1.2, 9.0, 0.20, 0.55), "cyrillic": (0.9, 8.0, 0.20, 0.55), "cjk": (0.3, 4.0, 0.70, 0.55), "other": (0.2, 9.0, 0.90, 0.50),
}
ENTROPY_SPAN = 256
#: Deviations by which a band is widened: what n pieces say is uncertain by about one part in the root of n.
DEVIATIONS = 3.0
#: Base rules: fewest words, most words in repeated windows in a hundred, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
_SYMBOLS = b"#*$%&|<>"
_MOST_WORDS, _MOST_BYTES = 1 << 19, 64 << 20
_TEXTS = 256
SCRIPTS = ("latin", "cyrillic", "cjk", "other")
_LETTERS = 1 << 20


@functools.cache
def _script_table() -> np.ndarray:
    """Number in ``SCRIPTS`` of each character; one more than the last for what is no letter."""
    table = np.full(0x110000, len(SCRIPTS), np.uint8)
    for o in range(0x110000):
        if chr(o).isalpha():
            table[o] = 0 if o < 0x250 or 0x1E00 <= o < 0x1F00 else 1 if 0x400 <= o < 0x530 else (
                2 if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0x20000 <= o < 0x33480 else 3)
    return table


def letters(words: list[str]) -> np.ndarray:
    """Letters of each script in each of the words."""
    counts, a = np.zeros((len(words), len(SCRIPTS) + 1), np.int32), 0
    while a < len(words):  # about so many characters at once
        b, held = a, 0
        while b < len(words) and (b == a or held + len(words[b]) <= _LETTERS):
            held += len(words[b])
            b += 1
        kinds = _script_table()[np.frombuffer("".join(words[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = np.repeat(np.arange(b - a) * (len(SCRIPTS) + 1), [len(w) for w in words[a:b]])
        counts[a:b] = np.bincount(at + kinds, minlength=(b - a) * (len(SCRIPTS) + 1)).reshape(b - a, -1)
        a = b
    return counts[:, :-1]


class _Words:
    """Pieces, hash and number of each word seen, for as long as they are few enough to hold."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes, self.pieces = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.letters = np.zeros((0, len(SCRIPTS)), np.int32)
        self.held = 0

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self.number) > _MOST_WORDS or self.held > _MOST_BYTES:
            self.reset()
        new = list({w for t in texts for w in t if w not in self.number})
        if not new:
            return
        self.held += sum(map(len, new))
        base = len(self.number)
        self.number.update({w: base + i for i, w in enumerate(new)})
        new_texts = [w.decode("utf-8", "replace") for w in new]
        cut = self.model.encode(new_texts, num_threads=1)
        self.letters = np.concatenate([self.letters, letters(new_texts)])
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)])
        self.pieces = np.concatenate([self.pieces, *(np.array(p, np.int32) for p in cut)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(p) for p in cut])])

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and all their pieces in order."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first, n = self.first[at], self.first[at + 1] - self.first[at]
        total = int(n.sum())
        where = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
        return self.hashes[at], self.pieces[where]

    def script(self, words: list[bytes]) -> str:
        """The script that most letters of the words have."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        counts = self.letters[at].sum(axis=0, dtype=np.int64)
        return SCRIPTS[int(counts.argmax())] if counts.any() else "other"


def repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words that windows found twice or more cover, the first occurrence included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for i in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[i: i + n]
        keys ^= keys >> np.uint64(29)
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[place] > 1)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _entropy(pieces: np.ndarray) -> float:
    counts = np.bincount(pieces) if len(pieces) > 20_000 else np.unique(pieces, return_counts=True)[1]
    p = counts[counts > 0] / len(pieces)
    return max(0.0, float(-(p * np.log2(p)).sum()))


_OUT = pa.schema([
    *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces")),
    ("chars_per_piece", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64()), ("band", pa.string()),
    ("base_failed", pa.bool_()), ("reasons", pa.list_(pa.string())), ("kept", pa.bool_()),
])


def _judge(raw: bytes, words: list[bytes], lang: str | None, known: _Words, bands: dict) -> dict:
    hashes, pieces = known.of(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeated = len(words), repeated_words(hashes, WINDOW)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    count = len(pieces)
    per, share, entropy = (chars / count, float(known.is_byte[pieces].mean()), _entropy(pieces)) if count else (None, None, None)
    band = lang if lang in bands else known.script(words)
    reasons = ["words"] * (n < LEAST_WORDS) + ["repetition"] * (100 * repeated > MOST_REPEATED * n)
    low, high, most, least = bands[band]
    if count:
        slack = DEVIATIONS / math.sqrt(count)
        reasons += ["fertility"] * (not low * (1 - slack) <= per <= high * (1 + slack))
        reasons += ["bytes"] * (share > most + slack * math.sqrt(max(0, most * (1 - most))))
        reasons += ["entropy"] * (entropy < (least - slack) * math.log2(min(count, ENTROPY_SPAN)))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": len(joined) - len(joined.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated, "n_pieces": count, "chars_per_piece": per,
        "byte_share": share, "entropy": entropy, "band": band, "base_failed": failed, "reasons": reasons, "kept": not reasons,
    }


def judge_texts(
    docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", bands: dict | None = None, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str | None = "lang",
) -> DataFrame:
    """One row per row of ``docs``: id, the measures, band, base_failed, reasons and kept.

    Words end at ASCII white space and are cut into pieces one by one; measures of
    pieces are null for a text without words. A text fails the base rules with
    fewer than ``LEAST_WORDS`` words or over ``MOST_REPEATED`` per cent of words in
    ``WINDOW``-word windows found twice in the text. Texts must lie in the band of their
    language, or of the script of all their letters where the language is null or has no
    band; it is wider the fewer pieces a text has, by ``DEVIATIONS``. A null text has no
    words; a very long one is judged whole, in memory that grows with it. Other columns are not read; rows that repeat are judged alike; an empty
    table gives an empty table.
    """
    path, bands = resource_path(tokenizer), {**BANDS, **(bands or {})}
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(path)
        for whole in batches:
            for a in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(a, _TEXTS)
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                words = [t.split() for t in texts]
                known.learn(words)
                found = [_judge(t, w, x, known, bands) for t, w, x in zip(texts, words, batch.column(2).to_pylist(), strict=True)]
                out = pa.RecordBatch.from_pylist(found, schema=_OUT)
                yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["id", *_OUT.names])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, (
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_pieces long, "
        "chars_per_piece double, byte_share double, entropy double, band string, base_failed boolean, reasons array<string>, kept boolean"))
