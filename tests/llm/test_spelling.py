"""Spelling variants against all pairs of words."""

import collections
import re
import zlib

import numpy as np
import pytest

from pagetab.llm import spelling
from pagetab.llm.common import scratch
from pagetab.llm.queries import op11_spelling


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) > len(v):
        u, v = v, u
    i = next((i for i in range(len(u)) if u[i] != v[i]), len(u))
    return u[i + 1:] == v[i + 1:] if len(u) == len(v) else u[i:] == v[i + 1:]


def plain(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if near and words[best] >= ratio * n else None, len(near)]
    rows = set()
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, words[w], near, words[form] if form else None))
    return rows


def grouped(spark, words, **options):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = spelling.spelling_groups(table, **options).collect()
    assert len(rows) == len(words)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize(("letters", "longest", "block"), [("ab", 9, 4), ("ab", 7, 1000), ("abcé×ÿ", 6, 3), ("abcdefghijkl", 5, 16)])
def test_groups(spark, letters, longest, block):
    rng = np.random.default_rng(len(letters) + block)
    words = {}
    for _ in range(700):
        word = "".join(rng.choice(list(letters), rng.integers(1, longest + 1)))
        words[word] = int(5 ** rng.integers(1, 5) * rng.integers(1, 3))
    assert grouped(spark, words, block=block) == plain(words)


def test_long_words_and_chains(spark):
    stem = "abcdefghij" * 400
    words = {stem: 5000, stem + "x": 900, "x" + stem + "x": 100, stem[:2000] + stem[2001:]: 9, stem[:-1]: 5000, "alone": 7}
    words |= {"c" * i: 5 * 6 ** (9 - i) for i in range(1, 10)}
    found = grouped(spark, words, block=1)
    assert found == plain(words)
    assert {r[2] for r in found if set(r[0]) == {"c"}} == {"c"}


def test_ties_nulls_empty(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaaac": 25, "aaaaaé": 25}
    found = grouped(spark, words)
    assert found == plain(words)
    assert ("aaaaaa", "aaaaab", "aaaaab", 5, 3, 25) in found
    table = spark.createDataFrame([(None, 4, "x"), ("aaaaaa", 1, None)], "word string, n long, best string")
    assert [tuple(r) for r in spelling.spelling_groups(table).collect()] == [("aaaaaa", None, "aaaaaa", 1, 0, None)]
    assert spelling.spelling_groups(table.where("false")).count() == 0


def counted(rows, damage, least_chars=6, least_n=5):
    counts = collections.Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}


def sample():
    rng = np.random.default_rng(4)
    stems = ["".join(rng.choice(list("abÀéÉ"), rng.integers(5, 9))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(stems, 60)) + ", ÀÉÀÉÀÉ ABCDEF abcdef AbCdEf1abcdef") for i in range(80)]
    return [*rows, rows[3], rows[3], (None, rows[5][1]), (500, None), (501, ""), (502, "×÷×÷×÷ " * 9), (503, "longword" * 3000 + " abcdef")]


@pytest.mark.parametrize("damage", [None, 7, 199])
def test_counts(spark, damage):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'w' AS word")
    found = {r.word: r.n for r in spelling.word_counts(docs, damage=damage).collect()}
    assert found == counted(rows, damage)


def test_counts_pass_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_MOST_WORDS", 3)
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == counted(rows, None)


def test_small_slices(monkeypatch):
    words = sorted({"".join(np.random.default_rng(i).choice(list("abc"), 5)) for i in range(150)})
    monkeypatch.setattr(spelling, "_PAIRS", 64)
    chars = np.array(words, dtype="U6").view(np.uint32).reshape(len(words), 6)
    u, v = spelling.pairs_within(chars, np.full(len(words), 5), np.zeros(len(words), int))
    found = sorted(zip(u.tolist(), v.tolist(), strict=True))
    assert found == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def test_blocks_are_cut(spark):
    """No block keeps more words than asked for, unless its words differ at one place."""
    words = {a + b + c + "zzz": 5 for a in "abcdef" for b in "abcdef" for c in "abcdef"}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r.word: r.n_near for r in spelling.near_words(table, scratch(spark, "test"), block=6).collect()}
    assert near == {w: 15 for w in words}


def test_query(spark, tmp_path):
    rows = sample()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in op11_spelling(spark, str(tmp_path)).collect()}
    assert found == plain(counted(rows, 199))
