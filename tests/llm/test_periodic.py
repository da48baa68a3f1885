"""Periodic runs against the definition, tried for every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetab.llm import periodic
from pagetab.llm.queries import op12_periodic


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b + q - a >= max(least, 2 * q) and (a, b + q) not in found:
                found[(a, b + q)] = q
            a = b + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def check(*texts):
    assert periodic.periodic_runs([numbers(t) for t in texts]) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=40), st.integers(1, 6)), min_size=1, max_size=6))
def test_two_letters(parts):
    check("".join(p * k for p, k in parts))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 5))
def test_loops_in_noise(seed, letters):
    rng = np.random.default_rng(seed)
    text = []
    while len(text) < 900:
        part = rng.integers(0, letters, rng.integers(1, 120)).tolist()
        whole = part * int(rng.integers(1, 5))
        text += whole[: len(whole) - int(rng.integers(0, len(part)))]
        text += rng.integers(0, letters + 2, rng.integers(0, 30)).tolist()
    check(text)


@pytest.mark.parametrize("p", [1, 2, 3, 5, 11, 30])
def test_small_periods_within_long_ones(p):
    """A period that itself repeats something short has no elected seed but where its copies meet."""
    part = [*range(p)]
    for whole in (20 * p, 20 * p + 1, 31 * p + p // 2):
        loop = (part * 40)[:whole]
        check(loop * 2, [-5, *loop * 3, -6], [*loop, *loop[:-1]], loop + [99] + loop + [99] + loop, loop + part[1:] + loop)


def test_words_of_fibonacci_and_thue_morse():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    morse = "a"
    while len(morse) < 1200:
        morse += morse.translate(str.maketrans("ab", "ba"))
    check(b, morse, "a" * 700, "ab" * 300 + "a" * 300, "")


def test_texts_do_not_mix():
    loop = [*range(30)] * 3
    check(loop, loop, loop[5:], [1] * 11, [1] * 12, [])


def plain_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    a, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), a, length, q, 1000 * length // q if runs else None, sha(lines), sha(kept))


def rows():
    rng = np.random.default_rng(9)
    out = []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 400))]
        out.append((i, " \n".join(words)))
    loop = " ".join(f"é{x}" for x in range(70))
    out += [(200, None), (201, ""), (202, " \t"), (203, "x " * 12), (204, "x\x1cy " * 11), (205, f"{loop} {loop} {loop}"), (205, f"{loop} {loop} {loop}")]
    return [*out, (None, "a b " * 30), (206, " ".join(f"{x % 2000}" for x in range(9000)))]


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "_WORDS", 3000)
    spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS id").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    found = op12_periodic(spark, str(tmp_path)).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted((plain_row(*r) for r in rows()), key=str)


def test_as_they_are(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    found = {r.id: r for r in periodic.find_runs(docs).collect()}
    assert found[205].runs == [0, 210, 70] and found[205].collapsed.split() == [f"é{x}" for x in range(70)]
    assert found[200].n_words == 0 and found[200].collapsed == "" and found[200].start is None
    assert periodic.find_runs(docs.where("false")).count() == 0
