"""Operators against plain models, on rows with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagetab.llm import interpolation
from pagetab.llm.bpe import decode_ids, encode_texts
from pagetab.llm.interpolation import crc_fold, learn_weights, score_texts
from pagetab.llm.mixing import mix_sources
from pagetab.llm.quality import fit, fit_ordinal, grade_texts, rated
from pagetab.llm.rules import judge_texts
from pagetab.llm.simhash import near_links, simhash_groups
from pagetab.llm.substrings import drop_repeats
from pagetab.llm.tokenfiles import token_files
from pagetab.llm.vectors import near_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id int, h string, component string, size int"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(1, 8))) for _ in range(n))


def awkward():
    """Rows with nulls in every column, empty and blank texts, copies, repeated rows, one long text."""
    passage = prose(1, 60)
    texts = [
        prose(2, 80), prose(2, 80), prose(3, 80) + " " + passage, prose(4, 30) + "\n" + passage, None, "", " \t\n", "one", "one two",
        "x " * 70, "y\x1cz a", prose(5, 6000), "Ab aB AB ab " * 12, passage, "<|endoftext|> <|startoftext|>", "ß é 日本語 \U0001F680",
    ]
    rows = [(i, t, ("en", None, "xx")[i % 3], (None, "a", "b", "B")[i % 4], len(t or ""), i % 2, "h", "c", 1) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, None, None, None, None, None, None, None, None), (None, passage, None, "a", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return WORD.findall(text or "")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_simhash_groups(spark, docs, empty):
    def fingerprint(text, width=3):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not w:
            return 0
        runs = [" ".join(w[i: i + width]) for i in range(max(1, len(w) - width + 1))]
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = [(i, fingerprint(t)) for i, t, *_ in awkward()]
    group = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if (x ^ y).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((r[0] for r, k in zip(rows, group, strict=True) if k == g and r[0] is not None), default=None) for g in set(group)}
    want = [(r[0], r[1] - (r[1] >> 63 << 64), least[g]) for r, g in zip(rows, group, strict=True)]
    assert ordered(simhash_groups(docs, width=3).select("id", "fp", "component").collect()) == ordered(want)
    assert simhash_groups(empty, width=3).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_of_crowds_are_whole(spark, tmp_path, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 3)
    fps = {int(b) for b in base}
    for _ in range(150):  # near copies of near copies
        x = sorted(fps)[rng.integers(len(fps))]
        fps.add(x ^ 1 << int(rng.integers(0, 20)) ^ (1 << int(rng.integers(0, 20)) if rng.integers(2) else 0))
    fps = sorted(fps)
    for crowd in (1, 1000):
        edges = near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), f"{tmp_path}/{crowd}", distance, crowd).collect()
        assert all((u ^ v).bit_count() <= distance for u, v in edges)

        def roots(pairs):
            at = {f: f for f in fps}
            for _ in fps:
                for u, v in pairs:
                    at[u] = at[v] = min(at[u], at[v])
            return at

        assert roots(edges) == roots([(u, v) for u in fps for v in fps if u < v and (u ^ v).bit_count() <= distance])


@pytest.mark.parametrize("window", [2, 7, 35])
def test_drop_repeats(docs, empty, window):
    rows = awkward()
    count = collections.Counter(tuple(words(t)[i: i + window]) for _, t, *_ in rows for i in range(len(words(t)) - window + 1))
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [any(count[tuple(w[s: s + window])] > 1 for s in range(max(0, k - window + 1), min(k, len(w) - window) + 1)) for k in range(len(w))]
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = drop_repeats(docs, window, keep=("h", "lang"))
    assert ordered(got.select("id", "n_words", "n_removed", "kept").collect()) == ordered(want)
    assert got.columns[-2:] == ["lang", "h"] and drop_repeats(empty, window).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for label in (1, 2, None):
        centre = rng.normal(size=(6, 12))
        for k in range(70):
            v = centre[k % 6] + rng.normal(size=12) * (0.02, 0.25, 0.5)[k % 3]
            rows.append((n, [float(x) for x in v], label, "x"))
            n += 1
    rows += [(n, rows[3][1], 1, "x"), (n + 1, [x * 1e200 for x in rows[3][1]], 1, "x"), (n + 2, None, 1, "x"), (n + 3, [0.0] * 12, 1, "x")]
    rows += [(n + 4, [None, *rows[3][1][1:]], 1, "x"), (n + 5, [float("nan")] * 12, 1, "x"), (n + 6, [], 1, "x"), (n + 7, [1.0, 2.0], 1, None), rows[5]]
    rows.append((n + 8, [float("inf")] * 12, 1, "x"))
    near = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, size string").repartition(3)

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(v, w):
        v, w = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
        return v @ w / math.sqrt((v @ v) * (w @ w))

    ok = [r[2] is not None and usable(r[1]) for r in rows]
    link = [[bool(a != b and ok[a] and ok[b] and r[2] == s[2] and len(r[1]) == len(s[1]) and cosine(r[1], s[1]) >= 0.93)
             for b, s in enumerate(rows)] for a, r in enumerate(rows)]
    group = [r[0] for r in rows]
    for _ in range(30):
        for a in range(len(rows)):
            for b in range(len(rows)):
                if link[a][b]:
                    group[a] = group[b] = min(group[a], group[b])
    want = ordered((r[0], sum(link[a]), group[a], group[a] == r[0]) for a, r in enumerate(rows))
    for block in (4, 1024):
        assert ordered(near_vectors(near, block=block).collect()) == want
    assert near_vectors(near.limit(0)).count() == 0


def test_mix_sources(spark, docs, empty):
    got = mix_sources(docs).collect()
    assert len(got) == len(awkward())
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in awkward())
    assert all(0 <= r["copies"] <= 3 for r in got) and mix_sources(empty).count() == 0
    rng = np.random.default_rng(1)
    rows, text = [], lambda n: " w" * n
    for i in range(3000):
        source = "hot" if i % 3 else (None, "a", "Z", "é", "z")[i % 5]
        rows.append((i, text(40 if i % 4 == 0 else int(rng.integers(0, 300))), source))
    rows += [(5000 + i, text(1), "tiny") for i in range(7)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(made).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        per = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * per > 3 * size[s]} or set()
        for s in full or free:
            target[s] = 3 * size[s] if full else weight[s] * per
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    source, taken = {i: s for i, _, s in rows}, collections.Counter()
    for r in got:
        taken[source[r["id"]]] += r["copies"] * r["size"]
        assert r["target"] == pytest.approx(target[source[r["id"]]]) and r["source_size"] == size[source[r["id"]]]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(40, 0.01 * target[s])
    assert ordered(mix_sources(made.repartition(5)).collect()) == ordered(got)


def test_bpe_is_the_librarys(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = encode_texts(docs)
    want = [(i, theirs.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in awkward()]
    assert ordered(encoded.collect()) == ordered(want)
    assert ordered(decode_ids(encoded).select("id", "text").collect()) == ordered((i, t or "") for i, t, *_ in awkward())
    odd = docs.sparkSession.createDataFrame([(1, [255, 100, 999999]), (2, None)], "id long, ids array<int>")
    assert [r["text"] for r in decode_ids(odd).orderBy("id").collect()][1] == ""
    assert encode_texts(empty).count() == 0 and encode_texts(docs, keep=("h",)).columns == ["id", "ids", "h"]


def test_token_files(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    rows = [(i, theirs.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in awkward()]
    got = token_files(docs, block=64).collect()
    # rows of one id are in the order of a hash, so starts are compared where ids are single
    assert ordered((r["id"], list(np.frombuffer(r["ids"], "<u4"))) for r in got) == ordered(rows)
    starts = sorted((r["start"], len(r["ids"]) // 4, r["id"]) for r in got)
    for start, n, doc in starts:
        assert start == at
        at += n
        want.append(doc)
    assert want == sorted(want, key=lambda d: (d is not None, d or 0)) and token_files(empty).count() == 0


def test_quality_rules(docs, empty):
    got = {}
    for r in judge_texts(docs).collect():
        got.setdefault(r["id"], []).append(r)
    for i, t, *_ in awkward():
        w = words(t)
        seen = collections.Counter(tuple(w[k: k + 5]) for k in range(len(w) - 4))
        repeated = sum(any(seen[tuple(w[s: s + 5])] > 1 for s in range(max(0, k - 4), min(k, len(w) - 5) + 1)) for k in range(len(w)))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated, failed)
        measured = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got[i]]
        assert want in measured and all(not (r["kept"] and r["base_failed"]) for r in got[i])
    assert judge_texts(empty).count() == 0


def test_fertility_bands(spark):
    good = "This is an ordinary sentence about a library that reads many tables, and nothing in it repeats too often. " \
        "Another one follows here with different words, so that its pieces are as varied as those of any other prose."
    bytes_only = " ".join(chr(0x1F300 + i) + chr(0x10900 + i) for i in range(60))
    rows = [(1, good, "en"), (2, bytes_only, "en"), (3, good, None), (4, good + good.replace("a", "b"), "zz")]
    got = {r["id"]: r for r in judge_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1]["kept"] and got[3]["kept"] and got[3]["band"] == "latin" and got[4]["band"] == "latin"
    assert "bytes" in got[2]["reasons"] and got[2]["byte_share"] > 0.5


def test_ordinal_model(spark, docs, empty):
    rng = np.random.default_rng(3)
    fine, poor, foul = ["alpha", "beta", "gamma"], ["junk&&&", "noise%%%"], ["vile"]
    rows, grades = [], []
    for i in range(400):
        filler = [f"w{rng.integers(300)}" for _ in range(40)]
        grade = int(rng.integers(3))
        extra = (foul * 2, poor * 6, fine * 2)[grade]
        rows.append((i, " ".join(rng.permutation(filler + extra))))
        grades.append((i, grade, "clash"))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*grades, (None, 1, "x"), (7000, 0, "x"), (3, None, "x")], "doc_id long, grade int, text string")
    model = fit(made.where("doc_id < 300"), rated(labels, F.col("grade")), 3)
    assert model.thresholds == tuple(sorted(model.thresholds))
    got = {r["id"]: r for r in grade_texts(made, model, 2).collect()}
    held_out = [g for g in grades if g[0] >= 300]
    assert np.mean([got[i]["kept"] == (g == 2) for i, g, _ in held_out]) > 0.95
    means = [np.mean([got[i]["expected_grade"] for i, g, _ in held_out if g == k]) for k in range(3)]
    assert means == sorted(means)
    assert grade_texts(docs, model, 1, keep=("text", "h")).count() == len(awkward()) and grade_texts(empty, model, 1).count() == 0
    assert all(r["kept"] for r in grade_texts(docs, fit_ordinal([], np.zeros(0, int), 3), 2).collect())
    same = fit(made.where("doc_id < 300").repartition(7), rated(labels.repartition(4), F.col("grade")), 3)
    assert same == model


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_interpolation(docs, empty, chunk):
    rows = [(zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2, [*(t or "").encode().lower().split(), None]) for i, t, *_ in awkward()]
    one, two = collections.Counter(), collections.Counter()
    for out, w in rows:
        if not out:
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    got = score_texts(docs, crc_fold(F.col("doc_id")) == 2, chunk=chunk, dev=2).collect()
    want = [(out, len(w), sum(x in one for x in w), n, v, round(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), 6)) for out, w in rows]
    assert ordered((*r[1:6], round(r["base_score"], 6)) for r in got) == ordered(want)
    assert all(r["score"] <= 0 for r in got) and score_texts(empty, F.lit(False)).count() == 0
    assert all(r["score"] == 0 for r in score_texts(docs.where("doc_id < 3"), F.lit(True)).collect())


def test_interpolation_is_a_distribution(spark, monkeypatch):
    """Scores are those of the mixture by plain counting, and the mixture sums to one over the vocabulary and one unknown word."""
    learned = []
    monkeypatch.setattr(interpolation, "learn_weights", lambda cells: learned.append(learn_weights(cells)) or learned[-1])
    train = ["a b a c", "b b a", "c a", "a b", "c", ""] * 5
    texts = [*train, "a b other", "zz zz", "c c c a", "other"]
    rows = [(i, t, i >= len(train)) for i, t in enumerate(texts)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string, out boolean"), F.col("out"), dev=3).collect()
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        w = [*t.split(), None]
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
    n, v, weights = sum(one.values()), len(one), learned[0]

    def p(context, word):
        w = weights[interpolation._bucket(np.array([one[context]]))[0]]
        return w[0] * two[(context, word)] / max(one[context], 1) + w[1] * one[word] / n + w[2] / (v + 1)

    for r in got:
        w = [*texts[r["id"]].split(), None]
        assert r["score"] == pytest.approx(sum(math.log10(p(c, x)) for c, x in zip([None, *w], w, strict=False)))
    for context in (*one, "zz"):
        assert sum(p(context, x) for x in one) + p(context, "zz") == pytest.approx(1)


def test_learned_weights_favour_what_predicts():
    good = np.array([[3, 80, 0, 1000], [3, interpolation._NEVER, 8, 50]], np.int64)
    w = learn_weights(good)
    assert w[3, 0] > 0.8 and np.allclose(w.sum(axis=1), 1)


def test_digests_are_of_the_texts(docs):
    """sha256 columns of the queries are derived from the operator's texts."""
    got = drop_repeats(docs, 35).select("id", F.sha2("kept", 256).alias("s"), "kept").collect()
    assert all(r["s"] == hashlib.sha256(r["kept"].encode()).hexdigest() for r in got)


def test_script_of_the_whole_text(spark):
    """Letters between the evenly spread characters count; short texts of byte pieces alone go."""
    records = " ".join("a" + "\u0431\u0432" for _ in range(512))  # every fourth character is a Latin letter
    rare = " ".join(chr(0xA500 + k) for k in range(11))
    rows = [(1, records, None), (2, rare, "en"), (3, "a plain short text of eleven words that is kept as before", "en"), (4, "", None)]
    got = {r["id"]: r for r in judge_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1]["band"] == "cyrillic" and got[4]["band"] == "other"
    assert got[2]["n_pieces"] < 48 and "bytes" in got[2]["reasons"] and got[3]["kept"]
