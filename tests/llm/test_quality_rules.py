"""The ordinal model and the tokenizer's measures, computed again plainly."""

import collections
import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pagetab.llm import mixing, quality, rules
from pagetab.llm.mixing import mix_sources


def loss(docs, grades, n_grades, model, prior=1.0):
    """Negative log likelihood of the mean document, with the penalty of the weights."""
    total = 0.0
    for d, g in zip(docs, grades, strict=True):
        score = sum(model.weights.get(int(x), 0.0) for x in d)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in model.thresholds), 1.0]
        total -= math.log(below[g + 1] - below[g])
    return total / len(docs) + prior / len(docs) / 2 * sum(w * w for w in model.weights.values())


def test_fit_is_where_no_parameter_improves():
    rng = np.random.default_rng(3)
    worth = rng.normal(size=12)
    docs = [np.unique(rng.integers(0, 12, 5)) for _ in range(300)]
    scores = np.array([worth[d].sum() for d in docs]) + rng.logistic(size=300)
    grades = np.digitize(scores, [-1.0, 1.0])
    model = quality.fit_ordinal(docs, grades, 3, rounds=3000, rate=0.02)
    at = loss(docs, grades, 3, model)
    assert list(model.thresholds) == sorted(model.thresholds) and at < loss(docs, grades, 3, quality.Ordinal({}, model.thresholds))
    for k in model.weights:
        for step in (-0.05, 0.05):
            assert loss(docs, grades, 3, quality.Ordinal(model.weights | {k: model.weights[k] + step}, model.thresholds)) > at
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = tuple(t + step * (i == k) for i, t in enumerate(model.thresholds))
            assert loss(docs, grades, 3, quality.Ordinal(model.weights, moved)) > at


def test_all_of_a_long_word_counts(spark):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghij"), 4000))
    found = quality.features(text.encode(), quality._WordFeatures())
    assert len(found) > 2000
    other = text[:-4] + "zzzz"
    assert {quality._hash(b"w", b"x")} | found != found
    last = quality.features(other.encode(), quality._WordFeatures()) - found
    assert set(quality._grams(b"zzzz" * 20)) <= last
    wide = "日本語の文章" * 900
    assert len(quality.features(wide.encode(), quality._WordFeatures())) >= 6 + 6
    shapes = [quality._shape(w.translate(quality._SIGNS)) for w in (b"aBaBaBaBaBaBaB1", b"aBaBaBaBaBaBaB-")]
    assert shapes[0] != shapes[1]


def test_grades_are_the_model_s(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["good", "plain", "foul", "Word", "x1"], 8))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "good " * 4000), (503, "g" * 5000), (None, "good foul"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "doc_id")
    labels = spark.createDataFrame([(i, 2 - min(2, t.count("foul"))) for i, t in rows[:200]], "id long, grade int")
    model = quality.fit(docs, labels, n_grades=3)
    graded = quality.grade_texts(docs, model, least_grade=1, least_tail=0.4).collect()
    assert len(graded) == len(rows)
    for (i, t), r in zip(sorted(rows, key=str), sorted(graded, key=lambda r: str((r.id, dict(rows).get(r.id)))), strict=True):
        score = sum(sorted(model.weights.get(x, 0.0) for x in quality.features((t or "").encode(), quality._WordFeatures())))
        tails = [1 / (1 + math.exp(k - score)) for k in model.thresholds]
        assert (r.id, r.score) == (i, pytest.approx(score)) and r.tail == pytest.approx(tails[0]) and r.expected_grade == pytest.approx(sum(tails))
        assert r.kept == (tails[0] >= 0.4)


def test_fit_takes_a_bounded_sample(spark, monkeypatch):
    rows = [(i, f"word{i % 7} " * 9 + f"only{i}") for i in range(300)]
    docs, ratings = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "id long, grade int")
    seen = []
    monkeypatch.setattr(quality, "fit_ordinal", lambda found, grades, n: seen.append((len(found), max(map(len, found)))))
    monkeypatch.setattr(quality, "MOST_FEATURES", 3)
    quality.fit(docs, ratings, 2, sample=40)
    assert seen == [(40, 3)] or seen[0][0] == 40


def test_measures_of_pieces(spark):
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "ꔀꔁ", "x", "größe", "12345", "日本語"], n)) for n in (1, 3, 20, 60, 700)]
    texts += [None, "", " \n", "loop " * 200, "ꔀ" * 40, "a b c d e f g h i j k l"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in rules.judge_texts(docs).collect():
        words = (texts[r.id] or "").split()
        ids = [p for w in words for p in pieces.encode(w)]
        assert (r.n_words, r.n_pieces, r.word_chars, r.band) == (len(words), len(ids), sum(map(len, words)), "en")
        if not ids:
            assert (r.chars_per_piece, r.byte_share, r.entropy) == (None, None, None) and not r.kept
            continue
        counts = collections.Counter(ids).values()
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts)
        share = sum(map(pieces.is_byte, ids)) / len(ids)
        assert (r.chars_per_piece, r.byte_share, r.entropy) == (
            pytest.approx(r.word_chars / len(ids)), pytest.approx(share), pytest.approx(entropy, abs=1e-9))
        low, high, most, least = rules.BANDS["en"]
        slack = rules.DEVIATIONS / math.sqrt(len(ids))
        want = {"words"} if len(words) < 10 else set()
        want |= {"repetition"} if 100 * r.n_repeat_words > 20 * len(words) else set()
        want |= set() if low * (1 - slack) <= r.chars_per_piece <= high * (1 + slack) else {"fertility"}
        want |= {"bytes"} if share > most + slack * math.sqrt(most * (1 - most)) else set()
        want |= {"entropy"} if entropy < (least - slack) * math.log2(min(len(ids), 256)) else set()
        assert set(r.reasons) == want and r.kept == (not want)


def test_mixing_tells_when_steps_do_not_suffice(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 90
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="not met"):
        mix_sources(docs).count()
