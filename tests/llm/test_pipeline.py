"""The pipeline's stages in order, each against a plain version of what it decides; the registered queries."""

import collections
import glob
import os
import sys

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from pagetab.llm.simhash import fingerprint

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_check import compare, connect  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, foul and poor ones, copies, near copies, a shared passage, nulls."""
    rng = np.random.default_rng(8)
    passage, rows, labels = text(rng, 70), [], []
    for i in range(240):
        words = text(rng, 120).split()
        grade = (1, 0)
        if i % 6 == 1:
            words[7], words[60], grade = "vileword", "foulword", (1, 1)
        elif i % 6 == 2:
            words, grade = [w + "&&&" for w in words], (0, 0)
        rows.append((i, " ".join(words), "en", "ab"[i % 2], 0))
        labels.append((i, *grade))
    clean = [i for i in range(240) if i % 6 not in (1, 2)]
    for k, i in enumerate(clean[:8]):
        rows.append((500 + k, rows[i][1].upper() if k % 2 else rows[i][1], "en", "a", 0))
    for k, i in enumerate(clean[8:16]):
        words = rows[i][1].split()
        words[50] = "changed"
        rows.append((600 + k, " ".join(words), "en", "b", 0))
    for k, i in enumerate(clean[16:20]):
        rows[i] = (i, rows[i][1] + "\n" + passage, "en", "ab"[i % 2], 0)
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, passage, "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, clean, passage


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{folder[0]}/documents.parquet")
    where = tmp_path_factory.mktemp("stages")
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder[0]).write.parquet(f"{where}/{n}")
        docs = spark.read.parquet(f"{where}/{n}")
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources", "BPE"]
    assert all(df.columns == COLUMNS for df in stages[:4])


def test_classifier_keeps_clean_documents(stages, folder):
    kept = {r.doc_id for r in stages[0].collect()}
    assert set(folder[1]) <= kept and not [i for i in range(240) if i % 6 in (1, 2) and i in kept]


def groups(rows):
    """Number of each text's group, by all pairs of fingerprints."""
    fps = [fingerprint((t or "").encode(), 3) for _, t in rows]
    group = list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    for _ in range(8):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return group


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    group = groups(rows)
    first = {min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    after = [r.doc_id for r in stages[1].collect()]
    assert sorted(after) == sorted(first) and not set(after) & set(range(500, 508))


def test_passages_go(stages, folder):
    """Words of windows that start more than once go; texts without any stay as they are."""
    had = {r.doc_id: (r.text or "").split() for r in stages[1].collect()}
    windows = lambda w: [tuple(w[i: i + pipeline.WINDOW]) for i in range(len(w) - pipeline.WINDOW + 1)]
    seen = collections.Counter(x for w in had.values() for x in windows(w))
    want = {}
    for i, w in had.items():
        gone = {k + j for k, x in enumerate(windows(w)) if seen[x] > 1 for j in range(pipeline.WINDOW)}
        if not gone or len(gone) < len(w):
            want[i] = [x for k, x in enumerate(w) if k not in gone]
    got = {r.doc_id: r.text for r in stages[2].collect()}
    assert {i: (t or "").split() for i, t in got.items()} == want
    assert 902 not in got and any(len(w) < len(had[i]) for i, w in want.items())
    assert all(t == r.text for r in stages[1].collect() if (t := got.get(r.doc_id)) and len(want[r.doc_id]) == len(had[r.doc_id]))


def test_mixture_repeats_documents(stages):
    had = {r.doc_id: r for r in stages[2].collect()}
    got = collections.Counter(r.doc_id for r in stages[3].collect())
    assert set(got) <= set(had) and max(got.values()) <= 3
    size = {i: len((r.text or "").split()) for i, r in had.items()}
    total = sum(size.values())
    by = collections.Counter()
    for i, n in got.items():
        by[had[i].source] += n * size[i]
    assert abs(sum(by.values()) - total) < 0.03 * total and by["a"] > 2 * by["b"]


def test_tokens_decode(stages):
    rows = stages[4].collect()
    assert rows and all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    assert len(rows) == stages[3].count()


def test_repeated_rows(spark, folder):
    """Every stage takes rows that repeat: one stays of a group, a mix takes copies of both."""
    docs = spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 1)] * 3 + [(2, "x y z", None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, docs, folder[0]).where("doc_id > 0").collect()) == [1, 2]
    assert pipeline.passages(spark, docs, folder[0]).count() == 5
    assert pipeline.mixture(spark, docs, folder[0]).count() >= 1
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_run_and_registration(spark, folder, stages):
    assert sorted(r.doc_id for r in entry.queries()["pipeline"](spark, folder[0]).collect()) == sorted(r.doc_id for r in stages[4].collect())
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" not in entry.oracle_sql()


def test_ids_of_several_texts(spark, folder):
    """Texts that are no copy of anything stay, whatever else their ids stand for."""
    rng = np.random.default_rng(21)
    a, b, c, d, e = (text(rng, 60) for _ in range(5))
    rows = [(1, a), (2, a.upper()), (2, b), (2, b), (3, c), (3, d), (3, c.upper()), (4, c), (None, a), (None, e), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "h") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h string")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_copies(spark, docs, folder[0]).collect()), key=str)
    assert got in (sorted([(1, a), (2, b), (3, x), (3, d), (None, e)], key=str) for x in (c, c.upper()))


@pytest.mark.parametrize("name", sorted(entry.LLM_SQL))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_links_against_sql(spark, tmp_path):
    """The given vectors have no links in the small tables: these do, in chains, with repeats, nulls and zero vectors."""
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(12, 8))
    for i in range(160):
        x = base[i % 12] + rng.normal(size=8) * (0.05, 0.2, 0.35)[i % 3]
        rows.append((i, x.tolist(), (None, "a", "b")[i % 7 % 3]))
    rows += [(200, None, "a"), (201, [0.0] * 8, "a"), (202, rows[1][1], "a"), (203, [float("nan")] * 8, "a"), (204, [1.0, None] * 4, "a")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    os.rename(glob.glob(f"{tmp_path}/parts/*.parquet")[0], f"{tmp_path}/embeddings.parquet")
    query = entry.queries()["op4_vectors"]
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), query, entry.oracle_sql()["op4_vectors"]) is None
    assert query(spark, str(tmp_path)).where("n_links > 0").count() > 40
