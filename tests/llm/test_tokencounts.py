"""Token counts against the libraries, and what the cache saves."""

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from pagetab.llm import tokencounts
from pagetab.llm.common import scratch
from pagetab.llm.queries import op13_tokencounts

TEXTS = [
    None, "", " ", "a b", "a▁b", "a  b", "x <s> y </s> <unk>", "<|endoftext|> end", "日本語 ß \U0001F680", "\u0000 \r\n\t", "one " * 3000,
    "long" * 20000, "ﬁ é é", "A b", "a B",
]


def rows():
    return [*enumerate(TEXTS), (3, "a b"), (99, "a b"), (None, "a b"), (None, None)]


def counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(name, limit=4096):
    some = rows()
    return sorted(
        ((i, len((t or "").encode()), n, n > limit) for (i, t), n in zip(some, counts(name, [t for _, t in some]), strict=True)), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'x' AS digest").repartition(3).cache()


def tidy(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("few", [0, 10**6])
def test_counts(spark, docs, name, few):
    cache = scratch(spark, "cache")
    assert tidy(tokencounts.count_tokens(docs, cache, name, few=few)) == expected(name)
    assert tidy(tokencounts.count_tokens(docs, cache, name, limit=3, few=few)) == expected(name, 3)


@pytest.mark.parametrize("few", [0, 10**6])
def test_only_distinct_misses_are_encoded(spark, docs, few):
    cache = scratch(spark, "cache")
    name = "piece_bpe_32k.model"
    first = docs.where("doc_id < 6")
    tokencounts.count_tokens(first, cache, name, few=few).collect()
    # '' and null are one text, and so are the two ways to write a space
    assert spark.read.parquet(cache).count() == 4
    before = {f for f in spark.read.parquet(cache).inputFiles()}
    tokencounts.count_tokens(first, cache, name, few=few).collect()
    assert set(spark.read.parquet(cache).inputFiles()) == before
    assert tidy(tokencounts.count_tokens(docs, cache, name, few=few)) == expected(name)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("version", "digest").distinct().count() == len({(t or "").replace(" ", "▁") for t in TEXTS})


def test_stored_counts_are_taken(spark, docs):
    """What the cache says counts, whoever stored it, and a digest stored twice is one."""
    cache, name = scratch(spark, "cache"), "piece_bpe_32k.model"
    tokencounts.count_tokens(docs, cache, name).collect()
    spark.read.schema(tokencounts.SCHEMA).parquet(cache).write.mode("append").partitionBy("version").parquet(cache)
    assert tidy(tokencounts.count_tokens(docs, cache, name)) == expected(name)
    other = scratch(spark, "other")
    spark.read.schema(tokencounts.SCHEMA).parquet(cache).selectExpr("version", "digest", "n_tokens + 1000 AS n_tokens").distinct().write.partitionBy(
        "version").parquet(other)
    assert tidy(tokencounts.count_tokens(docs, other, name)) == sorted(((i, b, n + 1000, n + 1000 > 4096) for i, b, n, _ in expected(name)), key=str)


def test_versions_are_apart(spark, docs):
    cache = scratch(spark, "cache")
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        assert tidy(tokencounts.count_tokens(docs, cache, name)) == expected(name)
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_empty_table(spark, docs):
    assert tokencounts.count_tokens(docs.where("false"), scratch(spark, "cache")).count() == 0


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert tidy(op13_tokencounts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit")) == expected("piece_bpe_32k.model")
