"""A training corpus from ``documents``: five stages, each a table that the next one reads.

1. quality: documents that are probably not of the best grade go;
2. near copies: one document of each group of texts with near SimHash fingerprints stays;
3. passages: words in windows of 50 words that start more than once go;
4. mixture: documents are repeated or left out so that sources meet their targets;
5. tokens: texts become ids of the byte-level vocabulary.

All stages but the last return the columns of ``documents``; other columns are left out.
In every stage a null text is an empty one, and rows that repeat are handled alike but in
stage 2, where one of them stays. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetab.llm.bpe import decode_ids, encode_texts
from pagetab.llm.common import scratch, stored
from pagetab.llm.mixing import mix_sources
from pagetab.llm.quality import fit, grade_texts, rated
from pagetab.llm.queries import grade
from pagetab.llm.simhash import simhash_groups
from pagetab.llm.substrings import drop_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a repeated passage.
WINDOW = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is probably of the best grade, by a model fitted on the rated ones among ``docs``; without any, all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, rated(labels, grade()), n_grades=3)
    graded = grade_texts(docs, model, least_grade=2, keep=COLUMNS[1:])
    return graded.where("kept").withColumnRenamed("id", "doc_id").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints of three-word shingles links of two bits or fewer connect.

    It is the one with the smallest id, nulls last (of texts with that id, the one with the smallest
    hash). An id may stand for several texts, which are grouped by themselves. Texts
    without words are one group. Of rows that agree in id and text one stays.
    """
    rows = docs.select(*COLUMNS).withColumn("h", F.xxhash64("text"))
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    groups = simhash_groups(rows.select(named.alias("name"), "text"), width=3, distance=2, id_col="name")
    first = groups.where("keep").groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id.id", F.col("id.h").alias("first_h"), "n")
    first = stored(first, f"{scratch(spark, 'near')}/first")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("first_h"))
    once = rows.join(first.where("n = 1"), same, "left_semi")
    again = rows.join(first.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "h"])
    return once.unionByName(again).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; texts without any stay as they are, texts of nothing else go."""
    cut = drop_repeats(docs, window=WINDOW, keep=COLUMNS[1:])
    whole = F.col("n_removed") == 0
    return (
        cut.where(whole | (F.col("n_removed") < F.col("n_words")))
        .withColumn("text", F.when(whole, F.col("text")).otherwise(F.col("kept")))
        .withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("kept").cast("long")))
        .withColumnRenamed("id", "doc_id").select(*COLUMNS)
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that agree in id and text share their copies."""
    # rows of one id and text share a key; what their copies add up to is dealt out in order
    taken = mix_sources(docs).groupBy("id", "h").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    taken = stored(taken.where("copies > 0"), f"{scratch(spark, 'copies')}/taken")
    rows = docs.select(*COLUMNS).withColumn("h", F.xxhash64("doc_id", "text"))
    key = F.col("h") == F.col("mix_h")
    taken = taken.select(F.col("id").alias("mix_id"), F.col("h").alias("mix_h"), "copies", "n")
    once = rows.join(taken.where("n = 1"), key & F.col("doc_id").eqNullSafe(F.col("mix_id")))
    again = rows.join(taken.where("n > 1"), key & F.col("doc_id").eqNullSafe(F.col("mix_id"))).dropDuplicates(["doc_id", "h"])
    both = once.unionByName(again).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return both.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, exact): ids of each text (none for a null text), and whether they decode to it."""
    encoded = encode_texts(docs, tokenizer="byte_bpe_50k.json", keep=("source", "lang", "text"))
    decoded = decode_ids(encoded, tokenizer="byte_bpe_50k.json", keep=("source", "lang", "text"), out="decoded")
    return decoded.select(
        F.col("id").alias("doc_id"), "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"))


STAGES = [
    ("quality classifier", quality), ("SimHash near-dedup", near_copies), ("substring dedup", passages),
    ("mixing sources", mixture), ("BPE", tokens),
]

#: Classifier, fingerprints and merges have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{i}")
    return docs
