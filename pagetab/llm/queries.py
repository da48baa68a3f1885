"""Registered queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetab.llm.bpe import decode_ids, encode_texts
from pagetab.llm.common import scratch
from pagetab.llm.interpolation import crc_fold, score_texts
from pagetab.llm.mixing import mix_sources
from pagetab.llm.periodic import find_runs
from pagetab.llm.quality import fit, grade_texts, rated
from pagetab.llm.rules import judge_texts
from pagetab.llm.simhash import simhash_groups
from pagetab.llm.spelling import spelling_groups, word_counts
from pagetab.llm.substrings import drop_repeats
from pagetab.llm.tokencounts import count_tokens
from pagetab.llm.tokenfiles import token_files
from pagetab.llm.vectors import near_vectors
from pagetab.llm.warc import archived_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade() -> Column:
    """Grade of a row of ``labels``: toxic (0), poor (1), good (2)."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of each document, and whether it is probably of the best grade."""
    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, rated(_table(spark, sf_dir, "labels"), grade()), n_grades=3)
    return grade_texts(docs, model, least_grade=2).withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles, linked at two or fewer differing bits."""
    return simhash_groups(_table(spark, sf_dir, "documents"), width=3, distance=2).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated bigrams learned from the documents outside fold 2 of 7."""
    docs = _table(spark, sf_dir, "documents")
    return score_texts(docs, crc_fold(F.col("doc_id")) == 2).withColumnRenamed("id", "doc_id")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at cosine 0.93 or more."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded with the byte-level vocabulary, and decoded again."""
    encoded = encode_texts(_table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json")
    return decode_ids(encoded, tokenizer="byte_bpe_50k.json").select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that start more than once."""
    return drop_repeats(_table(spark, sf_dir, "documents"), window=35).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules and bands of tokenizer fertility."""
    return judge_texts(_table(spark, sf_dir, "documents"), tokenizer="piece_bpe_32k.model").withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighing 5, 2, 1 in turn, none over three times its size."""
    return mix_sources(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "copies", "rate",
    )


def op9_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the word vocabulary, packed in files, read back."""
    return token_files(_table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", end_id=1).select(
        F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as response and revisit records, read back from the archives."""
    return archived_pages(_table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them damaged, under their most frequent spelling."""
    return spelling_groups(word_counts(_table(spark, sf_dir, "documents"), least_chars=6, least_n=5, damage=199), ratio=5)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in each document, some of them made periodic."""
    return find_runs(_table(spark, sf_dir, "documents"), loop=True).select(
        F.col("id").alias("doc_id"), "n_runs", "start", "length", "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by way of a cache of counts, new with each call."""
    return count_tokens(
        _table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), tokenizer="piece_bpe_32k.model", limit=4096
    ).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_interpolation": op3_interpolation,
    "op4_vectors": op4_vectors,
    "op5_bpe": op5_bpe,
    "op6_substrings": op6_substrings,
    "op7_fertility": op7_fertility,
    "op8_mixing": op8_mixing,
    "op9_tokenfiles": op9_tokenfiles,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_periodic": op12_periodic,
    "op13_tokencounts": op13_tokencounts,
}

_WINDOWS = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
begun AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
marked AS (SELECT r, i, md5(array_to_string(words[i : i + 34], ' ')) AS h FROM begun),
again AS (SELECT h FROM marked GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM marked JOIN again USING (h)),
word AS (SELECT r, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS w FROM d),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY k) AS kept FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = word.r AND gone.k = word.k) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""

_COSINES = r"""WITH RECURSIVE v AS (
  SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS x, list_transform(cast(embedding AS DOUBLE[]), lambda c: coalesce(c, 0)) AS y FROM embeddings),
usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.y, b.y) >= 0.93),
reach AS (
  SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
roots AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN roots ON roots.u = vec_id LEFT JOIN degrees ON degrees.u = vec_id"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INT) + 1, 1)"
    for k in range(8) for shift in (15, 10, 5, 0))

_DIGESTS = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS first FROM p)
SELECT page_id, cast(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

#: DuckDB SQL of the queries that SQL can express; hashes like CRC-32 and XXH64, tokenizers and fitted models are not among it.
SQL: dict[str, str] = {"op4_vectors": _COSINES, "op6_substrings": _WINDOWS, "op10_warc": _DIGESTS}
