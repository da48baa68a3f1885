"""Compare two keyed tables, and runs with what was expected of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def canonical_key(value: Column) -> Column:
    """Lower case, with every run of ``-``, ``_`` and ``.`` as one dash."""
    return F.lower(F.regexp_replace(value, "[-_.]+", "-"))


def reconcile(listed: DataFrame, present: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer comparison by canonical key: key, n_listed, n_present, status.

    status is missing, extra, duplicate, mismatch or match. Both sides are
    aggregated by key before they meet, so repeated keys cost nothing in the join.
    """

    def side(table: DataFrame, name: str) -> DataFrame:
        picked = F.struct(*values)
        return table.groupBy(canonical_key(F.col(key)).alias("key")).agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.min(picked).alias(f"{name}_low"), F.max(picked).alias(f"{name}_high")
        )

    both = side(listed, "listed").join(side(present, "present"), "key", "full_outer")
    same = (F.col("listed_low") == F.col("present_low")) & (F.col("listed_high") == F.col("present_high"))
    status = (
        F.when(F.col("n_present").isNull(), F.lit("missing"))
        .when(F.col("n_listed").isNull(), F.lit("extra"))
        .when((F.col("n_listed") > 1) | (F.col("n_present") > 1), F.lit("duplicate"))
        .when(~F.coalesce(same, F.lit(False)), F.lit("mismatch"))
        .otherwise(F.lit("match"))
    )
    zero = F.lit(0).cast("bigint")
    return both.select(
        "key", F.coalesce("n_listed", zero).alias("n_listed"), F.coalesce("n_present", zero).alias("n_present"),
        status.alias("status"),
    )


def all_match(compared: DataFrame) -> DataFrame:
    """One row: whether everything agrees, and the number of keys per finding."""
    found = [
        F.count_if(F.col("status") == s).alias(s) for s in ("missing", "extra", "duplicate", "mismatch", "match")
    ]
    return compared.agg(F.coalesce(F.bool_and(F.col("status") == "match"), F.lit(True)).alias("all_match"), *found)


def missing_keys(compared: DataFrame) -> DataFrame:
    """Listed keys that are not present, sorted at the sink."""
    return compared.where(F.col("status") == "missing").select("key").orderBy("key")


def check_expectations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows by case name against actual rows: name, errors, passed.

    Both carry status, exit, requests, documents, stop_reason and document_hash
    (null means not stated); actual also attempts (by a ledger), download_errors and
    other_records. A run of which no documents are expected must have one failed
    download and no record of any other kind.
    """
    a, e = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"e.{c}"))
    joined = expected.alias("e").join(actual.alias("a"), F.col("e.name") == F.col("a.name"), "left")
    checks = [
        *[F.when(~a(c).eqNullSafe(e(c)), F.lit(f"{c} mismatch")) for c in ("exit", "status", "requests", "documents")],
        F.when(~a("attempts").eqNullSafe(a("requests")), F.lit("ledger disagrees")),
        *[
            F.when(e(c).isNotNull() & ~a(c).eqNullSafe(e(c)), F.lit(f"{c} mismatch"))
            for c in ("stop_reason", "document_hash")
        ],
        F.when(
            (e("documents") == 0)
            & ((F.coalesce(a("download_errors"), F.lit(0)) != 1) | (F.coalesce(a("other_records"), F.lit(0)) != 0)),
            F.lit("not just one failed download"),
        ),
    ]
    return (
        joined.select(e("name").alias("name"), F.array_compact(F.array(*checks)).alias("errors"))
        .withColumn("passed", F.size("errors") == 0)
    )


def all_passed(checked: DataFrame) -> DataFrame:
    return checked.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))
