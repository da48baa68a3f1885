"""Ledger audits and reconciliation against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pagetab.operators import audits, reconcile as rec
from pagetab.sources import schemas


def test_scope(spark):
    rows = [("c", "https://e.com/a", "/a", "GET", 1.0, None, None), ("c", "https://o.org/a", "/a", "GET", 1.0, None, None),
            ("c", "https://e.com/?token=x", "/", "GET", 1.0, None, None), ("c", "https://e.com/a", "/a", "POST", 1.0, None, None),
            ("c", "https://e.com/a", "/a", "GET", 1.0, "s=1", None), ("c", "https://e.com/a", "/a", "GET", 1.0, None, "Basic"),
            ("ghost", "https://e.com/a", "/a", "POST", 1.0, "s=1", None)]
    policies = spark.createDataFrame([("c", "https://e.com")], "crawl_id string, allowed_origin string")
    found = audits.scope_violations(spark.createDataFrame(rows, schemas.REQUESTS), policies)
    assert sorted(r.violation for r in found.collect()) == ["authorization", "cookie", "invalid_or_sensitive_url", "method", "no_policy", "outside_origin"]


@pytest.mark.parametrize("parts", [1, 8, 50])
def test_gaps_agree_with_a_sorted_loop(spark, parts):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot"] * 8 + ["a", "b"]), rnd.randrange(40_000_000) / 1000) for i in range(4000)]
    rows += [(4000 + i, "hot", 5000.25) for i in range(5)]
    df = spark.createDataFrame(rows, "request_id bigint, crawl_id string, time double")
    got = {r.request_id: r.gap for r in audits.request_gaps(df, parts=parts).collect()}
    last, want = {}, {}
    for i, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = None if c not in last else round(t - last[c], 6)
        last[c] = t
    assert {k: None if v is None else round(float(v), 6) for k, v in got.items()} == want


def test_a_busy_hour_is_spread(spark, tmp_path):
    """All requests of one crawl within an hour, a third of them at one moment: ranges of about equal size."""
    rows = spark.range(30_000).selectExpr(
        "id AS request_id", "'hot' AS crawl_id", "CASE WHEN id % 3 = 0 THEN 1000.5D ELSE CAST(id % 3600 AS double) END AS time")
    sizes = [r["count"] for r in audits.laid_out(rows, str(tmp_path), parts=12).groupBy("_part").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 30_000 / 12
    gaps = audits.request_gaps(rows, f"{tmp_path}/gaps", parts=12)
    assert gaps.where("gap IS NULL").count() == 1 and gaps.where("gap < 0").count() == 0 and gaps.count() == 30_000
    assert round(float(gaps.agg(F.sum("gap")).first()[0]), 6) == 3599.0 - 1.0


def test_ledger(spark):
    reports = spark.createDataFrame([("ok", 2), ("twice", 2), ("short", 3), ("blocked", 1)], "crawl_id string, http_attempts int")
    requests = spark.createDataFrame([("ok", "u"), ("ok", "v"), ("twice", "u"), ("twice", "u"), ("short", "u"), ("blocked", "x"), ("stray", "u")],
                                     "crawl_id string, url string")
    blocked = spark.createDataFrame([("blocked", "x"), ("ok", "z")], "crawl_id string, url string")
    got = {r.crawl_id: r[1:] for r in audits.ledger_reconcile(reports, requests, blocked).collect()}
    assert got == {"ok": (2, 2, 0, 0, True), "twice": (2, 2, 1, 0, False), "short": (3, 1, 0, 0, False),
                   "blocked": (1, 1, 0, 1, False), "stray": (0, 1, 0, 0, False)}


def test_canonical_keys_and_manifest(spark):
    names = spark.createDataFrame([(v,) for v in ("lamp.post", "lamp_post", "Lamp-Post", "lamp._-post")], "v string")
    assert {r[0] for r in names.select(rec.canonical_key(F.col("v"))).collect()} == {"lamp-post"}
    listed = spark.createDataFrame([("A_b", 1, "x"), ("c", 1, "x"), ("d", 1, "x"), ("e", 1, "x"), ("n", None, "x")], schemas.MANIFEST)
    present = spark.createDataFrame([("a-B", 1, "x"), ("c", 2, "x"), ("e", 1, "x"), ("e", 1, "x"), ("f", 1, "x"), ("n", 1, "x")], schemas.MANIFEST)
    compared = rec.reconcile(listed, present, "path", ["bytes", "sha256"])
    assert {r.key: r.status for r in compared.collect()} == {
        "a-b": "match", "c": "mismatch", "d": "missing", "e": "duplicate", "f": "extra", "n": "mismatch"}
    assert rec.all_match(compared).first()[:] == (False, 1, 1, 1, 2, 1)
    assert [r.key for r in rec.missing_keys(compared).collect()] == ["d"]
    assert rec.all_match(compared.where("status = 'match'")).first().all_match


def test_expectations(spark):
    expected = spark.createDataFrame([("good", "partial", 2, 3, 2, "max_pages", "h"), ("free", "partial", 2, 3, 2, None, None),
                                      ("bad", "failed", 1, 2, 0, None, None), ("gone", "failed", 1, 2, 1, None, None),
                                      ("mixed", "failed", 1, 2, 0, None, None), ("one", "failed", 1, 2, 0, None, None)], schemas.EXPECTED)
    actual = spark.createDataFrame(
        [("good", "partial", 2, 3, 2, "max_pages", "h", 3, 0, 3), ("free", "partial", 2, 3, 2, "max_pages", "z", 3, 0, 3),
         ("bad", "failed", 1, 2, 0, "max_requests", None, 1, 2, 0), ("mixed", "failed", 1, 2, 0, None, None, 2, 1, 1),
         ("one", "failed", 1, 2, 0, None, None, 2, 1, 0)], schemas.EXPECTED + ", attempts bigint, download_errors bigint, other_records bigint")
    checked = rec.check_expectations(expected, actual)
    got = {r.name: r.errors for r in checked.collect()}
    assert got["good"] == [] and got["free"] == []
    assert got["bad"] == ["ledger disagrees", "not just one failed download"]
    assert got["mixed"] == ["not just one failed download"] and got["one"] == []
    assert "status mismatch" in got["gone"]
    assert not rec.all_passed(checked).first()[0] and rec.all_passed(checked.where("passed")).first()[0]
