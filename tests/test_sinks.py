"""Files written, read back, and never overwritten."""

import csv
import glob
import json
import os

import pytest
from pyspark.errors import AnalysisException

from pagetab.operators.reports import report_json, run_summaries
from pagetab.sources.shared import shared_folder
from pagetab.sources.capture import split_pages
from pagetab.sources.sinks import (
    DOCUMENT_COLUMNS, TargetExists, write_documents_csv, write_records_json, write_reports_json, write_run, write_together)

from sites import HANDBOOK, ORIGIN, page, run


@pytest.fixture(scope="module")
def demo(spark):
    tricky = {**HANDBOOK, "/faq": page(named='say "no", twice', says="line\nbreak \\ back"), "/api/v1": page(named="+cmd", says="ünï ☃")}
    return run(spark, {"demo": (tricky, {})})


def test_csv(demo, tmp_path):
    target = str(tmp_path / "csv")
    write_documents_csv(demo.records.coalesce(1).orderBy("seq"), target)
    raw = open(glob.glob(target + "/*.csv")[0], newline="", encoding="utf-8").read()
    rows = list(csv.DictReader(raw.splitlines(keepends=True)))
    assert tuple(rows[0]) == DOCUMENT_COLUMNS and raw.count("\r\n") == 6
    by_url = {r["url"].removeprefix(ORIGIN): r for r in rows}
    assert set(by_url) == {"/", "/install", "/faq", "/api/v1", "/api/v2"}
    assert by_url["/install"]["title"] == "'@/install" and by_url["/api/v1"]["title"] == "'+cmd"
    assert by_url["/faq"]["title"] == 'say "no", twice' and by_url["/faq"]["text"] == "line break \\ back"
    assert by_url["/"]["discovered_from"] == "" and by_url["/"]["text_truncated"] == "False"
    assert by_url["/"]["fetched_at"] == "2024-05-01T00:01:00+00:00" and by_url["/api/v2"]["depth"] == "2"
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_documents_csv(demo.records, target)


def test_json(demo, tmp_path):
    target = str(tmp_path / "json")
    write_records_json(demo.records, target)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(target + "/*.json"))
    rows = {r["url"].removeprefix(ORIGIN): r for r in map(json.loads, text.splitlines())}
    assert rows["/install"]["title"] == "@/install" and "ünï ☃" in text
    assert set(rows["/drafts/plan"]) == {"crawl_id", "seq", "kind", "url", "discovered_from"}
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_records_json(demo.records, target)
    write_reports_json(demo.reports, str(tmp_path / "reports"))
    report = json.loads(report_json(demo.reports).first().report)
    assert report["record_counts"]["document"] == 5 and report["policy"]["max_pages"] == 20
    assert "policy" not in run_summaries(demo.reports).columns


def test_all_outputs_or_none(spark, demo, tmp_path):
    target = f"{tmp_path}/out/run"
    write_run(demo.records, demo.reports, target)
    assert sorted(x for x in os.listdir(target) if x[0] != ".") == ["documents", "manifest.json", "records", "reports"]
    listed = json.load(open(f"{target}/manifest.json"))
    assert set(listed) == {"documents", "records", "reports"} and all(x["bytes"] > 0 for x in listed.values())
    before = sorted(glob.glob(f"{target}/**", recursive=True))
    with pytest.raises(TargetExists):
        write_run(demo.records.limit(0), demo.reports.limit(0), target + "/")
    assert sorted(glob.glob(f"{target}/**", recursive=True)) == before

    def fails(path):
        demo.reports.write.json(path)
        raise RuntimeError("disk full")

    with pytest.raises(RuntimeError, match="disk full"):
        write_together(spark, f"{tmp_path}/out/other", {"reports": demo.reports.write.json, "bad": fails})
    # a target that another run makes in the meantime stays as it is
    with pytest.raises(TargetExists):
        write_together(spark, f"{tmp_path}/out/raced", {"reports": lambda p: (demo.reports.write.json(p), os.makedirs(f"{tmp_path}/out/raced/kept"))})
    assert sorted(x for x in os.listdir(f"{tmp_path}/out") if x[0] != ".") == ["raced", "run"] and os.listdir(f"{tmp_path}/out/raced") == ["kept"]


def test_report_times(demo):
    report = demo.reports.first()
    assert (report.started_at, report.finished_at) == tuple(
        f(r.fetched_at for r in demo.records.collect() if r.fetched_at).strftime("%Y-%m-%dT%H:%M:%S+00:00") for f in (min, max))


def test_pages_are_split_in_one_pass(spark, tmp_path):
    rows = [(1, "https://e.com/a", "x"), (2, None, "y"), (3, "https://e.com/?token=1", "z"), (4, "nonsense", None), (1, "https://e.com/a", "x"), (None, "http://e.com", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    usable, rejected = split_pages(pages, f"{tmp_path}/pages")
    assert sorted((r.page_id or 0, r.normal, r.crawl_id, r.html) for r in usable.collect()) == [
        (0, "http://e.com/", "http://e.com", "w"), (1, "https://e.com/a", "https://e.com", "x"), (1, "https://e.com/a", "https://e.com", "x")]
    assert sorted((r.page_id, r.reason, r.html) for r in rejected.collect()) == [
        (2, "no_url", "y"), (3, "invalid_or_sensitive_url", "z"), (4, "invalid_or_sensitive_url", None)]
    assert rejected.columns == ["page_id", "url", "html", "reason"]
    both = split_pages(pages.where("false"), f"{tmp_path}/none")
    assert [x.count() for x in both] == [0, 0]


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = shared_folder(spark), shared_folder(spark)
    assert first != second and (root is None or first.startswith(root.rstrip("/")))
