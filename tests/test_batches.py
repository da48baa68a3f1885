"""Tasks with Python workers hold little: what Spark hands to them, and what they take of it at a time."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagetab.functions.batches import BATCH_BYTES, ROWS, batch_limits, column, frugal
from pagetab.operators.bodies import decode_bodies
from pagetab.operators.pages import extract_pages
from pagetab.plans.derived import page_responses, site_responses

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unlimited(spark):
    spark.conf.set(LIMIT, "64m")
    yield spark
    spark.conf.unset(LIMIT)


@pytest.mark.parametrize("decode", [True, False])
def test_batches_are_small(unlimited, decode):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64()), "n": pa.array([batch.num_rows], pa.int64())})

    df = unlimited.range(0, 6000, 1, 1).select("id", F.lit(None).cast("string").alias("content_encoding"), F.repeat(F.lit("x"), 2000).cast("binary").alias("body"))
    got = (decode_bodies(df, F.lit(9999)) if decode else extract_pages(df)).mapInArrow(sizes, "size bigint, n bigint").collect()
    assert sum(r.n for r in got) == 6000
    assert max(r.size for r in got) < 2 * BATCH_BYTES


def test_derived_responses_come_in_small_batches(unlimited):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64()), "n": pa.array([batch.num_rows], pa.int64())})

    captures = page_responses(unlimited.range(0, 6000, 1, 1).select(
        F.lit("https://e.com").alias("crawl_id"), F.col("id").alias("capture_id"), F.concat(F.lit("https://e.com/"), "id").alias("url"),
        F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("content_encoding"),
        F.lit(None).cast("string").alias("location"), F.repeat(F.lit("x"), 2000).cast("binary").alias("body"),
        F.expr("timestamp_seconds(id)").alias("fetched_at"), F.lit(None).cast("string").alias("error_type")))
    got = site_responses(captures).mapInArrow(sizes, "size bigint, n bigint").collect()
    assert sum(r.n for r in got) == 6001
    assert max(r.size for r in got) < 2 * BATCH_BYTES


@pytest.mark.parametrize("set_to, kept", [("64m", str(BATCH_BYTES)), ("1m", "1m"), ("4096", "4096b"), ("8192kb", str(BATCH_BYTES))])
def test_limit_is_only_lowered(unlimited, set_to, kept):
    unlimited.conf.set(LIMIT, set_to)
    batch_limits(unlimited)
    assert unlimited.conf.get(LIMIT).rstrip("b") == kept.rstrip("b")


def test_a_task_takes_slices():
    batch = pa.RecordBatch.from_pydict({"n": list(range(2 * ROWS + 1))})
    taken = list(frugal(lambda batches: (b for b in batches))(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in taken] == [ROWS, ROWS, 1] and pa.Table.from_batches(taken).to_batches()[0].schema == batch.schema
    assert [n for b in taken for n in b.column("n").to_pylist()] == batch.column("n").to_pylist()


@pytest.mark.parametrize("kind, values", [
    (pa.string(), ["a", None, "é\U0001F600", ""] * 5), (pa.string(), [None, None]), (pa.binary(), (b"", None, b"x\0", bytearray(b"y"))),
    (pa.int64(), [1, None, -5, 2**62]), (pa.bool_(), [True, None, False] * 7), (pa.list_(pa.string()), [["a", None], None, [], ["b"]])])
def test_columns(kind, values):
    for some in (values, values[:0], values[:1]):
        got = column(some, kind)
        got.validate(full=True)
        assert got.type == kind and got.equals(pa.array([bytes(v) if isinstance(v, bytearray) else v for v in some], kind))


def test_columns_of_other_types_are_refused():
    with pytest.raises(TypeError):
        column([1.0], pa.float64())


def test_tasks_load_no_pandas(spark, tmp_path, monkeypatch):
    """Pandas would take more of a worker than the batches it holds, in each of the three workers that a task has."""
    runs, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *rest: (runs.append(run), plain(self, run, *rest))[1])
    row = spark.sql("SELECT 'https://e.com' AS crawl_id, 2L AS capture_id, 'https://e.com/p' AS url, 200 AS http_status, 'text/html' AS content_type, "
                    "string(null) AS content_encoding, string(null) AS location, binary('<a href=x>y</a>') AS body, timestamp_seconds(0) AS fetched_at, string(null) AS error_type")
    extract_pages(decode_bodies(site_responses(row), F.lit(99)))
    assert len(runs) == 3
    batch = pa.RecordBatch.from_pylist([{
        "crawl_id": "c", "capture_id": 2, "url": "u", "http_status": 200, "content_type": "text/html", "content_encoding": None, "location": None,
        "body": b"<a href=x>y</a>", "fetched_at": 0, "error_type": None, "body_bytes": 15, "_limit": 99, "residual_encoding": None, "decoded_bytes": 0,
        "decode_error": None, "decode_truncated": False}])
    (tmp_path / "runs").write_bytes(cloudpickle.dumps((runs, batch)))
    said = subprocess.run(
        [sys.executable, "-c", "import pickle, sys; runs, b = pickle.load(open(sys.argv[1], 'rb')); "
         "print(*[x.num_rows for run in runs for x in run(iter([b]))], 'pandas' in sys.modules)", str(tmp_path / "runs")],
        cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert said.stdout.split() == ["1", "1", "1", "False"], said.stderr
