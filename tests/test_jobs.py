"""Archive jobs, the bulk sink, guards and streams."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_records import warc, write_file

from webarc.operators import archive, bulk, guards
from webarc.sources.warc import read_warcs
from webarc.streaming.archives import stream_warcs


def test_report_and_index(spark, tmp_path):
    write_file(tmp_path / "a.warc", [warc(n=1), warc(n=2, checksum=False), warc(n=3, extra=[("WARC-Block-Digest", "sha1:" + "A" * 32)], checksum=False)], "none")
    r = read_warcs(spark, str(tmp_path))
    assert [x.status for x in archive.digest_report(r).orderBy("record_id").collect()] == ["OK, PAYLOAD_OK", "NO_DIGEST, PAYLOAD_NO_DIGEST", "FAIL, PAYLOAD_NO_DIGEST"]
    assert {x.status: x.n for x in archive.digest_summary(archive.digest_report(r, payloads=False)).collect()} == {"OK": 1, "NO_DIGEST": 1, "FAIL": 1}
    fields = ("offset", "length", "filename", "http:status", "http:content-type", "warc-type", "no-such")
    sizes = spark.createDataFrame([(str(tmp_path / "a.warc"), (tmp_path / "a.warc").stat().st_size)], "path string, size bigint")
    for given in (r, r.drop("record_length")):
        lines = [json.loads(x.line) for x in archive.cdxj(given, fields, None if given is r else sizes).orderBy("offset").collect()]
        assert [int(x["offset"]) for x in lines] == [sum(int(y["length"]) for y in lines[:i]) for i in range(3)]
        assert lines[0]["filename"] == "a.warc" and lines[0]["http:status"] == "200" and lines[0]["http:content-type"].startswith("text/html") and "no-such" not in lines[0]
    archive.write_cdxj(archive.cdxj(r), str(tmp_path / "index"))
    assert spark.read.text(str(tmp_path / "index")).count() == 3


def test_recompress(spark, tmp_path):
    write_file(tmp_path / "a.warc.gz", [warc(n=i) for i in range(5)], "gzip")
    assert archive.recompress(spark, str(tmp_path / "a.warc.gz"), str(tmp_path / "out"), "zstd") == 5
    a = read_warcs(spark, str(tmp_path / "a.warc.gz"), ["record_id", "block_sha1", "block_digest_status"]).orderBy("record_id").collect()
    assert a == read_warcs(spark, str(tmp_path / "out"), ["record_id", "block_sha1", "block_digest_status"]).orderBy("record_id").collect()


class Service:
    """Takes what it is sent, but answers some ids with other codes first."""

    def __init__(self, answers):
        self.answers = {k: list(v) for k, v in answers.items()}
        self.calls = []

    def __call__(self, actions):
        self.calls.append([a["id"] for a in actions])
        return [(a["id"], self.answers.get(a["id"], [200]).pop(0) if self.answers.get(a["id"]) else 200) for a in actions]


def test_sending():
    waits = []
    s = Service({"b": [500, 429], "c": [400]})
    assert bulk._send([{"id": x} for x in "abc"], s, 5, 2, 3, True, waits.append) == ["a", "b"]
    assert s.calls == [["a", "b", "c"], ["b"], ["b"]] and waits == [2, 3]
    with pytest.raises(bulk.BulkError):
        bulk._send([{"id": "c"}], Service({"c": [400]}), 5, 2, 3, False, waits.append)
    with pytest.raises(bulk.BulkError):
        bulk._send([{"id": "b"}], Service({"b": [500] * 9}), 2, 0, 0, True, waits.append)


def test_bulk_columns(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, a string, _b string")
    assert bulk.index_action(df, "id").first() == ("index", None, "1", '{"a":"x"}')
    assert bulk.update_action(df, "id", "i").first()[:3] == ("update", "i", "1") and bulk.delete_action(df, "id", "i").first() == ("delete", "i", "1", None)
    actions = bulk.index_action(spark.range(2000).withColumn("v", F.lit("z")), "id")
    ok = lambda: lambda xs: [(x["id"], 201) for x in xs]
    assert bulk.bulk_index(actions, ok, "i", parallelism=3, buffer_size=300, chunk_size=100).distinct().count() == 2000
    with pytest.raises(Exception, match="no index"):
        bulk.bulk_index(actions, ok).collect()
    body = bulk.request_body([{"op_type": "index", "index": "i", "id": "1", "doc": '{"a":1}'}, {"op_type": "delete", "index": "i", "id": None, "doc": None}, {"op_type": "update", "index": "i", "id": "2", "doc": "{}"}]).splitlines()
    assert [json.loads(x) for x in body] == [{"index": {"_index": "i", "_id": "1"}}, {"a": 1}, {"delete": {"_index": "i"}}, {"update": {"_index": "i", "_id": "2"}}, {"doc": {}}]
    made = []
    assert bulk.ensure_index(lambda n: bool(made), lambda n, s: made.append(n), "i") and not bulk.ensure_index(lambda n: bool(made), None, "i") and made == ["i"]


def spin(seconds):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        pass


def test_time_guard():
    @guards.time_guard(timeout_ms=60, check_interval=5, interrupt_type=guards.EXCEPTION)
    def slow():
        spin(3)

    for _ in range(2):  # a guard can be used again
        with pytest.raises(guards.ExecutionTimeout):
            slow()
    with guards.time_guard(timeout_ms=150, check_interval=5) as g:
        for _ in guards.progress_loop(range(6), g):
            spin(0.05)
    with pytest.raises(RuntimeError), guards.time_guard(timeout=5), guards.time_guard(timeout=5):
        pass
    with pytest.raises(RuntimeError):
        guards.progress()
    with pytest.raises(ValueError):
        guards.time_guard(interrupt_type="x")
    assert guards.guarded(lambda: spin(3), 50)()[1] == "ExecutionTimeout" and guards.guarded(lambda x: x + 1)(1) == (2, None) and guards.guarded(lambda: 1 / 0)()[1].startswith("ZeroDivisionError")


def test_memory_guard():
    with pytest.raises(guards.MemoryLimitExceeded), guards.mem_guard(max_memory=20 << 10, absolute=False, check_interval=2, interrupt_type=guards.EXCEPTION):
        held = []
        for _ in range(2000):
            held.append(bytearray(1 << 18))
            spin(0.002)
    with guards.mem_guard(max_memory=1 << 30, check_interval=5):
        spin(0.02)


def test_exc_loop():
    class Items:
        def __init__(self):
            self.n = 0

        def __iter__(self):
            return self

        def __next__(self):
            self.n += 1
            if self.n > 4:
                raise StopIteration
            if self.n == 2:
                raise ValueError("two")
            return self.n

    got = list(guards.exc_loop(Items()))
    assert [x for x, _ in got] == [1, None, 3, 4] and isinstance(got[1][1], ValueError)


class At:
    def __init__(self, stream_pos):
        self.stream_pos = stream_pos


@pytest.mark.parametrize("seek", [True, False])
def test_warc_retry(seek):
    failures = {2: 2, 4: 1}

    def reopen(at):
        for p in range(at if seek else 0, 6):
            if failures.get(p):
                failures[p] -= 1
                raise OSError("flaky")
            yield At(p)

    assert [r.stream_pos for r in guards.warc_retry(reopen(0), reopen, 3, seek)] == list(range(6))

    def broken(at):
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        list(guards.warc_retry(_raising(), broken, 2, seek))


def _raising():
    raise OSError("gone")
    yield


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: stream_warcs(spark, str(tmp_path / "in"), late="1 hour").select("record_id", "record_date").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    write_file(tmp_path / "in" / "1.warc.gz", [warc(n=1), warc(n=2)], "gzip")
    run()
    write_file(tmp_path / "in" / "2.warc.gz", [warc(n=3)], "gzip")
    run()
    assert sorted(r.record_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>"]


def test_python_workers_get_small_batches(spark):
    """Pages are parsed about a megabyte at a time, not by thousands."""
    pages = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("html"), "id")
    seen = pages.mapInPandas(lambda batches: (b.assign(rows=len(b))[["rows"]] for b in batches), "rows bigint").agg(F.max("rows")).first()[0]
    assert seen < 1000

    @F.pandas_udf("bigint")
    def rows(h: pd.Series) -> pd.Series:
        return pd.Series([len(h)] * len(h))

    assert pages.select(rows("html").alias("rows")).agg(F.max("rows")).first()[0] < 1000
