import json

import pytest
from pyspark.sql import functions as F

from quire.operators import ledger
from quire.plans import fixtures as fx
from quire.sources import files
from quire.streaming import jobs


def test_term_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# source: x\n Tlatelolco \n\n#c\nAtitlan\n")
    assert [r.term for r in files.term_lines(spark, str(tmp_path / "t.txt")).collect()] == ["Tlatelolco", "Atitlan"]
    files.term_file(spark.createDataFrame([("b",), ("A",), ("b",)], "term string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["A", "b"]


def test_headers(spark):
    df = spark.createDataFrame([("b", "# source: uno | run_date: 2024-01-02\nx"), ("b", "# source: dos | run_date: 2024-01-02\ny"), ("c", "none")], "book string, text string")
    h = df.select(files.source_header(F.col("text")).alias("h"), files.impossible_strings(F.col("text"), F.lit("uno")).alias("i")).collect()
    assert h[0].h.source == "uno" and h[2].h is None
    assert h[0].i == ["x"] and h[1].i is None and h[2].i is None
    assert [r.book for r in files.mixed_headers(df, "book", "text").collect()] == ["b"]


def test_patch_log(spark):
    lines = ["Page 3", "  op 0: APPLIED (body) [Tlatelolco, México]", "  op 1: REJECTED (unchanged) (body) [Tlatelolco]", "noise", "Page 4", "  op 0: REJECTED (Impossible_string) [x]"]
    log = files.patch_log(spark.createDataFrame(list(enumerate(lines)), "n int, line string")).orderBy("page", "op").collect()
    assert [(r.page, r.op, r.applied, r.reason, r.terms) for r in log] == [(3, 0, True, None, ["Tlatelolco", "México"]), (3, 1, False, "unchanged", ["Tlatelolco"]), (4, 0, False, "impossible_string", ["x"])]


def test_batch_results_and_state(spark, tmp_path):
    rows = [{"custom_id": "r1_p1", "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}}, {"custom_id": "r1_p2", "result": {"type": "errored", "error": {"message": "late"}}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert {r.custom_id: (r.text, r.error) for r in files.batch_results(spark, str(tmp_path / "r.jsonl")).collect()} == {"r1_p1": ("ab", None), "r1_p2": (None, "late")}
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):  # noqa: B017
        files.states(spark, str(tmp_path / "bad.json")).collect()
    assert files.states(spark, str(tmp_path / "bad.json"), strict=False).count() <= 1
    (tmp_path / "s.json").write_text(json.dumps({"source_id": "x", "pages_processed": 12}))
    assert files.saved_sources(files.states(spark, str(tmp_path / "s.json"))).first().pilot_complete is True


def test_inputs(spark, tmp_path):
    for name in ("b.png", "a.txt", "c.exe"):
        (tmp_path / name).write_text("x")
    got = files.inputs(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in got.orderBy("number").collect()] == ["a.txt", "b.png"]
    assert files.in_range(got, 3, 2).count() == 0


def run_stream(spark, df, name, op):
    q = op(df).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, sf, tmp_path):
    calls = fx.calls(spark, sf)
    calls.orderBy("t", "event_id").coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    got = run_stream(spark, stream, "limited", lambda d: jobs.rate_limited(d, 60, 5)).collect()
    expected = ledger.rate_limited(calls, "licence", "t", "event_id", 60, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
    attempts = fx.ledger(spark, sf)
    attempts.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "attempts"))
    stream = spark.readStream.schema(attempts.schema).parquet(str(tmp_path / "attempts"))
    got = run_stream(spark, stream.withColumn("cost", F.lit(1).cast("bigint")), "credits", jobs.commit_credits).collect()
    expected = ledger.commit_unit(attempts, "licence", "key", "event_id", "total").select("licence", "event_id", "outcome").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_job_status(spark):
    e = spark.createDataFrame([(0.0, "j", "page", 1, 1, 10), (10.0, "j", "page", 2, 3, 10)], files.PROGRESS)
    r = jobs.job_status(e, now=1000.0).first()
    assert r.stale is True and r.done == 3 and round(r.seconds_left, 2) == 23.33
