import json

from pyspark.sql import functions as F

from trailbed.operators.cohort import pending
from trailbed.sources import models, records
from trailbed.streaming.positions import calls_stream, hourly_calls, positions_stream, raw_stream


def test_records_round_trip(spark, tmp_path):
    p = str(tmp_path / "c")
    df = spark.createDataFrame([("a", ["x"], None), ("b", [], "p")], records.CANDIDATES)
    records.append_records(df, p)
    records.append_records(df.filter("key = 'a'"), p)
    assert records.read_records(spark, p, records.CANDIDATES).count() == 3
    (tmp_path / "c" / "bad.json").write_text('{"key": "q", "candi\n{"key": "ok"}\n')
    assert records.read_records(spark, p, records.CANDIDATES, strict=False).filter("key IS NOT NULL").count() == 4
    assert records.read_optional(spark, str(tmp_path / "none"), records.SCORES).isEmpty()
    ledger = records.read_optional(spark, p, records.CANDIDATES)
    assert [r.key for r in pending(spark.createDataFrame([("a",), ("z",)], "key string"), ledger).collect()] == ["z"]


def test_texts_and_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    assert records.read_texts(spark, str(tmp_path / "a.md")).first().text == "one\ntwo"
    assert {r.length for r in records.read_files(spark, str(tmp_path)).collect()} == {7}
    assert [r.raw for r in records.read_lines(spark, str(tmp_path / "a.md")).orderBy("line_no").collect()] == ["one", "two"]
    arms = spark.createDataFrame([("B", 1), ("R", 2)], "arm string, x int")
    records.write_arms(arms, str(tmp_path / "arms"))
    assert {p.name for p in (tmp_path / "arms").iterdir() if p.is_dir()} == {"arm=B", "arm=R"}
    records.write_report(arms, str(tmp_path / "r"))
    assert records.violated(arms) and not records.violated(arms.limit(0))


def test_generation_retries_and_gives_up(spark):
    def client(prompt, n):
        if prompt == "bad":
            raise OSError("down")
        return [f"{prompt}{i}" for i in range(n)]

    df = spark.createDataFrame([("a", "p"), ("b", "bad")], "key string, prompt string")
    got = {r.key: r.raw for r in models.generate(df, client, n=2, tries=2, wait=0.0).collect()}
    assert got == {"a": ["p0", "p1"], "b": []}


def test_streams(spark, tmp_path):
    raw = {"messages": [{"content": [{"type": "tool_use", "name": "Read", "input": {}}, {"type": "tool_use", "input": 1}]}]}
    lines = spark.createDataFrame([(1, json.dumps(raw)), (2, "broken")], "line_no long, raw string").withColumn("received_at", F.to_timestamp(F.lit("2025-01-01")))
    lines.write.parquet(str(tmp_path / "raw"))
    q = calls_stream(raw_stream(spark, str(tmp_path / "raw"))).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.block_idx, r.name) for r in spark.table("calls").collect()} == {(0, "Read"), (1, "?")}
    blocks = spark.createDataFrame(
        [(1, "s", 0, 0, "assistant", "tool_use", "Read", "2025-01-01 00:10:00"), (2, "s", 0, 0, "assistant", "tool_use", "Read", "2025-01-02 00:10:00"), (3, "s", 1, 0, "user", "text", None, "2025-01-01 00:20:00")],
        "block_id long, session_id string, msg_idx int, block_idx int, role string, type string, name string, t string",
    ).withColumn("ingested_at", F.to_timestamp("t")).drop("t")
    blocks.coalesce(1).write.parquet(str(tmp_path / "blocks"))
    stream = lambda: spark.readStream.schema(blocks.schema).parquet(str(tmp_path / "blocks"))
    q = positions_stream(stream()).writeStream.format("memory").queryName("pos").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.key for r in spark.table("pos").collect()] == ["s:0:0"]
    q = hourly_calls(stream()).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r.n for r in spark.table("hours").collect()) == 2
