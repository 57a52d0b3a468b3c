"""Logs read and topics written over many stops and starts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievelake.streaming import channels as C


def record(i, raw=None):
    return json.dumps({"id": str(i), "dataType": "t", "dataSource": "s", "@timestamp": "2024-01-01T00:00:00Z", "tenantId": "x", "raw": raw or f"line ü {i}"}, ensure_ascii=False)


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def run(spark, folder, n=1, **options):
    """Start, take what the trigger allows, stop; ``n`` times."""
    for _ in range(n):
        logs = C.read_logs(spark, str(folder / "in"), position=str(folder / "state" / "position"), **options)
        both = logs.select(F.when(F.col("readable") & (F.col("id") != "7"), F.lit("logs")).otherwise(F.lit("parsing_dropped")).alias("topic"), F.coalesce("id", "line").alias("message"))
        C.write_topics(both, str(folder / "out"), str(folder / "checkpoint")).awaitTermination()


def messages(spark, folder, topic):
    return sorted(r["message"] for r in C.read_topic(spark, str(folder / "out"), topic, "topic string, message string").collect())


def test_nothing_lost_or_repeated(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sent, rng = [], random.Random(3)
    for turn in range(4):
        for name in ("a-01.log", "a-02.log"):
            lines = [record(f"{turn}-{name}-{i}", "x" * rng.randrange(400)) for i in range(25)]
            sent += [json.loads(x)["id"] for x in lines]
            append(tmp_path / "in" / name, "\n".join(lines) + "\n")
        # a line that its writer has not ended yet is left for later
        append(tmp_path / "in" / "a-02.log", record(f"late-{turn}"))
        run(spark, tmp_path, maxBytesPerTrigger=4000, splitBytes=700)
        assert not any(m.startswith(f"late-{turn}") for m in messages(spark, tmp_path, "logs"))
        append(tmp_path / "in" / "a-02.log", "\n")
        sent.append(f"late-{turn}")
    run(spark, tmp_path, 14, maxBytesPerTrigger=4000, splitBytes=700)
    assert messages(spark, tmp_path, "logs") == sorted(sent)
    sizes = [len(list((tmp_path / "out" / "_batches").iterdir()))]
    run(spark, tmp_path, maxBytesPerTrigger=4000)
    assert messages(spark, tmp_path, "logs") == sorted(sent) and sizes[0] >= 5


def test_dropped_rows_and_long_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    append(tmp_path / "in" / "b.log", "\n".join(["no record", record(1, "y" * 200_000), record(7), '{"id": ', record(2)]) + "\n")
    run(spark, tmp_path, 6, maxBytesPerTrigger=50, splitBytes=64)
    assert messages(spark, tmp_path, "logs") == ["1", "2"]
    assert messages(spark, tmp_path, "parsing_dropped") == ["7", "no record", '{"id": ']


def test_rotated_files_leave_the_offset(spark, tmp_path):
    (tmp_path / "in").mkdir()
    reader = C.LogReader({"path": str(tmp_path / "in"), "openFiles": "2"})
    start = reader.initialOffset()
    for i in range(6):
        append(tmp_path / "in" / f"c-{i}.log", record(i) + "\n")
    end = reader.latestOffset()
    assert end["done"] == "c-3.log" and sorted(end["open"]) == ["c-4.log", "c-5.log"]
    assert sorted(p.path for p in reader.partitions(start, end)) == [f"c-{i}.log" for i in range(6)]
    later = reader.latestOffset()
    assert later["done"] == end["done"] and later["open"] == end["open"] and not reader.partitions(end, later)


@pytest.mark.parametrize("split", [1, 5, 64, 10_000])
def test_splits_share_lines(tmp_path, split):
    (tmp_path / "in").mkdir()
    lines = [("é" * (i % 9)) + str(i) for i in range(60)]
    append(tmp_path / "in" / "d.log", "\n".join(lines) + "\n")
    reader = C.LogReader({"path": str(tmp_path / "in"), "splitBytes": str(split)})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [x for p in parts for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert got == lines


def test_a_batch_committed_again_changes_nothing(tmp_path):
    writer = C.TopicWriter({"path": str(tmp_path)})

    class Message(dict):
        asDict = lambda self: dict(self)

    rows = [Message(topic="a", message="1"), Message(topic="b", message="2")]
    for _ in range(2):
        writer.commit([writer.write(iter(rows)), None], 5)
    writer.abort([writer.write(iter(rows))], 6)
    assert len(list(tmp_path.glob("topic=*/*.json"))) == 2 and not list((tmp_path / "_new").iterdir())


def test_split_dropped(spark):
    logs = spark.createDataFrame([("f", 0, "x", False, None), ("f", 2, "y", True, "7"), ("f", 4, "z", True, "8")], "file string, at long, line string, readable boolean, id string")
    good, bad = C.split_dropped(logs, F.col("id") == "8")
    assert [r["id"] for r in good.collect()] == ["8"]
    assert sorted(json.loads(r["message"])["error"] for r in bad.collect()) == ["dropped", "not a record"]
