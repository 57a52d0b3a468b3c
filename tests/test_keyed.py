"""A keyed table against a dictionary, batch by batch."""

import glob
import os
import random

import pytest

from sievelake.sources.keyed import KeyedTable

ITEM = "id long, action string, seq long, name string, n long"


def batches(n=6):
    rng = random.Random(8)
    out = []
    for b in range(n):
        items = [(rng.randrange(120), rng.choice(["index", "create", "update", "delete", "what"]), s, rng.choice(["x", "y", None]), rng.choice([None, s])) for s in range(60)]
        out.append(items)
    return out


def fold(state, items):
    """(errors) after the items have taken effect on ``state``."""
    errors = []
    for key, action, seq, name, n in sorted(items, key=lambda x: x[2]):
        if action == "index" or (action == "create" and key not in state):
            state[key] = (name, n)
        elif action == "update" and key in state:
            state[key] = tuple(o if v is None else v for v, o in zip((name, n), state[key]))
        elif action == "delete" and key in state:
            del state[key]
        else:
            errors.append((key, action, seq))
    return errors


def rows(df):
    return {r["id"]: (r["name"], r["n"]) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), "id long, name string, n long", "id", buckets=8)


def test_batches_replays_and_errors(spark, table):
    state, errors = {}, []
    assert table.rows().count() == 0 and not table.exists(1)
    for b, items in enumerate(batches()):
        df = spark.createDataFrame(items, ITEM)
        assert table.apply(df, b)
        errors += [(*e, b) for e in fold(state, items)]
        assert rows(table.rows()) == state
        before = table.manifest()
        assert not table.apply(df, b)  # tried again
        assert table.manifest() == before and rows(table.rows()) == state
    assert sorted((r["id"], r["action"], r["seq"], r["batch"]) for r in table.errors().collect()) == sorted(errors)
    again = KeyedTable(spark, table.root, table.schema, "id", buckets=99)
    assert again.buckets == 8 and rows(again.rows()) == state
    assert table.forget_old() > 0 and rows(table.rows()) == state


def test_untouched_files_stay(spark, table):
    table.apply(spark.createDataFrame([(i, "index", 0, "a", i) for i in range(200)], ITEM), 0)
    old = table.manifest()["paths"]
    stamp = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.root}/data/*/*/*.parquet")}
    table.apply(spark.createDataFrame([(7, "update", 0, "b", None)], ITEM), 1)
    new = table.manifest()["paths"]
    assert len(old) == 8 and sum(old[b] != new[b] for b in old) == 1
    assert {f: os.stat(f).st_mtime_ns for f in stamp} == stamp
    assert rows(table.get(7, 8, 999)) == {7: ("b", 7), 8: ("a", 8)}


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.executedPlan().collectLeaves() if "AdaptiveSparkPlan" in plan.nodeName() else plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_one_file_for_one_id(spark, table):
    table.apply(spark.createDataFrame([(i, "index", 0, "a", i) for i in range(500)], ITEM).coalesce(1), 0)
    assert files_read(table.get(77)) < files_read(table.rows()) / 4
    assert table.exists(77) and not table.exists(500)
    plan = table.get(77)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,77)]" in plan


def test_writers_that_meet(spark, table):
    table.apply(spark.createDataFrame([(1, "index", 0, "a", 1)], ITEM), 0, "one")
    before = table.manifest()
    with pytest.raises(Exception):
        table._commit(before)  # the version is taken
    assert table.manifest() == before
    assert table.apply(spark.createDataFrame([(2, "index", 0, "b", 2)], ITEM), 0, "two")
    assert rows(table.rows()) == {1: ("a", 1), 2: ("b", 2)}


def test_empty_nulls_and_a_torn_manifest(spark, table):
    assert table.apply(spark.createDataFrame([], ITEM), 0)
    assert table.apply(spark.createDataFrame([(None, "index", 0, "a", 1), (3, "index", 1, "b", 2)], ITEM), 1)
    assert rows(table.rows()) == {3: ("b", 2)}
    assert [r["error"] for r in table.errors().collect()] == ["no key"]
    with open(f"{table.root}/_log/{99:020d}.json", "w") as f:
        f.write('{"version": 99, "pa')
    assert rows(table.rows()) == {3: ("b", 2)}


def test_stream_sink(spark, table, tmp_path):
    source, state = str(tmp_path / "in"), {}
    for b, items in enumerate(batches(3)):
        spark.createDataFrame(items, ITEM).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ITEM).parquet(source)
        stream.writeStream.foreachBatch(table.sink("stream")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        fold(state, items)
        assert rows(table.rows()) == state
