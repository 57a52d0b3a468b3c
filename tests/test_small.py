"""Attributes, files, record functions and patterns judged by the engine."""

import pytest
from pyspark.sql import functions as F

from sievelake.functions import entities, semantics
from sievelake.functions.record import Record, register
from sievelake.operators import parsing
from sievelake.sources import tables


def test_set_attribute(spark):
    df = spark.createDataFrame([(1, "7", 2.9, True, None), (2, "x", -2.9, False, 4), (3, None, None, None, 5)], "id int, s string, f double, b boolean, port long")
    read = lambda v, name="port": [(r[name], r["ok"]) for r in semantics.set_attribute(df, name, v, "ok").orderBy("id").collect()]
    assert read(F.col("s")) == [(7, True), (4, False), (None, True)]
    assert read(F.col("f")) == [(2, True), (-2, True), (None, True)]
    assert read(F.col("b")) == [(None, False), (4, False), (None, True)]
    assert read(F.col("f"), "hostname") == [("2.9", True), ("-2.9", True), (None, True)]
    assert read(F.lit("1e3"), "latitude" if semantics.KINDS.get("latitude") == "float" else "size-in-bytes")[0] == (1000.0, True)
    with pytest.raises(ValueError):
        semantics.set_attribute(df, "no such", F.col("s"))


def test_list_files(spark, tmp_path):
    for name in ("10.yaml", "2.yaml", "b2.yaml", "b10.yaml", "x.yml", "sub/1.yaml", "a.yaml", "sub/2.yaml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = [p.split("/")[-1] for p in tables.list_files(spark, str(tmp_path), ".yaml")]
    assert got == ["1.yaml", "2.yaml", "2.yaml", "10.yaml", "a.yaml", "b2.yaml", "b10.yaml"]
    assert tables.list_files(spark, str(tmp_path / "none"), ".yaml") == []


def test_custom_functions(spark):
    @register("is_even")
    def is_even(record, path):
        return F.coalesce(record.number(path) % 2 == 0, F.lit(False))

    df = spark.createDataFrame([('{"n": 4}',), ('{"n": 3}',), ("{}",)], "doc string")
    assert [r[0] for r in df.select(Record("doc").is_even("n")).collect()] == [True, False, False]
    for name in ("equals", "no name"):
        with pytest.raises(ValueError):
            register(name)
    with pytest.raises(AttributeError):
        Record("doc").unheard_of("n")


def test_patterns_are_judged_by_the_engine(spark):
    patterns = [r"\p{L}+", "(", "(?P<a_b>x)(?P<c>y)", "[a", "x{2,1}", None, "", "(?<n>a)", r"\(?P<"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    assert [r[0] for r in df.select(entities.expression(F.col("p"))).collect()] == [r"\p{L}+", None, "(?P<a_b>x)(?P<c>y)", None, None, None, "", "(?<n>a)", r"\(?P<"]


def test_grok_with_engine_patterns(spark):
    df = spark.createDataFrame([("äb-12 rest",)], "s string")
    step = parsing.grok("s", [("w", r"(\p{L})+"), ("d", "-"), ("n", r"(?P<x_y>\d)+"), ("r", ".*")])
    assert tuple(step(df).first()) == ("äb-12 rest", "äb", "-", "12", " rest")
    with pytest.raises(ValueError):
        parsing.grok("s", [("w", "(")])(df)
