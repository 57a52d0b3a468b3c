import re
from types import SimpleNamespace

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelake.llm import common, registry


def test_stages(spark, documents, sf):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs.collect()
        if name != "packed":
            assert docs.columns == documents.columns
    assert {r["doc_id"] for r in seen["quality"]} >= {6, 7, 8, 9} and 10 not in {r["doc_id"] for r in seen["quality"]}
    assert {r["doc_id"] for r in seen["near_copies"]} & {6, 7, 8, 300, 301} == {6}
    assert len(seen["personal_data"]) == len(seen["near_copies"])
    assert not any("@example" in r["text"] for r in seen["personal_data"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["personal_data"])
    assert len(seen["packed"]) == len(seen["mix"])
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(r["n_tokens"] for r in seen["packed"]) == sorted(len(e.ids) for e in encoder.encode_batch([r["text"] or "" for r in seen["mix"]], add_special_tokens=False))


CLASHES = "kept boolean, n_words long, size long, target double, copies long, spans string, base_spans int, component_id long, n_tokens long, batch string, key string, chain long, fp long, h string, n string, start int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_user_columns(spark, documents, empty, sf, name):
    """Columns of any name come back with their values, and the rows are those
    that the stage gives without them; empty tables and tables of nulls work."""
    stage = dict(corpus_pipeline.STAGES)[name]
    columns = [c.split()[0] for c in CLASHES.split(", ")]
    values = [F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")).cast(c.split()[1]) if c.split()[1] == "string" else F.lit(1 if c.split()[1] == "boolean" else i).cast(c.split()[1]) for i, c in enumerate(CLASHES.split(", "))]
    more = documents.select("*", *[v.alias(c) for c, v in zip(columns, values)])
    plain, got = stage(spark, documents, sf), stage(spark, more, sf)
    key = lambda r: str((r["doc_id"], r["source"], r["text"] if name != "packed" else r["n_tokens"]))
    assert sorted(map(key, plain.collect())) == sorted(map(key, got.collect()))
    if name != "packed":
        assert got.columns == more.columns and got.dtypes == more.dtypes
        before = {r["doc_id"]: tuple(r[c] for c in columns) for r in more.collect()}
        assert all(tuple(r[c] for c in columns) == before[r["doc_id"]] for r in got.collect())
    assert stage(spark, empty, sf).count() == 0
    nulls = spark.range(30).select(*[F.lit(None).cast(t).alias(c) for c, t in more.dtypes])
    left = stage(spark, nulls, sf).count()
    assert left == {"quality": 0, "mix": 0}.get(name, 30)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "batch" in out.columns


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    result = c.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    got = sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, sf).collect())
    assert got == sorted(result.fetchall())


def test_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11))


def test_shared_folder(spark):
    """A session on one machine gets a folder; a cluster without one is an error."""
    assert common.shared_folder(spark)
    none = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(master="spark://host:7077", getConf=lambda: none, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        common.shared_folder(SimpleNamespace(conf=none, sparkContext=cluster))
