from pyspark.sql import functions as F

from sievelake.operators import parsing
from sievelake.operators import predicates as P
from sievelake.operators import rules as R
from sievelake.streaming import events as S


def collect(stream, spark, tmp_path, name):
    out = str(tmp_path / name)
    S.run_batches(stream, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / f"{name}-cp"))
    return spark.read.parquet(out)


def source(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.mode("ignore").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder), spark.read.parquet(folder)


def test_parse_and_analyse(spark, sf, tmp_path):
    stream, batch = source(spark, sf, tmp_path)
    steps = [parsing.json("props", "doc"), parsing.add("k", F.try_variant_get("doc", "$.k", "bigint")), parsing.delete(["doc"])]
    rules = {"bad": P.term("event_type", "error"), "large": P.between("value", gt=50)}
    got = collect(S.analyse(S.parse_stream(stream, steps), rules), spark, tmp_path, "alerts")
    want = S.analyse(parsing.parse(batch, steps), rules)
    key = ["event_id", "rule", "k"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_correlation_equals_batch(spark, sf, tmp_path):
    stream, batch = source(spark, sf, tmp_path)
    other, _ = source(spark, sf, tmp_path)
    pairs = S.correlate_streams(stream.filter("event_type = 'error'"), other.filter("event_type = 'click'"), {"user_id": "user_id"}, "24h")
    got = collect(pairs, spark, tmp_path, "pairs").groupBy("trigger_id").count()
    want = R.related(batch.filter("event_type = 'error'"), batch.filter("event_type = 'click'"), R.Lookback({"user_id": "user_id"}, "24h"), "event_id", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_notifications(spark, sf):
    rows = S.notifications(spark.read.parquet(f"{sf}/region.parquet"), "topic").collect()
    assert len(rows) == 5 and len({r["id"] for r in rows}) == 5 and '"r_name"' in rows[0]["message"]
