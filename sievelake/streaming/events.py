"""Event pipelines as structured streams: parse, analyse, correlate, notify."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parsing import Step, parse
from ..operators.rules import seconds

LOG = "id string, dataType string, dataSource string, `@timestamp` string, tenantId string, raw string"


def log_stream(spark: SparkSession, path: str, schema: str = LOG, files_per_trigger: int = 100, form: str = "json") -> DataFrame:
    """Logs of a folder; the files of a trigger are bounded."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def parse_stream(logs: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return parse(logs, steps)


def analyse(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that an event meets, with ``rule``."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return events.withColumn("rule", F.explode(met))


def correlate_streams(triggers: DataFrame, history: DataFrame, on: dict[str, str], within: str, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Pairs of a trigger and an earlier row that agree, as an interval join; both
    sides have the watermark ``within``, so state is bounded.  A time that cannot
    be read means no bound in a batch; a stream needs one, so it is an error."""
    span = seconds(within)
    if span is None:
        raise ValueError(f"no time to look back: {within!r}")
    bound = f"{span:.6f} seconds"
    t = triggers.withWatermark(ts, bound).select(F.col(key).alias("trigger_id"), F.col(ts).alias("trigger_ts"), *[F.col(c).alias(f"t_{c}") for c in on.values()])
    h = history.withWatermark(ts, bound).select(F.col(key).alias("history_id"), F.col(ts).alias("history_ts"), *[F.col(c).alias(f"h_{c}") for c in on])
    same = F.expr(f"history_ts <= trigger_ts AND history_ts >= trigger_ts - INTERVAL {bound}")
    for a, b in on.items():
        same = same & (F.col(f"h_{a}") == F.col(f"t_{b}"))
    return t.join(h, same)


def deduplicate(alerts: DataFrame, by: Sequence[str], within: str, ts: str = "ts") -> DataFrame:
    """The first alert of each group in a time, in a stream."""
    return alerts.withWatermark(ts, f"{int(seconds(within) or 0)} seconds").dropDuplicatesWithinWatermark(list(by))


def counts_by_window(events: DataFrame, by: str, window: str, late: str, ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n"))


def notifications(rows: DataFrame, topic: str) -> DataFrame:
    """Messages of a topic: id, time and the row as JSON."""
    return rows.select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("@timestamp"), F.lit(topic).alias("topic"), F.to_json(F.struct("*")).alias("message"))


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Write each micro-batch of what is available, then stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
