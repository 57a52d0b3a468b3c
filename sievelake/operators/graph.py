"""Entities and their relations as two tables.

Observations are appended; the current state of an entity or relation is an
aggregate over its observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entities import fingerprint


def consolidate(history: DataFrame, key: str = "entity_id", ts: str = "ts") -> DataFrame:
    """One row an entity: last, best and worst reputation, mean accuracy, the union
    of tags and of groups that may see it, first and last sight."""
    return history.groupBy(key).agg(
        F.max_by("reputation", F.struct(ts, "reputation")).alias("reputation"),
        F.max("reputation").alias("best_reputation"),
        F.min("reputation").alias("worst_reputation"),
        F.avg("accuracy").alias("accuracy"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("visibleBy")))).alias("visibleBy"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
    )


def relations(edges: DataFrame, ts: str = "ts") -> DataFrame:
    """One row a relation (source, target, mode), with how often and when last seen."""
    return edges.groupBy("source", "target", "mode").agg(F.count(F.lit(1)).alias("sightings"), F.max(ts).alias("last_seen"))


def flatten(ingested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of rows (type, value, associations of (mode, type, value)).

    An entity is named by its type and the fingerprint of its value.
    """
    named = lambda kind, value: F.concat(kind, F.lit("-"), fingerprint(value))
    own = ingested.select("type", "value").withColumn("entity_id", named(F.col("type"), F.col("value")))
    pairs = ingested.select("type", "value", F.explode("associations").alias("a")).select("type", "value", "a.mode", F.col("a.type").alias("t2"), F.col("a.value").alias("v2"))
    ends = pairs.withColumn("source", named(F.col("type"), F.col("value"))).withColumn("target", named(F.col("t2"), F.col("v2")))
    others = ends.select(F.col("t2").alias("type"), F.col("v2").alias("value"), F.col("target").alias("entity_id"))
    return own.unionByName(others).distinct(), ends.select("source", "target", "mode").distinct()


def neighbours(edges: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """Entities within ``hops`` relations of ``start`` (entity_id), with ``distance``."""
    both = edges.select("source", "target").union(edges.select("target", "source"))
    found = start.select("entity_id").distinct().withColumn("distance", F.lit(0))
    for n in range(1, hops + 1):
        step = found.filter(F.col("distance") == n - 1).join(both, F.col("entity_id") == F.col("source")).select(F.col("target").alias("entity_id")).distinct()
        found = found.unionByName(step.join(found, "entity_id", "left_anti").withColumn("distance", F.lit(n)))
    return found
