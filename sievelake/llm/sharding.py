"""Sharding by histogram sort.

Rows are put in key order (doc_id, a digest of the text, and for repeated rows a
running number) and cut into shards of near-equal bytes.  The cuts
come from exact counts: each round counts, over all partitions, the bytes and
rows below every candidate key, and the next round probes inside the intervals
that hold a wanted boundary, until each cut is within tolerance or its interval
holds one row.  Then every row is exchanged once.  All of it is DataFrame code.

Shards are numbered in cells of at most about ``cell_bytes``, whatever the size of
the table; one row per probe interval, so some per cell, reaches the driver.

Defined results: a null text counts 8 bytes and has crc 0; a null doc_id sorts
with the smallest; a very long text is one row of its cell; repeated rows are
parted by a running number and are interchangeable: only then is the numbered
table written to the shared folder first, so that every reader and rerun sees the
same numbers; an empty table gives an empty result.  Input
columns named like an output column are replaced.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_HALF = 1 << 63
_FULL = 1 << 64


def _number(key) -> int:
    """A key (three longs) as one whole number in the same order."""
    a, b, c = key
    return ((a + _HALF) * _FULL + b + _HALF) * _FULL + c + _HALF


def _key(number: int) -> tuple[int, int, int]:
    number, c = divmod(number, _FULL)
    a, b = divmod(number, _FULL)
    return a - _HALF, b - _HALF, c - _HALF


def _literal(values: list, kind: str) -> Column:
    """An array constant, which the optimiser folds; one call for any length."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _keys(keys: list[tuple[int, int, int]]) -> Column:
    return _literal([dict(zip("abc", k)) for k in keys], "array<struct<a:bigint,b:bigint,c:bigint>>")


def interval_of(key: Column, keys: list[tuple[int, int, int]]) -> Column:
    """How many of the ascending ``keys`` are at most ``key``: a binary search."""
    if not keys:
        return F.lit(0)
    table = _keys(keys)
    steps, step = [], 1
    while step <= len(keys):
        steps.insert(0, step)
        step *= 2

    def forward(at: Column, by: Column) -> Column:
        far = at + by
        return F.when((far <= len(keys)) & (F.element_at(table, F.least(far, F.lit(len(keys)))) <= key), far).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), forward)


def find_cuts(keyed: DataFrame, shards: int, probes: int, tolerance: float, cells: int, cell_bytes: int) -> tuple[list, list, list[int]]:
    """(cuts, cell starts, rows below each cell start) of ``keyed`` (key, size).

    ``cuts`` are the first keys of shards 1, 2, ...; the cell starts hold them
    too, and more, so that a cell holds about one ``cells``-th of a shard, but not
    much more than ``cell_bytes`` unless a row does.
    """
    known: dict[int, tuple[int, int]] = {}
    low = high = 0
    total = rows = 0
    spans: list[tuple[int, int, int, int, int, int]] = []
    asked: list[int] = []
    while True:
        probe = [_key(x) for x in asked]
        found = (
            keyed.groupBy(interval_of(F.col("key"), probe).alias("at"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            .orderBy("at")
            .collect()
        )
        if not found:
            return [], [], []
        by, held, spans = 0, 0, []
        for r in found:
            first, last = _number(r["low"]), _number(r["high"])
            known[first] = (by, held)  # exact: what lies below the interval's first key
            spans.append((first, last, by, by + r["bytes"], held, held + r["rows"]))
            by, held = by + r["bytes"], held + r["rows"]
        total, rows = by, held
        slack = tolerance * total / shards
        cell = max(1, min(total // (shards * cells), cell_bytes))
        more: set[int] = set()
        for first, last, b0, b1, r0, r1 in spans:
            if first == last:
                continue
            wanted = [t for t in range(b0 * shards // total, b1 * shards // total + 1) if b0 < t * total / shards < b1] if total else []
            if any(min(t * total / shards - b0, b1 - t * total / shards) > slack for t in wanted) or b1 - b0 > 2 * cell:
                n = probes if not asked else max(2, probes // 4)
                parts = max(shards * probes if not asked else n * max(1, len(wanted)), (b1 - b0) // cell)
                width = last + 1 - first
                more |= {first + 1 + (width - 1) * i // parts for i in range(parts)} - {first}
        more -= set(known)
        more = {m for m in more if m not in asked}
        if not more:
            break
        asked = sorted({*asked, *more, *known})
    starts = sorted(known)
    cuts, at = [], 0
    for t in range(1, shards):
        goal = t * total / shards
        while at + 1 < len(starts) and known[starts[at + 1]][0] <= goal:
            at += 1
        best = starts[at]
        if at + 1 < len(starts) and known[starts[at + 1]][0] - goal < goal - known[best][0]:
            best = starts[at + 1]
        cuts.append(best)
    for t in range(1, len(cuts)):
        cuts[t] = max(cuts[t], cuts[t - 1])
    return [_key(c) for c in cuts], [_key(s) for s in starts], [known[s][1] for s in starts]


def histogram_shards(docs: DataFrame, shards: int = 24, probes: int = 16, tolerance: float = 0.002, cells: int = 16, cell_bytes: int = 128_000_000) -> DataFrame:
    """``docs`` with size, shard and slot, each row exchanged once.

    ``tolerance`` is the accepted distance of a cut from its goal as a share of
    a shard; a document larger than that limits it.  ``slot`` counts from 0
    within the shard in key order.
    """
    docs = docs.drop("size", "shard", "slot")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(-_HALF))
    key = lambda number: F.struct(first.alias("a"), F.xxhash64(F.col("text")).alias("b"), number.cast("long").alias("c"))
    sized = docs.withColumn("size", size).withColumn("__key", key(F.lit(0)))
    keyed = common.checkpoint(sized.select(F.col("__key").alias("key"), "size"))
    if not keyed.groupBy("key").count().filter("count > 1").isEmpty():
        folder = f"{common.shared_folder(docs.sparkSession)}/numbered-{uuid.uuid4().hex}"
        sized.withColumn("__key", key(F.monotonically_increasing_id())).write.option("compression", "zstd").parquet(folder)
        sized = docs.sparkSession.read.schema(sized.schema).parquet(folder)
        keyed = common.checkpoint(sized.select(F.col("__key").alias("key"), "size"))
    cuts, starts, below = find_cuts(keyed, shards, probes, tolerance, cells, cell_bytes)
    if not starts:
        return docs.withColumn("size", size).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    rows_below = dict(zip(starts, below))
    shard_of_cell, first_row = [], []
    at, base = 0, 0
    for s in starts:
        while at < len(cuts) and cuts[at] <= s:
            at += 1
            base = rows_below[s]
        shard_of_cell.append(at)
        first_row.append(rows_below[s] - base)
    cell = F.greatest(interval_of(F.col("__key"), starts), F.lit(1))
    out = sized.withColumn("__cell", cell)
    out = out.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell").orderBy("__key")))
    out = out.withColumn("shard", F.element_at(_literal(shard_of_cell, "array<int>"), F.col("__cell")))
    slot = F.element_at(_literal(first_row, "array<bigint>"), F.col("__cell")) + F.col("__rank") - 1
    return out.withColumn("slot", slot.cast("long")).drop("__key", "__cell", "__rank")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(common.read(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
