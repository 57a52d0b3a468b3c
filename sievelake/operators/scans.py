"""Places and running values in a total order, without a task that sees it all.

A table is dealt out by ranges of its order, sorted there and written once; what
one partition must know of those before it is a row for each of them.  Groups
may be of any size: a group's rows lie in as many partitions as they need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a block of ``blocks``.
BLOCK_ROWS = 1 << 16


def _same(group: Sequence[str]) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`"))
    return out


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "pos", size: str | None = None) -> DataFrame:
    """``df`` with the place (long, from 0) of each row in its group by ``order``,
    and with the number of rows of its group, if ``size`` names a column for it.

    Ties are in any order, but fixed, as the sorted table is written.  Rows that
    agree on group and order meet in one task: where a large share may, end the
    order with a column that tells them apart.
    """
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    at = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    table = written(at, "numbered").withColumn("__part", F.shiftrightunsigned("__at", 33))
    counts = table.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__base", F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first"))
    counts = counts.withColumn("__size", F.sum("__rows").over(Window.partitionBy(*group)))
    same = (F.col("a.__part") == F.col("b.__part")) & _same(group)
    joined = table.alias("a").join(counts.select("__part", *group, "__base", "__size").alias("b"), same)
    more = [F.col("b.__size").alias(size)] if size else []
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("a.__at") + F.col("b.__base")).alias(out), *more)


def blocks(df: DataFrame, group: Sequence[str], order: Sequence[Column], halo: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` in blocks of ``rows`` places: ``__pos``, ``__block`` and ``__own``.

    Each block also holds the ``halo`` rows before it, with ``__own`` false, so
    that windows over (group, block) see what they need.
    """
    placed = numbered(df, group, order, "__pos")
    own = F.floor(F.col("__pos") / rows).cast("long")
    last = F.floor((F.col("__pos") + halo) / rows).cast("long")
    spread = placed.withColumn("__own_block", own).withColumn("__block", F.explode(F.sequence("__own_block", last)))
    return spread.withColumn("__own", F.col("__own_block") == F.col("__block")).drop("__own_block")


def running_sum(df: DataFrame, value: str, group: Sequence[str], order: Sequence[Column], out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """The sum of ``value`` up to each row; null values add nothing."""
    cut = written(blocks(df, group, order, rows=rows), "blocks")
    sums = cut.groupBy(*group, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.sum("__sum").over(before)).select(*group, "__block", "__base")
    inside = Window.partitionBy(*group, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumn("__within", F.sum(value).over(inside))
    joined = within.alias("a").join(sums.alias("b"), (F.col("a.__block") == F.col("b.__block")) & _same(group))
    base, here = F.col("b.__base"), F.col("a.__within")
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], F.when(base.isNull(), here).when(here.isNull(), base).otherwise(base + here).alias(out))


def over_last(df: DataFrame, made, size: int, group: Sequence[str], order: Sequence[Column], out: str, rows: int = BLOCK_ROWS, frame: bool = True) -> DataFrame:
    """``made(window)``: a column over a window of the last ``size`` rows, the own
    one included; without ``frame``, for functions that count rows themselves."""
    cut = blocks(df, group, order, halo=size - 1, rows=rows)
    w = Window.partitionBy(*group, "__block").orderBy("__pos")
    w = w.rowsBetween(1 - size, 0) if frame else w
    return cut.withColumn(out, made(w)).filter("__own").select(*df.columns, out)
