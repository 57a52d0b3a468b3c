"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times in the
mix.  The expected copies are summed up along the documents of the source, one
random offset per source is added, and a document is emitted once for every
whole number that its piece of the sum crosses.  All of it is DataFrame code.

Defined results: a null text has size 0; a null source is a source of its own,
sorted last; sources whose documents are all empty have target 0 and take
nothing; documents of one size class are ordered by a digest of their id, so
reruns agree; very long texts only weigh more; repeated rows count as separate documents; an empty table gives an empty
result.  Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def size_class(size: Column) -> Column:
    """Sixteen classes per doubling, in whole-number arithmetic."""
    shift = F.greatest(F.length(F.bin(size)) - 5, F.lit(0))
    return (shift * 32).cast("long") + F.call_function("shiftright", size, shift)


def salt(doc_id: Column, digits: int) -> Column:
    """One of 16 ** digits even parts by a digest of the id."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, digits)


def offset(source: Column, seed: str) -> Column:
    """A fixed offset in [0, 1) for each source, a multiple of 2**-20."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def source_targets(totals: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """``totals`` (source, source_size) with ``weight`` and ``target``.

    The targets are the level that fills ``min(most * size, level * weight)`` up
    to the sum of all sizes: what sources beyond their limit leave is shared by
    the others by weight until none is above its limit.  One row per source goes
    through the two windows, never documents.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place - 1, F.lit(n)) + 1)
    t = totals.withColumn("weight", weight).withColumn("__limit", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("__limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    t = t.withColumn("__left", F.sum("source_size").over(whole) - F.coalesce(F.sum("__limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("__shares", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("__place", F.row_number().over(by))
    below = F.col("__left") * F.col("weight") / F.col("__shares") < F.col("__limit")
    first = F.min(F.when(below, F.struct("__place", "__left", "__shares"))).over(whole)
    t = t.withColumn("__first", first)
    target = F.least(F.col("__limit"), F.coalesce(F.col("__first.__left") * F.col("weight") / F.col("__first.__shares"), F.col("__limit")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def cell_digits(rows: int, cell_rows: int) -> int:
    """Digits of the salt by which ``rows`` fall in cells of about ``cell_rows``."""
    digits = 1
    while digits < 8 and 16**digits * cell_rows < rows:
        digits += 1
    return digits


def systematic_mix(docs: DataFrame, size: Column | None = None, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix", cell_rows: int = 200_000) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``most``).

    ``docs`` needs ``doc_id``, ``source`` and, unless ``size`` is given,
    ``text``.  Within a source the documents are taken by size class, so that
    the words taken come near the target whatever the spread of sizes, and in a
    class by salt.  A leading part of the salt, longer for larger tables, deals
    a class out in cells of about ``cell_rows`` rows that are ranked apart; it
    does not change the order.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    digits = cell_digits(docs.count(), cell_rows)
    sized = docs.withColumn("size", common.word_count(F.col("text")) if size is None else size)
    sized = sized.withColumn("__class", size_class(F.col("size"))).withColumn("__salt", salt(F.col("doc_id"), 8)).withColumn("__cell", F.substring("__salt", 1, digits))
    cells = common.checkpoint(sized.groupBy("source", "__class", "__cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")))
    totals = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most)
    # rows before a cell: in the classes before its own, and in its class
    earlier = lambda *keys: F.coalesce(F.sum("rows").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = cells.groupBy("source", "__class").agg(F.sum("rows").alias("rows")).withColumn("__before", earlier("source", "__class"))
    classes = classes.select(F.col("source").alias("__cs"), F.col("__class").alias("__cc"), "__before")
    base = cells.withColumn("__base", earlier("source", "__class", "__cell"))
    base = base.join(classes, base["source"].eqNullSafe(classes["__cs"]) & (base["__class"] == classes["__cc"])).withColumn("__base", F.col("__base") + F.col("__before"))
    base = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(
        base["source"].alias("__s"), F.col("__class").alias("__c"), F.col("__cell").alias("__t"), "__base", "source_size", "target"
    )
    inside = Window.partitionBy("source", "__class", "__cell").orderBy("__salt", "size", "doc_id")
    ranked = sized.withColumn("__rank", F.row_number().over(inside))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c")) & (F.col("__cell") == F.col("__t"))
    out = ranked.join(base, same, "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("__base") + F.col("__rank")
    start = offset(F.col("source"), seed)
    crossed = F.floor(place * rate + start) - F.floor((place - 1) * rate + start)
    out = out.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return out.drop("__class", "__salt", "__cell", "__rank", "__s", "__c", "__t", "__base")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as its ``copies`` says."""
    return mixed.filter(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = systematic_mix(common.read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
c AS (
  SELECT *, greatest(length(bin(size)) - 5, 0) AS sh, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS salt FROM d),
k AS (
  SELECT doc_id, source, size,
         row_number() OVER (PARTITION BY source ORDER BY sh * 32 + (size >> sh), salt, size, doc_id) AS place FROM c),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS lim, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ASC NULLS LAST) AS n FROM w),
f AS (
  SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE
            - coalesce(sum(lim) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS shares FROM l),
p AS (SELECT remaining, shares FROM f WHERE remaining * weight / shares < lim ORDER BY n LIMIT 1),
t AS (
  SELECT source, source_size,
         least(lim, coalesce((SELECT remaining FROM p) * weight / (SELECT shares FROM p), lim)) AS target FROM f),
r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, k.place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix' || coalesce(k.source, '')), 1, 5) AS BIGINT)::DOUBLE / 1048576.0::DOUBLE AS u
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(place * rate + u) - floor((place - 1) * rate + u), 3) AS BIGINT) * size AS taken,
       CAST(least(floor(place * rate + u) - floor((place - 1) * rate + u), 3) AS BIGINT) AS copies
FROM r
"""
