"""Documents drawn by how much more their n-grams occur in a target than here.

Each hashed n-gram has a gain, the log ratio of its shares in the target and in
the documents; a document's weight is the sum of its gains, and the highest
weights plus Gumbel noise are drawn, which samples without replacement in
proportion to the weights' exponentials.  All in columns: texts are read and
hashed once, bucket numbers are stored, and counts, gains and sums are made from
these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import numbered
from ..sources.shared import written
from . import common

#: A word once A-Z are small letters: runs of digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most buckets: the table of gains, 16 bytes each, is sent to all executors.
MOST_BUCKETS = 1 << 20


@dataclass(frozen=True)
class Resampling:
    """``least``..``most`` words a feature; ``percent`` of the documents of at
    least ``least_words`` words are drawn; ``seed`` names the noise."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024

    def __post_init__(self):
        if not 1 <= self.least <= self.most:
            raise ValueError("1 <= least <= most")
        if not 1 <= self.buckets <= MOST_BUCKETS:
            raise ValueError(f"1 to {MOST_BUCKETS} buckets")


def words(text: Column) -> Column:
    """The words of a text, null for null."""
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(small, F.lit(WORD), F.lit(0))


def ngrams(found: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` consecutive words, repeats included."""
    if least == most == 1:
        return found

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return F.concat(*[runs(n) for n in range(least, most + 1)])


def hashed(docs: DataFrame, how: Resampling, keep: list[str]) -> DataFrame:
    """``keep``, ``n_words`` and ``buckets``: the bucket of each feature, in order."""
    found = docs.select(*keep, F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("__words"))
    runs = ngrams(F.col("__words"), how.least, how.most)
    buckets = F.transform(runs, lambda f: (F.crc32(f) % how.buckets).cast("int"))
    return found.select(*keep, F.size("__words").cast("long").alias("n_words"), buckets.alias("buckets"))


def gains(docs: DataFrame, target: DataFrame, how: Resampling) -> DataFrame:
    """(bucket, gain) of every bucket that occurs, from tables with ``buckets``."""
    here = docs.select(F.explode("buckets").alias("bucket"), F.lit(0).alias("far"))
    there = target.select(F.explode("buckets").alias("bucket"), F.lit(1).alias("far"))
    sums = here.union(there).groupBy("bucket").agg(F.sum(1 - F.col("far")).cast("double").alias("s"), F.sum("far").cast("double").alias("t"))
    totals = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()  # two numbers
    n = float(how.buckets)
    ratio = (F.col("t") + 1.0) * F.lit((totals["all_s"] or 0.0) + n) / ((F.col("s") + 1.0) * F.lit((totals["all_t"] or 0.0) + n))
    return sums.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``n_features``, ``weight``,
    ``score`` and ``rank`` (from 1; null where the document is not drawn).

    ``docs`` has doc_id and text, ``target`` has text.  Null texts have no
    features; without features the weight is 0.  Ties go to the smaller doc_id,
    a null one first, then to the row read first; repeated rows are drawn each
    for itself.  Empty tables give no rows; an empty target gives gains all the
    same.  Columns of ``docs`` that have names used here must be held apart by
    the caller (``common.held_apart``).
    """
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    table = written(hashed(rows, how, [*keep, "__row"]), "buckets")
    gain = F.broadcast(gains(table, hashed(target, how, []), how))  # bounded by MOST_BUCKETS
    features = table.select("__row", F.explode("buckets").alias("bucket"))
    weights = features.join(gain, "bucket").groupBy("__row").agg(F.sum("gain").alias("__weight"))
    head = table.select(*keep, "__row", "n_words", F.size("buckets").cast("long").alias("n_features"))
    name = F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((noise + 0.5) / F.lit(4294967296.0)))).cast("long")
    weighed = head.join(weights, "__row", "left").withColumn("weight", F.coalesce("__weight", F.lit(0)).cast("long"))
    enough = F.col("n_words") >= how.least_words
    scored = weighed.withColumn("score", F.col("weight") + gumbel).withColumn("__enough", enough).drop("__weight")
    scored = written(scored, "scores")
    drawn = how.percent * scored.filter("__enough").count() // 100
    placed = numbered(scored, [], [F.desc("__enough"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("__row")], "__pos")
    rank = F.when(F.col("__enough") & (F.col("__pos") < drawn), F.col("__pos") + 1)
    return placed.select(*keep, "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight, score and rank of every document for the target ``benchmark``."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, common.read(spark, sf_dir, "benchmark").select("text"))


#: crc32 of the UTF-8 bytes of ``{x}``, bit by bit, as DuckDB has no such function.
CRC32_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode({x}))) // 2 + 1), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i - 1, 2) AS BIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"
)

OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS w
  FROM benchmark),
e AS (SELECT r, unnest(ws) AS w FROM d),
v AS (SELECT w, {CRC32_SQL.format(x="w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM e UNION ALL SELECT w FROM b))),
c AS (
  SELECT bucket, CAST(sum(near) AS DOUBLE) AS s, CAST(sum(far) AS DOUBLE) AS t
  FROM (SELECT w, 1 AS near, 0 AS far FROM e UNION ALL SELECT w, 0, 1 FROM b) JOIN v USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000::DOUBLE * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000::DOUBLE) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000::DOUBLE)))) AS BIGINT) AS gain
  FROM c),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN v USING (w) JOIN g USING (bucket) GROUP BY r),
k AS (
  SELECT doc_id, r, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS FIRST, r) AS place,
         10 * (SELECT count(*) FROM k WHERE n_features >= 20) // 100 AS drawn
  FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN CAST(place AS BIGINT) END AS rank
FROM o
"""
