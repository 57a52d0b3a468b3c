"""Metric and bucket aggregations.

Metrics are columns for ``df.agg`` or ``groupBy().agg``; missing values are left
out.  Buckets take a DataFrame and metrics by name, and give one row a bucket
with ``doc_count``; several metrics of one grouping share its shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, net, text
from ..sources.shared import written
from . import scans
from .predicates import col

Metrics = Mapping[str, Column]
PERCENTS = (1, 5, 25, 50, 75, 95, 99)


# ---- metrics -------------------------------------------------------------


def sum_(field) -> Column:
    return F.coalesce(F.sum(col(field)), F.lit(0).cast("double"))


def avg(field) -> Column:
    return F.avg(col(field))


def min_(field) -> Column:
    return F.min(col(field))


def max_(field) -> Column:
    return F.max(col(field))


def value_count(field) -> Column:
    return F.count(col(field))


def cardinality(field, exact: bool = False) -> Column:
    return F.count_distinct(col(field)) if exact else F.approx_count_distinct(col(field))


def stats(field) -> Metrics:
    return {"count": value_count(field), "min": min_(field), "max": max_(field), "avg": avg(field), "sum": sum_(field)}


def extended_stats(field, sigma: float = 2.0) -> Metrics:
    c = col(field)
    return {
        **stats(field),
        "sum_of_squares": F.sum(c * c),
        "variance": F.var_pop(c),
        "std_deviation": F.stddev_pop(c),
        "upper": F.avg(c) + F.lit(sigma) * F.stddev_pop(c),
        "lower": F.avg(c) - F.lit(sigma) * F.stddev_pop(c),
    }


def percentiles(field, percents: Sequence[float] = PERCENTS, exact: bool = False) -> Metrics:
    c = col(field)
    shares = F.array(*[F.lit(p / 100) for p in percents])
    # one aggregate gives all of them; the optimiser keeps equal ones once
    found = F.percentile(c, shares) if exact else F.percentile_approx(c, shares, 10_000)
    return {f"p{p:g}".replace(".", "_"): found[i] for i, p in enumerate(percents)}


def exact_percentiles(df: DataFrame, field, percents: Sequence[float] = PERCENTS, by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles, interpolated, of all rows or of each group, as ``p95``.

    Equal values are counted first; the counts are summed along the values by
    ranges (``scans``), and each percentile is the first value that its place
    reaches.  No task or buffer holds all values, however many there are.
    """
    counts = df.select(*by, col(field).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v)").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    upto = written(scans.running_sum(counts, "__n", by, [F.asc("__v")], "__upto"), "upto")
    totals = upto.groupBy(*by).agg(F.max("__upto").alias("__total"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}"))
    if by:
        joined = upto.alias("a").join(totals.alias("b"), same).select(*[F.col(f"a.{b}") for b in by], "__v", "__upto", "__total")
    else:
        joined = upto.withColumn("__total", F.lit(totals.first()["__total"]).cast("long"))  # one number
    out = []
    for p in percents:
        place = (F.col("__total") - 1) * F.lit(p / 100)
        low, high = (F.min(F.when(F.col("__upto") > f(place), F.col("__v"))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        # weighed as the engine's own aggregate does, to the last bit
        out.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(f"p{p:g}".replace(".", "_")))
    return joined.groupBy(*by).agg(*out)


def percentile_ranks(field, values: Sequence[float]) -> Metrics:
    """Percent of values at most each given one."""
    return {f"rank_{v:g}".replace(".", "_").replace("-", "m"): F.avg(F.when(col(field).isNotNull(), (col(field) <= F.lit(v)).cast("int"))) * 100 for v in values}


def matrix_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row a field (count, mean, variance, skewness, kurtosis), then one a
    pair (covariance, correlation); only rows with all fields count."""
    whole = df.dropna(subset=list(fields))
    parts = []
    for f in fields:
        parts += [F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"mean_{f}"), F.var_samp(f).alias(f"var_{f}"), F.skewness(f).alias(f"skew_{f}"), (F.kurtosis(f) + 3).alias(f"kurt_{f}")]
    for a, b in combinations(fields, 2):
        parts += [F.covar_samp(a, b).alias(f"cov_{a}_{b}"), F.corr(a, b).alias(f"corr_{a}_{b}")]
    return whole.agg(*parts)


def top_hits(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` rows of each bucket, with ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= size)


# ---- buckets -------------------------------------------------------------


def _count(df: DataFrame, keys: Sequence[str], metrics: Metrics | None) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *[m.alias(n) for n, m in (metrics or {}).items()])


def _is_array(df: DataFrame, field: str) -> bool:
    return df.schema[field].dataType.typeName() == "array"


def terms(df: DataFrame, field: str, size: int = 10, metrics: Metrics | None = None, missing=None, min_doc_count: int = 1) -> DataFrame:
    """Buckets by value, most documents first, ties by value."""
    keyed = df.withColumn("key", F.explode(F.array_distinct(field)) if _is_array(df, field) else F.col(field))
    keyed = keyed.filter(F.col("key").isNotNull()) if missing is None else keyed.withColumn("key", F.coalesce("key", F.lit(missing)))
    out = _count(keyed, ["key"], metrics)
    if min_doc_count > 1:
        out = out.filter(F.col("doc_count") >= min_doc_count)
    return out.orderBy(F.desc("doc_count"), "key").limit(size)


def multi_terms(df: DataFrame, fields: Sequence[str], size: int = 10, metrics: Metrics | None = None) -> DataFrame:
    out = _count(df.dropna(subset=list(fields)), fields, metrics)
    return out.orderBy(F.desc("doc_count"), *fields).limit(size)


def nested_terms(df: DataFrame, fields: Sequence[str], metrics: Metrics | None = None) -> DataFrame:
    """Terms inside terms: a row for every level, deeper fields null."""
    return df.rollup(*fields).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("doc_count"), *[m.alias(n) for n, m in (metrics or {}).items()])


def histogram(df: DataFrame, field: str, interval: float, metrics: Metrics | None = None, fill: bool = False) -> DataFrame:
    """Buckets of ``interval``; ``fill`` adds the empty ones between."""
    keyed = df.filter(F.col(field).isNotNull()).withColumn("key", F.floor(F.col(field) / F.lit(interval)) * F.lit(interval))
    out = _count(keyed, ["key"], metrics)
    if not fill:
        return out
    out = written(out, "buckets")
    ends = out.agg(F.round(F.min("key") / interval).cast("long"), F.round(F.max("key") / interval).cast("long")).first()
    steps = _steps(df, ends).select((F.col("id") * F.lit(interval)).cast(out.schema["key"].dataType).alias("key"))
    return steps.join(out, "key", "left").fillna(0, ["doc_count"])


def _steps(df: DataFrame, ends) -> DataFrame:
    """Every number between two, over as many partitions as they need."""
    first, last = (0, -1) if ends[0] is None else ends
    return df.sparkSession.range(first, last + 1)


_CALENDAR = {"minute": "minute", "1m": "minute", "hour": "hour", "1h": "hour", "day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}


_FIXED = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def fixed_interval(interval: str) -> str:
    """``30m``, ``12h``, ``90s`` or ``7d`` in words; others as they are."""
    short = re.fullmatch(r"([0-9]+)(ms|s|m|h|d)", interval)
    return f"{short[1]} {_FIXED[short[2]]}" if short else interval


def date_histogram(df: DataFrame, field: str, interval: str, metrics: Metrics | None = None, fill: bool = False) -> DataFrame:
    """Buckets by calendar unit (``day``, ``1M`` ...) or a fixed interval (``30m``,
    ``"15 minutes"``), counted from 1970-01-01."""
    if interval not in _CALENDAR:
        interval = fixed_interval(interval)
    present = df.filter(F.col(field).isNotNull())
    if interval in _CALENDAR:
        keyed = present.withColumn("key", F.date_trunc(_CALENDAR[interval], field).cast("timestamp_ntz"))
    else:
        keyed = present.withColumn("key", F.window(field, interval)["start"].cast("timestamp_ntz"))
    out = _count(keyed, ["key"], metrics)
    if not fill:
        return out
    out = written(out, "buckets")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', key)")
    if interval in _CALENDAR:
        unit = _CALENDAR[interval].upper()
        months = F.year("key") * 12 + F.month("key") - 1
        size = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}.get(unit)
        number = (months / size).cast("long") if size else F.floor(at / _CALENDAR_MICROS[unit]).cast("long")
        back = F.make_timestamp_ntz(F.floor(F.col("id") * size / 12).cast("int"), (F.col("id") * size % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) if size else None
    else:
        start = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
        width = out.sparkSession.range(1).select(F.expr(f"timestampdiff(MICROSECOND, {start}, {start} + INTERVAL {interval})")).first()[0]
        number, back, unit = F.floor(at / int(width)).cast("long"), None, None
    ends = out.agg(F.min(number), F.max(number), F.min(at)).first()
    if back is None:
        size = int(width) if unit is None else _CALENDAR_MICROS[unit]
        offset = 0 if ends[2] is None else ends[2] % size  # weeks begin on Mondays
        back = F.expr(f"timestampadd(MICROSECOND, id * {size}L + {offset}L, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return _steps(df, ends[:2]).select(back.alias("key")).join(out, "key", "left").fillna(0, ["doc_count"])


_CALENDAR_MICROS = {"MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000, "WEEK": 604_800_000_000}


def _tagged(df: DataFrame, named: Mapping[str, Column], metrics: Metrics | None) -> DataFrame:
    """A row of ``df`` counts in every bucket whose condition it meets."""
    keys = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return _count(df.withColumn("key", F.explode(keys)), ["key"], metrics)


def range_buckets(df: DataFrame, field, ranges: Sequence[Mapping], metrics: Metrics | None = None) -> DataFrame:
    """Ranges with ``from`` (inclusive), ``to`` (exclusive) and maybe ``key``; they may overlap."""
    named = {}
    for r in ranges:
        low, high = r.get("from"), r.get("to")
        c = F.lit(True)
        if low is not None:
            c = c & (col(field) >= F.lit(low))
        if high is not None:
            c = c & (col(field) < F.lit(high))
        named[r.get("key") or f"{'*' if low is None else low}-{'*' if high is None else high}"] = c & col(field).isNotNull()
    return _tagged(df, named, metrics)


def date_range(df: DataFrame, field: str, ranges: Sequence[Mapping], pattern: str = "yyyy-MM-dd", metrics: Metrics | None = None) -> DataFrame:
    moments = [{**r, **{k: F.to_timestamp_ntz(F.lit(r[k]), F.lit(pattern)) for k in ("from", "to") if r.get(k)}, "key": r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}"} for r in ranges]
    return range_buckets(df, F.col(field).cast("timestamp_ntz"), moments, metrics)


def ip_range(df: DataFrame, field: str, ranges: Sequence[Mapping], metrics: Metrics | None = None) -> DataFrame:
    """Ranges of addresses: ``from``/``to`` or ``mask`` (a network)."""
    key, named = net.ip_key(F.col(field)), {}
    for r in ranges:
        if r.get("mask"):
            low, high = net.network_range(r["mask"])
            named[r.get("key") or r["mask"]] = key.between(low, high)
        else:
            c = key.isNotNull()
            if r.get("from"):
                c = c & (key >= net.key_of(r["from"]))
            if r.get("to"):
                c = c & (key < net.key_of(r["to"]))
            named[r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}"] = c
    return _tagged(df, named, metrics)


def filters(df: DataFrame, named: Mapping[str, Column], metrics: Metrics | None = None) -> DataFrame:
    return _tagged(df, named, metrics)


def filter_bucket(df: DataFrame, condition: Column, metrics: Metrics | None = None) -> DataFrame:
    return _count(df.filter(condition), [], metrics)


def adjacency_matrix(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """Counts of each filter and of each pair that a document meets (``a&b``)."""
    names = sorted(named)
    met = F.array_compact(F.array(*[F.when(named[n], F.lit(n)) for n in names]))
    pairs = F.flatten(F.transform(met, lambda a, i: F.transform(F.slice(met, i + 2, F.size(met)), lambda b: F.concat(a, F.lit("&"), b))))
    return _count(df.withColumn("key", F.explode(F.concat(met, pairs))), ["key"], None)


def significant_terms(df: DataFrame, where: Column, field: str, size: int = 10, min_doc_count: int = 3) -> DataFrame:
    """Values that rows meeting ``where`` have more often than all rows, by JLH score."""
    return _jlh(df.select(where.alias("here"), F.array(F.col(field)).alias("keys")), size, min_doc_count)


def significant_text(df: DataFrame, where: Column, field: str, size: int = 10, min_doc_count: int = 3) -> DataFrame:
    """The same over the distinct tokens of a text."""
    return _jlh(df.select(where.alias("here"), F.array_distinct(text.tokens(F.col(field))).alias("keys")), size, min_doc_count)


def _jlh(rows: DataFrame, size: int, least: int) -> DataFrame:
    """Both counts of every key in one pass; the null key counts the rows themselves."""
    kind = rows.schema["keys"].dataType
    held = F.filter(F.coalesce("keys", F.array().cast(kind)), lambda k: k.isNotNull())
    keyed = rows.select(F.coalesce("here", F.lit(False)).alias("here"), F.explode(F.concat(held, F.array(F.lit(None).cast(kind.elementType)))).alias("key"))
    counts = written(keyed.groupBy("key").agg(F.count_if("here").alias("doc_count"), F.count(F.lit(1)).alias("bg_count")), "counts")
    whole = counts.filter("key IS NULL").first()  # one row
    n, all_n = (whole["doc_count"], whole["bg_count"]) if whole else (0, 0)
    fg, bg = F.col("doc_count") / F.lit(float(max(n, 1))), F.col("bg_count") / F.lit(float(max(all_n, 1)))
    scored = counts.filter(F.col("key").isNotNull() & (F.col("doc_count") >= least)).withColumn("score", F.when(fg > bg, (fg - bg) * (fg / bg)))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), "key").limit(size)


def overall(df: DataFrame, named: Mapping[str, Column], metrics: Metrics | None = None) -> DataFrame:
    """One row over all rows, whatever is searched for: ``everything``, how many meet
    each condition, and metrics; in one pass."""
    return df.agg(F.count(F.lit(1)).alias("everything"), *[F.count_if(c).alias(n) for n, c in named.items()], *[m.alias(n) for n, m in (metrics or {}).items()])


def nested(df: DataFrame, path: str) -> DataFrame:
    """A row for each element of an array of structs, beside its parent's columns."""
    return df.withColumn(path, F.explode(path)).select(*[c for c in df.columns if c != path], F.col(f"{path}.*"))


def reverse_nested(df: DataFrame, parent: str, by: Sequence[str]) -> DataFrame:
    """Distinct parents of exploded rows, counted by bucket."""
    return df.groupBy(*by).agg(F.count_distinct(parent).alias("doc_count"))


def sampler(df: DataFrame, order: Sequence[Column], shard_size: int) -> DataFrame:
    return df.orderBy(*order).limit(shard_size)


def diversified_sampler(df: DataFrame, field: str, order: Sequence[Column], shard_size: int, most_per_value: int = 1) -> DataFrame:
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(field).orderBy(*order)))
    return ranked.filter(F.col("__r") <= most_per_value).drop("__r").orderBy(*order).limit(shard_size)


def geo_distance(df: DataFrame, lat, lon, origin: tuple[float, float], ranges: Sequence[Mapping], metrics: Metrics | None = None) -> DataFrame:
    """Rings around an origin, in metres."""
    return range_buckets(df.withColumn("__d", geo.distance_m(col(lat), col(lon), *origin)), "__d", ranges, metrics)


def geohash_grid(df: DataFrame, lat, lon, precision: int = 5, metrics: Metrics | None = None) -> DataFrame:
    return _count(df.withColumn("key", geo.geohash(col(lat), col(lon), precision)).filter("key IS NOT NULL"), ["key"], metrics)


def geotile_grid(df: DataFrame, lat, lon, zoom: int = 7, metrics: Metrics | None = None) -> DataFrame:
    return _count(df.withColumn("key", geo.geotile(col(lat), col(lon), zoom)).filter("key IS NOT NULL"), ["key"], metrics)


# ---- over buckets ----------------------------------------------------------


def bucket_metric(buckets: DataFrame, value: str, kind: str) -> DataFrame:
    """sum, avg, min, max, stats or extended_stats over all buckets."""
    if kind in ("min", "max"):
        best = F.min(value) if kind == "min" else F.max(value)
        at = F.min_by("key", F.struct(value, "key")) if kind == "min" else F.max_by("key", F.struct(value, "key"))
        return buckets.agg(best.alias("value"), at.alias("key"))
    if kind in ("stats", "extended_stats"):
        named = stats(value) if kind == "stats" else extended_stats(value)
        return buckets.agg(*[m.alias(n) for n, m in named.items()])
    return buckets.agg({"sum": F.sum, "avg": F.avg}[kind](value).alias("value"))


def _key(key: str) -> list[Column]:
    return [F.asc_nulls_first(key)]


def cumulative_sum(buckets: DataFrame, value: str, out: str = "cumulative_sum", key: str = "key", parent: Sequence[str] = ()) -> DataFrame:
    """Running sums in the order of ``key``; like the other functions along buckets
    it deals them out by ranges, so their number and a parent's share don't matter."""
    return scans.running_sum(buckets, value, parent, _key(key), out)


def serial_diff(buckets: DataFrame, value: str, lag: int = 1, out: str = "serial_diff", key: str = "key", parent: Sequence[str] = ()) -> DataFrame:
    before = lambda w: F.col(value) - F.lag(value, lag).over(w)
    return scans.over_last(buckets, before, lag + 1, parent, _key(key), out, frame=False)


def derivative(buckets: DataFrame, value: str, out: str = "derivative", key: str = "key", parent: Sequence[str] = ()) -> DataFrame:
    return serial_diff(buckets, value, 1, out, key, parent)


def moving_avg(buckets: DataFrame, value: str, window: int = 5, model: str = "simple", alpha: float = 0.3, out: str = "moving_avg", key: str = "key", parent: Sequence[str] = ()) -> DataFrame:
    """``simple``, ``linear`` (later values weigh more) or ``ewma``, over the last
    ``window`` buckets, the own one included."""

    def mean(w) -> Column:
        if model == "simple":
            return F.avg(value).over(w)
        last = F.collect_list(F.col(value).cast("double")).over(w)
        if model == "linear":
            total = F.aggregate(F.transform(last, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
            return total / (F.size(last) * (F.size(last) + 1) / 2)
        return F.aggregate(F.slice(last, 2, window), F.get(last, F.lit(0)), lambda a, b: a * (1 - alpha) + b * alpha)

    if model not in ("simple", "linear", "ewma"):
        raise ValueError(f"no such model: {model}")
    return scans.over_last(buckets, mean, window, parent, _key(key), out)


def bucket_sort(buckets: DataFrame, order: Sequence[Column], size: int, offset: int = 0, parent: Sequence[str] = ()) -> DataFrame:
    if not parent:
        return buckets.orderBy(*order).offset(offset).limit(size)
    ranked = buckets.withColumn("__r", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))
    return ranked.filter((F.col("__r") > offset) & (F.col("__r") <= offset + size)).drop("__r")
