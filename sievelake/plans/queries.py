"""Registered queries of the engine's own operators, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, entities, geo, net, semantics, text
from ..functions.record import Record, register, where_record
from ..operators import aggregations as A
from ..operators import ivf, parsing
from ..operators import predicates as P
from ..operators import rollups
from ..operators import rules as R
from ..operators.search import Search, visible
from ..sources import tables
from ..sources.keyed import KeyedTable
from ..sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x, n: int = 4) -> Column:
    return F.round(x, n)


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_count", F.col("doc_count").cast("long"))


# ---- predicates ------------------------------------------------------------


def _predicate(name: str, table: str, key: str, condition: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _t(spark, d, table).filter(condition()).select(key)

    run.__name__ = name
    query(f"SELECT {key} FROM {table} WHERE {sql}")(run)


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"

_predicate("term", "orders", "o_orderkey", lambda: P.term("o_orderstatus", "F"), "o_orderstatus = 'F'")
_predicate("terms", "customer", "c_custkey", lambda: P.terms("c_mktsegment", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_predicate("range_closed", "lineitem", "l_orderkey", lambda: P.between("l_quantity", gte=10, lt=20), "l_quantity >= 10 AND l_quantity < 20")
_predicate("range_date", "orders", "o_orderkey", lambda: P.range_("o_orderdate", "gte", "1996-01-01") & P.range_("o_orderdate", "lt", "1997-01-01"), "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
_predicate("exists_field", "events", "event_id", lambda: P.exists(F.nullif(F.col("event_type"), F.lit("error"))), "event_type <> 'error'")
_predicate("prefix", "part", "p_partkey", lambda: P.prefix("p_type", "PROMO"), "starts_with(p_type, 'PROMO')")
_predicate("wildcard", "part", "p_partkey", lambda: P.wildcard("p_type", "*A*D?R*"), "p_type LIKE '%A%D_R%'")
_predicate("regexp", "part", "p_partkey", lambda: P.regexp("p_brand", "Brand#[1-3][24]"), "regexp_full_match(p_brand, 'Brand#[1-3][24]')")
_predicate("ids", "customer", "c_custkey", lambda: P.ids([1, 5, 9, 9999999], "c_custkey"), "c_custkey IN (1, 5, 9, 9999999)")
_predicate("match", "documents", "doc_id", lambda: P.match("text", "The einheit"), f"list_has_any({TOKENS}, ['the', 'einheit'])")
_predicate("match_and", "documents", "doc_id", lambda: P.match("text", "the of", "and"), f"list_has_all({TOKENS}, ['the', 'of'])")
_predicate("match_minimum", "documents", "doc_id", lambda: P.match("text", "the of la und", minimum=2), f"len(list_intersect({TOKENS}, ['the', 'of', 'la', 'und'])) >= 2")
_predicate("match_phrase", "documents", "doc_id", lambda: P.match_phrase("text", "in the"), f"contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' in the ')")
_predicate("match_phrase_prefix", "documents", "doc_id", lambda: P.match_phrase_prefix("text", "of th"), f"contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of th')")
_predicate("match_bool_prefix", "documents", "doc_id", lambda: P.match_bool_prefix("text", "lichung ein"), f"list_contains({TOKENS}, 'lichung') OR len(list_filter({TOKENS}, lambda t: starts_with(t, 'ein'))) > 0")
_predicate("fuzzy", "documents", "doc_id", lambda: P.fuzzy("text", "there"), f"len(list_filter({TOKENS}, lambda t: levenshtein(t, 'there') <= 1)) > 0")
_predicate("multi_match", "documents", "doc_id", lambda: P.multi_match("src3 ist", ["text", "source"]), f"list_has_any({TOKENS}, ['src3', 'ist']) OR list_has_any(list_filter(regexp_split_to_array(lower(source), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ['src3', 'ist'])")
_predicate("match_all", "orders", "o_orderkey", P.match_all, "true")
_predicate("wildcard_escaped", "orders", "o_orderkey", lambda: P.wildcard(F.concat(F.lit("a*"), F.col("o_orderstatus"), F.lit("?")), "a\\*?\\?") & P.wildcard("o_orderpriority", "1*"), "o_orderpriority LIKE '1%'")
_predicate("cidr_mapped", "customer", "c_custkey", lambda: P.cidr(F.concat(F.lit("::ffff:10.0.0."), (F.col("c_custkey") % 200).cast("string")), "10.0.0.0/28"), "c_custkey % 200 < 16")
_predicate("must_not_null", "events", "event_id", lambda: P.none_of(P.term(F.nullif(F.col("event_type"), F.lit("error")), "click")), "event_type <> 'click'")
_predicate(
    "bool_query",
    "orders",
    "o_orderkey",
    lambda: P.bool_query(must=[P.between("o_totalprice", gt=1000)], should=[P.term("o_orderstatus", "F"), P.term("o_orderpriority", "1-URGENT"), P.between("o_totalprice", gt=200000)], must_not=[P.term("o_orderstatus", "P")], minimum_should_match=2),
    "o_totalprice > 1000 AND o_orderstatus <> 'P' AND (o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT + (o_totalprice > 200000)::INT >= 2",
)
_predicate("bool_percent", "orders", "o_orderkey", lambda: P.at_least("67%", P.term("o_orderstatus", "F"), P.term("o_orderpriority", "1-URGENT"), P.between("o_totalprice", gt=100000)), "(o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT + (o_totalprice > 100000)::INT >= 2")

_IP = "concat('10.', CAST(c_custkey % 4 AS {s}), '.', CAST(c_custkey % 7 AS {s}), '.', CAST(c_custkey % 200 AS {s}))"


def _ip() -> Column:
    return F.expr(_IP.format(s="string"))


_predicate("cidr", "customer", "c_custkey", lambda: P.cidr(_ip(), "10.1.0.0/16"), "c_custkey % 4 = 1")
_predicate("cidrs", "customer", "c_custkey", lambda: P.cidrs(_ip(), ["10.1.2.0/24", "10.3.0.0/16", "fe80::/10"]), "c_custkey % 4 = 3 OR (c_custkey % 4 = 1 AND c_custkey % 7 = 2)")
_NETS = "SELECT '10.' || CAST(s_suppkey % 4 AS {s}) || '.' || CASE WHEN s_suppkey % 3 = 0 THEN '0.0/16' ELSE CAST(s_suppkey % 7 AS {s}) || '.' || CASE WHEN s_suppkey % 3 = 1 THEN '0/24' ELSE CAST(s_suppkey % 200 AS {s}) || '/30' END END AS cidr, s_suppkey"
_NETS_SQL = f"""
WITH n AS ({_NETS.format(s='VARCHAR')} FROM supplier),
m AS (SELECT *, CAST(regexp_extract(cidr, '/([0-9]+)', 1) AS INT) AS bits, regexp_extract(cidr, '^(.*)/', 1) AS base FROM n),
v AS (SELECT *, list_reduce(list_transform(string_split(base, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS low FROM m),
c AS (SELECT c_custkey, (10 * 256 + c_custkey % 4) * 65536 + (c_custkey % 7) * 256 + c_custkey % 200 AS num FROM customer),
j AS (SELECT c_custkey, cidr, s_suppkey, bits FROM c JOIN v ON num >> (32 - bits) = low >> (32 - bits))
"""


def _nets(spark, d) -> DataFrame:
    return _t(spark, d, "supplier").selectExpr(*_NETS.format(s="string").removeprefix("SELECT ").rsplit(", ", 1))


@query(f"{_NETS_SQL} SELECT c_custkey, cidr, s_suppkey FROM j")
def network_join(spark, d):
    """Every network of a table that an address lies in; networks overlap."""
    return net.join_networks(_t(spark, d, "customer").select("c_custkey", _ip().alias("ip")), "ip", _nets(spark, d), longest=False).select("c_custkey", "cidr", "s_suppkey")


@query(f"{_NETS_SQL} SELECT c_custkey, arg_max(cidr, (bits, -s_suppkey)) AS cidr, arg_max(s_suppkey, (bits, -s_suppkey)) AS s_suppkey FROM j GROUP BY 1")
def network_longest(spark, d):
    return net.join_networks(_t(spark, d, "customer").select("c_custkey", _ip().alias("ip")), "ip", _nets(spark, d)).select("c_custkey", "cidr", "s_suppkey")


_RANGE = (lambda: F.expr("concat('10.', cast(c_custkey % 4 as string), '.0.0')"), lambda: F.expr("concat('10.', cast(c_custkey % 4 + c_custkey % 3 as string), '.255.255')"))
_predicate("ip_range_contains", "customer", "c_custkey", lambda: P.ip_range_contains(_RANGE[0](), _RANGE[1](), "10.3.7.7"), "c_custkey % 4 <= 3 AND c_custkey % 4 + c_custkey % 3 >= 3")
_predicate("ip_range_intersects", "customer", "c_custkey", lambda: P.ip_range_intersects(_RANGE[0](), _RANGE[1](), "10.2.0.0", "10.2.0.9"), "c_custkey % 4 <= 2 AND c_custkey % 4 + c_custkey % 3 >= 2")
_predicate("ip_range_within", "customer", "c_custkey", lambda: P.ip_range_within(_RANGE[0](), _RANGE[1](), "10.1.0.0", "10.3.255.255"), "c_custkey % 4 >= 1 AND c_custkey % 4 + c_custkey % 3 <= 3")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def visibility(spark, d):
    docs = _t(spark, d, "documents").withColumn("visibleBy", F.array("source"))
    return visible(docs, ["src1", "src2"]).filter(P.term("lang", "en")).select("doc_id")


# ---- search pages ------------------------------------------------------------


def _orders(spark, d) -> Search:
    return Search(_t(spark, d, "orders"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def sort_page(spark, d):
    return _orders(spark, d).must(P.term("o_orderstatus", "O")).sort("o_totalprice", "desc").from_(40).size(20).include("o_orderkey", "o_totalprice").hits()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 50) ORDER BY o_custkey, o_orderkey LIMIT 25")
def search_after(spark, d):
    return _orders(spark, d).sort("o_custkey").search_after(100, 50).size(25).include("o_orderkey", "o_custkey").hits()


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r = 1")
def collapse(spark, d):
    return _orders(spark, d).sort("o_totalprice", "desc").collapse("o_custkey").size(2_000_000_000).include("o_custkey", "o_orderkey").hits()


@query("SELECT o_orderkey, o_custkey, o_custkey * 2 AS twice FROM orders")
def script_fields(spark, d):
    return Search(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").script_field("twice", "o_custkey * 2").size(2_000_000_000).hits()


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def source_exclude(spark, d):
    found = Search(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return found.exclude("o_custkey").size(2_000_000_000).hits()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 2000")
def sql_condition(spark, d):
    return _orders(spark, d).where("o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 2000").matches().select("o_orderkey")


_V = [round(0.05 * ((i * 7) % 13 - 6), 2) for i in range(64)]
_VSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _V) + "]"
_D2 = f"list_sum(list_transform(list_zip(embedding, {_VSQL}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))"
_DOT = f"list_sum(list_transform(list_zip(embedding, {_VSQL}), lambda p: p[1]::DOUBLE * p[2]))"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


def _near(spark, d, space="l2", **options):
    s = Search(_t(spark, d, "embeddings"), "vec_id").knn("embedding", _V, 10, space, **options)
    return s.hits().select("vec_id", _r(F.col("_score"), 6).alias("score"))


@query(f"SELECT vec_id, round(1 / (1 + {_D2}), 6) AS score FROM embeddings ORDER BY {_D2}, vec_id LIMIT 10")
def knn_l2(spark, d):
    return _near(spark, d)


@query(f"SELECT vec_id, round((1 + {_DOT} / ({_NORM} * {sum(x * x for x in _V) ** 0.5!r}::DOUBLE)) / 2, 6) AS score FROM embeddings ORDER BY {_DOT} / {_NORM} DESC, vec_id LIMIT 10")
def knn_cosine(spark, d):
    return _near(spark, d, "cosinesimil")


@query(f"SELECT vec_id, round(CASE WHEN {_DOT} >= 0 THEN {_DOT} + 1 ELSE 1 / (1 - {_DOT}) END, 6) AS score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def knn_inner_product(spark, d):
    return _near(spark, d, "innerproduct")


@query(f"SELECT vec_id, round(1 / (1 + {_D2}), 6) AS score FROM embeddings WHERE label = 1 ORDER BY {_D2}, vec_id LIMIT 10")
def knn_filter(spark, d):
    return _near(spark, d, filter=P.term("label", 1))


@query(f"SELECT vec_id, round(1 / (1 + {_D2}), 6) AS score FROM embeddings WHERE 1 / (1 + {_D2}) >= 0.25 ORDER BY {_D2}, vec_id LIMIT 10")
def knn_min_score(spark, d):
    return _near(spark, d, min_score=0.25)


@query(f"SELECT vec_id, round(1 / (1 + {_D2}), 6) AS score FROM embeddings WHERE sqrt({_D2}) <= 1.8 ORDER BY {_D2}, vec_id LIMIT 10")
def knn_max_distance(spark, d):
    return _near(spark, d, max_distance=1.8)


def _index(spark, d) -> ivf.VectorIndex:
    return ivf.VectorIndex.build(_t(spark, d, "embeddings"), "vec_id", "embedding", f"{shared_folder(spark)}/ivf-{uuid.uuid4().hex}", clusters=32)


@query(f"SELECT vec_id, round(1 / (1 + {_D2}), 6) AS score FROM embeddings ORDER BY {_D2}, vec_id LIMIT 10")
def knn_index(spark, d):
    """All clusters of an inverted file, chosen by codes and scored exactly."""
    return _index(spark, d).search(_V, 10, nprobe=32, oversample=10).select("vec_id", _r(F.col("_score"), 6).alias("score"))


# ---- metrics -----------------------------------------------------------------


@query("SELECT round(sum(l_quantity), 2) s, round(avg(l_discount), 6) a, min(l_tax) lo, max(l_tax) hi, count(l_quantity) n, count(DISTINCT l_suppkey) c FROM lineitem")
def metrics(spark, d):
    return _t(spark, d, "lineitem").agg(_r(A.sum_("l_quantity"), 2).alias("s"), _r(A.avg("l_discount"), 6).alias("a"), A.min_("l_tax").alias("lo"), A.max_("l_tax").alias("hi"), A.value_count("l_quantity").alias("n"), A.cardinality("l_suppkey", exact=True).alias("c"))


@query(
    "SELECT l_returnflag AS key, count(*) AS doc_count, count(l_extendedprice) AS \"count\", round(min(l_extendedprice), 2) AS \"min\", round(max(l_extendedprice), 2) AS \"max\", round(avg(l_extendedprice), 2) AS \"avg\", round(sum(l_extendedprice), 1) AS \"sum\", "
    "round(stddev_pop(l_extendedprice), 2) AS std_deviation, round(avg(l_extendedprice) + 2 * stddev_pop(l_extendedprice), 2) AS upper FROM lineitem GROUP BY 1"
)
def extended_stats(spark, d):
    m = A.extended_stats("l_extendedprice")
    keep = {k: _r(m[k], 1 if k == "sum" else 2) for k in ("min", "max", "avg", "sum", "std_deviation", "upper")} | {"count": m["count"]}
    return A.terms(_t(spark, d, "lineitem"), "l_returnflag", 100, keep)


@query("SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 3) AS p{p}" for p in A.PERCENTS) + " FROM lineitem")
def percentiles(spark, d):
    found = A.exact_percentiles(_t(spark, d, "lineitem"), "l_extendedprice", A.PERCENTS)
    return found.select(*[_r(f"p{p}", 3).alias(f"p{p}") for p in A.PERCENTS])


@query("SELECT round(100.0 * avg((l_quantity <= 10)::INT), 4) AS rank_10, round(100.0 * avg((l_quantity <= 25)::INT), 4) AS rank_25 FROM lineitem")
def percentile_ranks(spark, d):
    return _t(spark, d, "lineitem").agg(*[_r(c).alias(n) for n, c in A.percentile_ranks("l_quantity", [10, 25]).items()])


@query("SELECT count(*) AS n, round(avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 3) AS var, round(covar_samp(l_quantity, l_extendedprice), 1) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS cor FROM lineitem")
def matrix_stats(spark, d):
    m = A.matrix_stats(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return m.select(F.col("n_l_quantity").alias("n"), _r("mean_l_quantity").alias("mean"), _r("var_l_quantity", 3).alias("var"), _r("cov_l_quantity_l_extendedprice", 1).alias("cov"), _r("corr_l_quantity_l_extendedprice", 6).alias("cor"))


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT rank FROM customer) WHERE rank <= 3")
def top_hits(spark, d):
    return A.top_hits(_t(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


# ---- buckets -----------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) doc_count, round(avg(l_extendedprice), 4) avg_price FROM lineitem WHERE l_quantity >= 10 AND NOT coalesce(l_returnflag = 'N', false) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def flagship(spark, d):
    found = Search(_t(spark, d, "lineitem"), "l_orderkey").must(P.range_("l_quantity", "gte", 10)).must_not(P.term("l_returnflag", "N")).matches()
    return A.multi_terms(found, ["l_returnflag", "l_linestatus"], 10, {"avg_price": _r(A.avg("l_extendedprice"))})


@query("SELECT o_custkey AS key, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def terms_agg(spark, d):
    return A.terms(_t(spark, d, "orders"), "o_custkey", 50, {"total": _r(A.sum_("o_totalprice"), 2)})


@query("SELECT w AS key, count(*) AS doc_count FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) w FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def terms_array(spark, d):
    return A.terms(_t(spark, d, "documents").withColumn("w", F.split("text", " ", -1)), "w", 30)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS doc_count FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def multi_terms(spark, d):
    return A.multi_terms(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 10)


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS level, count(*) AS doc_count, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def nested_terms(spark, d):
    out = A.nested_terms(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"mean": _r(A.avg("o_totalprice"), 2)})
    return out.withColumn("level", F.col("level").cast("long"))


@query("SELECT floor(l_quantity / 7.0::DOUBLE) * 7.0::DOUBLE AS key, count(*) AS doc_count, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1")
def histogram(spark, d):
    return A.histogram(_t(spark, d, "lineitem"), "l_quantity", 7.0, {"tax": _r(A.avg("l_tax"), 6)})


@query("WITH b AS (SELECT CAST(floor(o_totalprice / 10.0::DOUBLE) AS BIGINT) k, count(*) n FROM orders GROUP BY 1) SELECT g * 10.0::DOUBLE AS key, coalesce(n, 0) AS doc_count FROM (SELECT unnest(range((SELECT min(k) FROM b), (SELECT max(k) FROM b) + 1)) g) LEFT JOIN b ON g = k")
def histogram_filled(spark, d):
    return _long(A.histogram(_t(spark, d, "orders"), "o_totalprice", 10.0, fill=True))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS key, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def date_histogram(spark, d):
    return A.date_histogram(_t(spark, d, "orders"), "o_orderdate", "month", {"total": _r(A.sum_("o_totalprice"), 2)})


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS key, count(*) AS doc_count FROM events GROUP BY 1")
def date_histogram_fixed(spark, d):
    return A.date_histogram(_t(spark, d, "events"), "ts", "15 minutes")


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) AS key, count(*) AS doc_count FROM events GROUP BY 1")
def date_histogram_short(spark, d):
    return A.date_histogram(_t(spark, d, "events"), "ts", "30m")


_RANGES = [{"to": 100}, {"from": 50, "to": 200, "key": "mid"}, {"from": 200}]


@query("SELECT key, count(*) AS doc_count FROM (SELECT unnest([CASE WHEN value < 100 THEN '*-100' END, CASE WHEN value >= 50 AND value < 200 THEN 'mid' END, CASE WHEN value >= 200 THEN '200-*' END]) AS key FROM events) WHERE key IS NOT NULL GROUP BY 1")
def range_agg(spark, d):
    return A.range_buckets(_t(spark, d, "events"), "value", _RANGES)


@query("SELECT key, count(*) AS doc_count FROM (SELECT unnest([CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN '*-1996-01-01' END, CASE WHEN o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'middle' END]) AS key FROM orders) WHERE key IS NOT NULL GROUP BY 1")
def date_range(spark, d):
    return A.date_range(_t(spark, d, "orders"), "o_orderdate", [{"to": "1996-01-01"}, {"from": "1995-06-01", "to": "1997-01-01", "key": "middle"}])


@query("SELECT key, count(*) AS doc_count FROM (SELECT unnest([CASE WHEN c_custkey % 4 = 1 THEN 'one' END, CASE WHEN c_custkey % 4 < 2 THEN '*-10.2.0.0' END]) AS key FROM customer) WHERE key IS NOT NULL GROUP BY 1")
def ip_range_agg(spark, d):
    return A.ip_range(_t(spark, d, "customer").withColumn("ip", _ip()), "ip", [{"mask": "10.1.0.0/16", "key": "one"}, {"to": "10.2.0.0"}])


@query("SELECT key, count(*) AS doc_count, round(avg(value), 4) AS mean FROM (SELECT value, unnest([CASE WHEN event_type = 'error' THEN 'errors' END, CASE WHEN value > 50 THEN 'large' END]) AS key FROM events) WHERE key IS NOT NULL GROUP BY 1")
def filters_agg(spark, d):
    return A.filters(_t(spark, d, "events"), {"errors": P.term("event_type", "error"), "large": P.between("value", gt=50)}, {"mean": _r(A.avg("value"))})


@query("SELECT count(*) AS doc_count, round(avg(value), 4) AS mean FROM events WHERE event_type = 'click'")
def filter_agg(spark, d):
    return A.filter_bucket(_t(spark, d, "events"), P.term("event_type", "click"), {"mean": _r(A.avg("value"))})


@query(
    "WITH m AS (SELECT list_filter(['big', 'f', 'urgent'], lambda n: CASE n WHEN 'big' THEN o_totalprice > 150000 WHEN 'f' THEN o_orderstatus = 'F' ELSE o_orderpriority = '1-URGENT' END) l FROM orders) "
    "SELECT key, count(*) AS doc_count FROM (SELECT unnest(l) AS key FROM m UNION ALL SELECT a || '&' || b FROM m, unnest(l) x(a), unnest(l) y(b) WHERE a < b) GROUP BY 1"
)
def adjacency_matrix(spark, d):
    return A.adjacency_matrix(_t(spark, d, "orders"), {"big": P.between("o_totalprice", gt=150000), "f": P.term("o_orderstatus", "F"), "urgent": P.term("o_orderpriority", "1-URGENT")})


@query("SELECT count(*) AS everything, count(*) FILTER (WHERE event_type = 'error') AS matching FROM events")
def global_agg(spark, d):
    events = _t(spark, d, "events")
    return A.overall(events, {"matching": P.term("event_type", "error")})


@query("WITH f AS (SELECT source k, count(*) n FROM documents WHERE lang = 'de' GROUP BY 1), b AS (SELECT source k, count(*) n FROM documents GROUP BY 1), t AS (SELECT (SELECT count(*) FROM documents WHERE lang = 'de')::DOUBLE fn, (SELECT count(*) FROM documents)::DOUBLE bn) SELECT f.k AS key, f.n AS doc_count, round((f.n / fn - b.n / bn) * ((f.n / fn) / (b.n / bn)), 8) AS score FROM f JOIN b ON f.k = b.k, t WHERE f.n >= 3 AND f.n / fn > b.n / bn ORDER BY (f.n / fn - b.n / bn) * ((f.n / fn) / (b.n / bn)) DESC, 1 LIMIT 100")
def significant_terms(spark, d):
    docs = _t(spark, d, "documents")
    return A.significant_terms(docs, P.term("lang", "de"), "source", 100).select("key", "doc_count", _r("score", 8).alias("score"))


@query(f"WITH w AS (SELECT lang, unnest(list_distinct({TOKENS})) k FROM documents), f AS (SELECT k, count(*) n FROM w WHERE lang = 'fr' GROUP BY 1), b AS (SELECT k, count(*) n FROM w GROUP BY 1), t AS (SELECT (SELECT count(*) FROM documents WHERE lang = 'fr')::DOUBLE fn, (SELECT count(*) FROM documents)::DOUBLE bn) SELECT f.k AS key, f.n AS doc_count, round((f.n / fn - b.n / bn) * ((f.n / fn) / (b.n / bn)), 8) AS score FROM f JOIN b ON f.k = b.k, t WHERE f.n >= 3 AND f.n / fn > b.n / bn ORDER BY (f.n / fn - b.n / bn) * ((f.n / fn) / (b.n / bn)) DESC, 1 LIMIT 20")
def significant_text(spark, d):
    docs = _t(spark, d, "documents")
    return A.significant_text(docs, P.term("lang", "fr"), "text", 20).select("key", "doc_count", _r("score", 8).alias("score"))


def _nested_orders(spark, d) -> DataFrame:
    items = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("items"))
    return _t(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "items")


@query("SELECT l_returnflag AS key, count(*) AS doc_count, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def nested_agg(spark, d):
    return A.terms(A.nested(_nested_orders(spark, d), "items"), "l_returnflag", 100, {"quantity": _r(A.sum_("l_quantity"), 2)})


@query("SELECT l_returnflag, count(DISTINCT o_orderkey) AS doc_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def reverse_nested_agg(spark, d):
    return A.reverse_nested(A.nested(_nested_orders(spark, d), "items"), "o_orderkey", ["l_returnflag"])


@query("SELECT o_orderstatus AS key, count(*) AS doc_count FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) GROUP BY 1")
def sampler_agg(spark, d):
    return A.terms(A.sampler(_t(spark, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 200), "o_orderstatus", 100)


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def diversified_sampler(spark, d):
    return A.diversified_sampler(_t(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 2).select("o_orderkey")


# ---- geo -----------------------------------------------------------------------

_LAT, _LON = "(c_custkey % 1400) / 10.0 - 70", "(c_custkey * 7 % 3600) / 10.0 - 180"


def _places(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", F.expr(f"cast({_LAT} as double)").alias("lat"), F.expr(f"cast({_LON} as double)").alias("lon"))


_DIST = f"(2 * {geo.EARTH_RADIUS_M} * asin(sqrt(pow(sin((radians(lat) - radians(48.0)) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin(radians(lon - 11.0) / 2), 2))))"
_PLACES = f"(SELECT c_custkey, ({_LAT})::DOUBLE lat, ({_LON})::DOUBLE lon FROM customer)"


@query(f"SELECT key, count(*) AS doc_count FROM (SELECT unnest([CASE WHEN {_DIST} < 2000000 THEN 'near' END, CASE WHEN {_DIST} >= 2000000 AND {_DIST} < 8000000 THEN 'far' END]) AS key FROM {_PLACES}) WHERE key IS NOT NULL GROUP BY 1")
def geo_distance(spark, d):
    return A.geo_distance(_places(spark, d), "lat", "lon", (48.0, 11.0), [{"to": 2_000_000, "key": "near"}, {"from": 2_000_000, "to": 8_000_000, "key": "far"}])


@query(f"SELECT concat('5/', CAST(floor((lon + 180) / 360 * 32) AS BIGINT), '/', CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / 12.566370614359172) * 32) AS BIGINT)) AS key, count(*) AS doc_count FROM {_PLACES} GROUP BY 1")
def geotile_grid(spark, d):
    return A.geotile_grid(_places(spark, d), "lat", "lon", 5)


@query(
    f"SELECT concat(substr('{geo.GEOHASH_ALPHABET}', CAST(((x >> 4) & 1) * 16 + ((y >> 4) & 1) * 8 + ((x >> 3) & 1) * 4 + ((y >> 3) & 1) * 2 + ((x >> 2) & 1) + 1 AS BIGINT), 1), substr('{geo.GEOHASH_ALPHABET}', CAST(((y >> 2) & 1) * 16 + ((x >> 1) & 1) * 8 + ((y >> 1) & 1) * 4 + (x & 1) * 2 + (y & 1) + 1 AS BIGINT), 1)) AS key, count(*) AS doc_count "
    f"FROM (SELECT CAST(floor((lon + 180) / 360 * 32) AS BIGINT) x, CAST(floor((lat + 90) / 180 * 32) AS BIGINT) y FROM {_PLACES}) GROUP BY 1"
)
def geohash_grid(spark, d):
    return A.geohash_grid(_places(spark, d), "lat", "lon", 2)


# ---- over buckets ----------------------------------------------------------------

_DAYS = "(SELECT date_trunc('day', ts)::TIMESTAMP AS key, count(*) AS doc_count, round(sum(value), 4) AS total FROM events GROUP BY 1)"


def _days(spark, d) -> DataFrame:
    return A.date_histogram(_t(spark, d, "events"), "ts", "day", {"total": _r(A.sum_("value"))})


@query(f"SELECT key, doc_count, CAST(sum(doc_count) OVER (ORDER BY key) AS BIGINT) AS running FROM {_DAYS}")
def cumulative_sum(spark, d):
    return A.cumulative_sum(_days(spark, d), "doc_count", "running").select("key", "doc_count", "running")


@query(f"SELECT key, doc_count - lag(doc_count) OVER (ORDER BY key) AS change FROM {_DAYS}")
def derivative(spark, d):
    return A.derivative(_days(spark, d), "doc_count", "change").select("key", "change")


@query(f"SELECT key, doc_count - lag(doc_count, 7) OVER (ORDER BY key) AS change FROM {_DAYS}")
def serial_diff(spark, d):
    return A.serial_diff(_days(spark, d), "doc_count", 7, "change").select("key", "change")


@query(f"SELECT key, round(avg(doc_count) OVER (ORDER BY key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS mean FROM {_DAYS}")
def moving_avg(spark, d):
    return A.moving_avg(_days(spark, d), "doc_count", 5).select("key", _r("moving_avg").alias("mean"))


@query()
def moving_avg_ewma(spark, d):
    return A.moving_avg(_days(spark, d), "doc_count", 5, "ewma").select("key", _r("moving_avg").alias("mean"))


@query("SELECT l_orderkey AS key, doc_count, CAST(sum(doc_count) OVER (ORDER BY l_orderkey) AS BIGINT) AS running, doc_count - lag(doc_count, 3) OVER (ORDER BY l_orderkey) AS change, round(avg(doc_count) OVER (ORDER BY l_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS mean FROM (SELECT l_orderkey, count(*) AS doc_count FROM lineitem GROUP BY 1)")
def running_unbounded(spark, d):
    """A bucket for every order: no task sees them all."""
    orders = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("doc_count"))
    found = A.cumulative_sum(orders, "doc_count", "running")
    found = A.serial_diff(found, "doc_count", 3, "change")
    return A.moving_avg(found, "doc_count", 7, out="mean").withColumn("mean", _r("mean"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def running_by_parent(spark, d):
    items = _t(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"))
    return A.cumulative_sum(items, "l_quantity", "running", parent=["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", _r("running", 2).alias("running"))


@query("SELECT 0 AS level, date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS doc_count, true AS median_ok, true AS users_ok FROM events GROUP BY ALL UNION ALL SELECT 1, date_trunc('day', ts)::TIMESTAMP, NULL, count(*), true, true FROM events GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, count(*), true, true FROM events")
def sketch_rollup(spark, d):
    """Medians and users of three levels from one reading, held against exact ones:
    the median's rank and the number of users lie within the stated errors."""
    events = _t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    what = rollups.Sketches({"value": "value"}, {"users": "user_id"})
    found = rollups.rollup(events, [["day", "event_type"], ["day"], []], what, (50,))
    levels = None
    for n, keys in enumerate((["day", "event_type"], ["day"], [])):
        own = found.filter(F.col("level") == n)
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(f"o.{k}") == F.col(f"e.{k}"))
        joined = events.withColumn("one", F.lit(1)).alias("e").join(own.withColumn("one", F.lit(1)).alias("o"), same & (F.col("e.one") == F.col("o.one")))
        below, upto = F.avg((F.col("value") < F.col("p50_value")).cast("int")), F.avg((F.col("value") <= F.col("p50_value")).cast("int"))
        exact = F.count_distinct("user_id")
        held = joined.groupBy("o.level", "o.day", "o.event_type", "o.doc_count", "o.n_users").agg(((below <= 0.5 + what.rank_error) & (upto >= 0.5 - what.rank_error)).alias("median_ok"), (F.abs(F.col("n_users") - exact) <= 4 * what.distinct_error * exact + 1).alias("users_ok"))
        levels = held if levels is None else levels.union(held)
    return levels.drop("n_users")


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) AS p{p}" for p in (1, 25, 50, 99)) + " FROM lineitem GROUP BY 1")
def percentiles_by_ranges(spark, d):
    """Exact percentiles by group, without a buffer of values."""
    found = A.exact_percentiles(_t(spark, d, "lineitem"), "l_extendedprice", (1, 25, 50, 99), ["l_returnflag"])
    return found.select("l_returnflag", *[_r(f"p{p}").alias(f"p{p}") for p in (1, 25, 50, 99)])


@query(f"SELECT key, doc_count FROM {_DAYS} ORDER BY doc_count DESC, key LIMIT 5")
def bucket_sort(spark, d):
    return A.bucket_sort(_days(spark, d), [F.desc("doc_count"), F.col("key")], 5).select("key", "doc_count")


@query(f"SELECT round(sum(total), 3) AS s, round(avg(total), 3) AS a FROM {_DAYS}")
def sum_avg_bucket(spark, d):
    return A.bucket_metric(_days(spark, d), "total", "stats").select(_r("sum", 3).alias("s"), _r("avg", 3).alias("a"))


@query(f"SELECT count(total) AS count, round(min(total), 3) AS min, round(max(total), 3) AS max, round(avg(total), 3) AS avg, round(sum(total), 3) AS sum FROM {_DAYS}")
def stats_bucket(spark, d):
    return A.bucket_metric(_days(spark, d), "total", "stats").select("count", *[_r(c, 3).alias(c) for c in ("min", "max", "avg", "sum")])


@query(f"SELECT key, round(sum(w * v) / sum(w), 4) AS m FROM (SELECT a.key, b.n - greatest(a.n - 3, 1) + 1 AS w, b.total AS v FROM (SELECT *, row_number() OVER (ORDER BY key) n FROM {_DAYS}) a JOIN (SELECT *, row_number() OVER (ORDER BY key) n FROM {_DAYS}) b ON b.n BETWEEN a.n - 3 AND a.n) GROUP BY key")
def moving_avg_linear(spark, d):
    return A.moving_avg(_days(spark, d), "total", 4, "linear").select("key", _r("moving_avg", 4).alias("m"))


@query(f"SELECT max(doc_count) AS value, arg_max(key, (doc_count, key)) AS key FROM {_DAYS}")
def max_bucket(spark, d):
    return A.bucket_metric(_days(spark, d), "doc_count", "max")


@query(f"SELECT min(doc_count) AS value, arg_min(key, (doc_count, key)) AS key FROM {_DAYS}")
def min_bucket(spark, d):
    return A.bucket_metric(_days(spark, d), "doc_count", "min")


@query(f"SELECT count(total) AS n, round(sum(total), 3) AS s, round(stddev_pop(total), 3) AS sd FROM {_DAYS}")
def extended_stats_bucket(spark, d):
    return A.bucket_metric(_days(spark, d), "total", "extended_stats").select(F.col("count").alias("n"), _r("sum", 3).alias("s"), _r("std_deviation", 3).alias("sd"))


# ---- record functions --------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:00'")
    made = F.to_json(F.struct("event_type", F.col("user_id").alias("user"), F.col("user_id").cast("string").alias("user_text"), (F.col("event_id") % 2 == 0).alias("even"), stamp.alias("at"), F.concat(F.lit("10.1."), (F.col("user_id") % 9).cast("string"), F.lit(".7")).alias("ip"), F.array(F.struct(F.col("event_type").alias("type"))).alias("list"), F.when(F.col("value") > 50, 1).alias("seen")))
    return _t(spark, d, "events").select("event_id", made.alias("doc"), "props")


def _record(name: str, condition: Callable[[Record], Column], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return where_record(_records(spark, d), "doc", condition).select("event_id")

    run.__name__ = name
    query(f"SELECT event_id FROM events WHERE {sql}")(run)


_record("record_exists", lambda r: r.exists("list.0.type") & ~r.exists("nothing") & r.exists("seen"), "value > 50")
_record("record_equals_number", lambda r: r.equals("user_text", 17) & r.equals("user", "17") & r.equals("user", 17.0), "user_id = 17")
_record("record_equals_text", lambda r: r.equals("list.0.type", "click") | r.equals("even", "true"), "event_type = 'click' OR event_id % 2 = 0")
_record("record_equals_ignore_case", lambda r: r.equals_ignore_case("event_type", "ERROR"), "event_type = 'error'")
_record("record_one_of", lambda r: r.one_of("user", ["3", 4, "x"]), "user_id IN (3, 4)")
_record("record_contains", lambda r: r.contains("event_type", [" ick ", "chase"]), "event_type IN ('click', 'purchase')")
_record("record_contains_all", lambda r: r.contains_all("event_type", ["e", "r"]), "contains(event_type, 'e') AND contains(event_type, 'r')")
_record("record_starts_ends", lambda r: r.starts_with("event_type", ["c", "p"]) & r.ends_with("event_type", "se"), "event_type = 'purchase'")
_record("record_in_cidr", lambda r: r.in_cidr("ip", "10.1.4.0/22"), "user_id % 9 BETWEEN 4 AND 7")
_record("record_regex", lambda r: r.regex_match("event_type", "^(s|v)") & ~r.regex_match("event_type", "("), "event_type IN ('signup', 'view')")
_record("record_compare", lambda r: r.less_than("user_text", 50) & r.greater_or_equal("user", "20") & ~r.greater_than("event_type", 1), "user_id < 50 AND user_id >= 20")
_record("record_hour", lambda r: r.is_hour("at", 3) | r.is_minute("at", 30), "hour(ts) = 3 OR minute(ts) = 30")
_record("record_day", lambda r: r.is_day_of_week("at", 1) | r.is_weekend("at"), "dayofweek(ts) IN (0, 1, 6)")
_record("record_work_day", lambda r: r.is_work_day("at") & r.is_between_time("at", "22:00", "06:00"), "dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) >= 22 OR hour(ts) < 6 OR (hour(ts) = 6 AND minute(ts) = 0))")


@query("SELECT event_id, user_id::DOUBLE AS n, event_type AS t, (event_id % 2 = 0) AS b, 7.0::DOUBLE AS missing, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def record_safe(spark, d):
    r, p = Record("doc"), Record("props")
    return _records(spark, d).select("event_id", r.safe("user_text", 0).alias("n"), r.safe("event_type", "").alias("t"), r.safe("even", False).alias("b"), r.safe("no.such", 7).alias("missing"), p.safe("k", -1).alias("k"))


@register("between_numbers")
def _between_numbers(record: Record, path: str, low: float, high: float) -> Column:
    return F.coalesce(record.number(path).between(low, high), F.lit(False))


_record("record_custom", lambda r: r.between_numbers("user_text", 100, 300) & r.exists("list.0.type"), "user_id BETWEEN 100 AND 300")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 80 WHEN event_id % 3 = 1 THEN user_id ELSE 80 END AS port, event_id % 3 <> 2 AS was_set, CAST(user_id AS VARCHAR) AS hostname FROM events")
def set_attributes(spark, d):
    """A number written as text is read, other text leaves the old value."""
    events = _t(spark, d, "events").select("event_id", F.lit(80).cast("long").alias("port"), "user_id")
    text_ = F.when(F.col("event_id") % 3 == 0, "80").when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise("none")
    found = semantics.set_attribute(events, "port", text_, "was_set")
    return semantics.set_attribute(found, "hostname", F.col("user_id")).drop("user_id")


# ---- rules -----------------------------------------------------------------------

_AFTER = "SELECT e.event_id FROM events e JOIN events h ON h.user_id = e.user_id AND h.event_type = 'click' AND h.ts <= e.ts AND h.ts >= e.ts - INTERVAL {w} WHERE e.event_type = 'error' GROUP BY 1 HAVING count(*) >= {n}"


def _rule(**look) -> R.Rule:
    return R.Rule("clicks", P.term("event_type", "error"), (R.Lookback({"user_id": "user_id"}, where=P.term("event_type", "click"), **look),), {"confidentiality": 3, "integrity": 1, "availability": 2})


@query(_AFTER.format(w="6 HOURS", n=2))
def correlate(spark, d):
    return R.evaluate(_rule(within="6h", count=2), _t(spark, d, "events")).select("event_id")


@query(f"{_AFTER.format(w='2 HOURS', n=2)} UNION SELECT DISTINCT e.event_id FROM events e JOIN events h ON h.user_id = e.user_id AND h.event_type = 'purchase' AND h.ts <= e.ts AND h.ts >= e.ts - INTERVAL 1 HOUR WHERE e.event_type = 'error'")
def correlate_or(spark, d):
    other = R.Lookback({"user_id": "user_id"}, "1h", 1, P.term("event_type", "purchase"))
    return R.evaluate(_rule(within="2h", count=2, either=(other,)), _t(spark, d, "events")).select("event_id")


@query("SELECT e.event_id FROM events e JOIN events h ON h.user_id = e.user_id AND h.event_type = 'click' AND h.value <= 50 AND h.ts <= e.ts AND h.ts >= e.ts - INTERVAL 1 DAY WHERE e.event_type = 'error' GROUP BY 1")
def correlate_not(spark, d):
    return R.evaluate(_rule(within="24h", must_not=(P.between("value", gt=50),)), _t(spark, d, "events")).select("event_id")


_HOT = "CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END"


@query(f"WITH v AS (SELECT *, {_HOT} AS src FROM events) SELECT e.event_id FROM v e JOIN v h ON h.src = e.src AND h.event_type = 'click' AND h.ts <= e.ts AND h.ts >= e.ts - INTERVAL 6 HOUR WHERE e.event_type = 'error' GROUP BY 1 HAVING count(*) >= 5")
def correlate_hot(spark, d):
    """One source has half of all events."""
    events = _t(spark, d, "events").withColumn("src", F.expr(_HOT))
    rule = R.Rule("hot", P.term("event_type", "error"), (R.Lookback({"src": "src"}, "6h", 5, P.term("event_type", "click")),))
    return R.evaluate(rule, events).select("event_id")


@query("SELECT e.event_id FROM events e JOIN events h ON h.event_type = 'click' AND h.user_id <> e.user_id AND h.ts <= e.ts AND h.ts >= e.ts - INTERVAL 20 MINUTE WHERE e.event_type = 'error' GROUP BY 1 HAVING count(*) >= 3")
def correlate_unlike(spark, d):
    """No column agrees, and one must not."""
    rule = R.Rule("others", P.term("event_type", "error"), (R.Lookback({}, "20m", 3, P.term("event_type", "click"), unlike={"user_id": "user_id"}),))
    return R.evaluate(rule, _t(spark, d, "events")).select("event_id")


_WORDS = "event_type || ' ' || CAST(user_id % 50 AS VARCHAR)"


@query(f"WITH v AS (SELECT *, {_WORDS} AS said FROM events) SELECT e.event_id FROM v e JOIN v h ON h.user_id = e.user_id AND list_has_any(string_split(h.said, ' '), string_split(e.said, ' ')) AND h.value > 50 AND h.ts <= e.ts AND h.ts >= e.ts - INTERVAL 24 HOUR WHERE e.event_type = 'error' GROUP BY 1 HAVING count(*) >= 2")
def correlate_words(spark, d):
    """History shares a word with the trigger."""
    events = _t(spark, d, "events").withColumn("said", F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string")))
    rule = R.Rule("words", P.term("event_type", "error"), (R.Lookback({"user_id": "user_id"}, "24h", 2, P.between("value", gt=50), matching={"said": "said"}),))
    return R.evaluate(rule, events).select("event_id")


@query(
    "WITH r AS (SELECT i, 1 + i % 5 AS n, 1 + i % 8 AS hours, (i // 2)::DOUBLE AS least FROM range(200) x(i)), e AS (SELECT * FROM events WHERE event_type = 'error'), h AS (SELECT * FROM events WHERE event_type = 'click') "
    "SELECT e.event_id, 'rule-' || CAST(r.i AS VARCHAR) AS rule FROM e JOIN r ON e.value >= r.least JOIN h ON h.user_id = e.user_id AND h.ts <= e.ts AND h.ts >= e.ts - to_hours(CAST(r.hours AS INT)) GROUP BY e.event_id, r.i, r.n HAVING count(*) >= r.n"
)
def correlate_many(spark, d):
    """200 rules over one reading of the events."""
    rules = []
    for i in range(200):
        look = R.Lookback({"user_id": "user_id"}, f"{1 + i % 8}h", 1 + i % 5, P.term("event_type", "click"))
        rules.append(R.Rule(f"rule-{i}", P.term("event_type", "error") & P.between("value", gte=float(i // 2)), (look,)))
    return R.evaluate_all(rules, _t(spark, d, "events")).select("event_id", "rule")


@query("WITH a AS (SELECT event_id, user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 3 DAYS, true) g FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(g::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM a), f AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) p FROM r) SELECT event_id, CASE WHEN p <> event_id THEN p END AS parent_id FROM f")
def fold_alerts(spark, d):
    alerts = _t(spark, d, "events").filter(P.term("event_type", "error"))
    return R.fold_alerts(alerts, ["user_id"], "72h").select("event_id", "parent_id")


# ---- parsing -----------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, length(url) AS n FROM pages WHERE NOT contains(url, '/1')")
def parse_steps(spark, d):
    steps = [
        parsing.grok("url", [("scheme", "[a-z]+"), ("sep", "://"), ("host", "{{host}}")], {"host": "[^/?#]+"}),
        parsing.drop(P.wildcard("url", "*/1*")),
        parsing.add("n", F.length("url")),
        parsing.delete(["sep", "html"]),
        parsing.rename("address", ["url"]),
    ]
    return parsing.parse(_t(spark, d, "pages"), steps).select("page_id", "scheme", "host", F.col("n").cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '!' AS t FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events WHERE event_id % 3 <> 0")
def parse_json_where(spark, d):
    steps = [
        parsing.json("props", "doc"),
        parsing.add("k", F.try_variant_get("doc", "$.k", "string")),
        parsing.cast(["k"], "int"),
        parsing.add("t", F.col("event_type")),
        parsing.add("t", F.concat("event_type", F.lit("!")), where=F.col("event_id") % 3 == 0),
    ]
    return parsing.parse(_t(spark, d, "events"), steps).select("event_id", "k", "t")


@query("SELECT event_id, rule, CASE rule WHEN 'large' THEN 4.5::DOUBLE ELSE 2.5::DOUBLE END AS impact_score FROM (SELECT event_id, unnest([CASE WHEN value > 90 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'errors' END]) AS rule FROM events) WHERE rule IS NOT NULL")
def disabled_rules(spark, d):
    rules = [R.Rule("large", P.between("value", gt=90), severity={"confidentiality": 4, "integrity": 3, "availability": 5}), R.Rule("errors", P.term("event_type", "error"), severity={"confidentiality": 3, "integrity": 1, "availability": 2}), R.Rule("off", P.match_all())]
    return R.evaluate_all(rules, _t(spark, d, "events"), disabled=["off"]).select("event_id", "rule", F.round("impact_score", 6).alias("impact_score"))


@query("SELECT event_id, event_type AS a, CAST(user_id AS VARCHAR) AS b, strftime(ts, '%d.%m.%Y') AS day, 'v' || CAST(user_id AS VARCHAR) AS y FROM events")
def parse_csv_kv(spark, d):
    made = _t(spark, d, "events").select("event_id", F.concat_ws(";", "event_type", F.col("user_id").cast("string")).alias("line"), F.concat(F.lit("x=1&y=v"), F.col("user_id").cast("string")).alias("pairs"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("day"))
    steps = [parsing.csv("line", ["a", "b"], ";"), parsing.kv("pairs", "m", "&", "="), parsing.add("y", F.col("m")["y"]), parsing.reformat(["day"], "yyyy-MM-dd HH:mm", "dd.MM.yyyy"), parsing.trim(["a"], "space")]
    return parsing.parse(made, steps).select("event_id", "a", "b", "day", "y")


@query("SELECT page_id, 'n' || CAST(page_id % 7 AS VARCHAR) AS name, CAST(page_id AS BIGINT) AS n, v AS part FROM pages, unnest([1, 2, CAST(page_id % 5 AS INT)]) u(v)")
def parse_xml_expand(spark, d):
    made = _t(spark, d, "pages").select("page_id", F.format_string("<r><name>n%d</name><n>%d</n><p>1</p><p>2</p><p>%d</p></r>", F.col("page_id") % 7, "page_id", F.col("page_id") % 5).alias("raw"))
    steps = [parsing.xml("raw", "x", "name string, n long, p array<int>"), parsing.dynamic(lambda df: df.select("page_id", "x.name", "x.n", "x.p")), parsing.expand("p", "part")]
    return parsing.parse(made, steps).select("page_id", "name", "n", "part")


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def parse_engine_patterns(spark, d):
    """Patterns that only the engine knows, with groups of their own."""
    steps = [parsing.grok("url", [("scheme", r"(\p{Ll})+"), ("sep", "(:)(//)"), ("host", r"[^/?#]++")])]
    return parsing.parse(_t(spark, d, "pages"), steps).select("page_id", "scheme", "host")


# ---- stored tables -------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 5 <> 2")
def keyed_table(spark, d):
    """Three batches on a stored table, the second tried twice."""
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    table = KeyedTable(spark, f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}", orders.schema, "o_orderkey", 16)
    item = lambda action, df: df.withColumns({"action": F.lit(action), "seq": F.lit(0).cast("long")})
    table.apply(item("index", orders), 0)
    changes = item("update", orders.filter("o_orderkey % 5 = 1").withColumns({"status": F.lit("X"), "price": F.lit(None).cast("double")}))
    for _ in range(2):
        table.apply(changes, 1)
    table.apply(item("delete", orders.filter("o_orderkey % 5 = 2")), 2)
    return table.rows()


# ---- scalars -----------------------------------------------------------------------


@query("SELECT doc_id, coalesce(CASE WHEN regexp_full_match(source[4:], '[+-]?[0-9]+') THEN TRY_CAST(source[4:] AS BIGINT) END, 0) AS n, 0::BIGINT AS bad, source IN ('1', 'true') AS b, regexp_replace(source || '_x.y-', '[^a-zA-Z0-9.]', '', 'g') AS f FROM documents")
def casts_total(spark, d):
    return _t(spark, d, "documents").select("doc_id", casts.cast_int64(F.substring("source", 4, 10)).alias("n"), casts.cast_int64(F.col("lang")).alias("bad"), casts.cast_bool(F.col("source")).alias("b"), casts.sanitize_field(F.concat("source", F.lit("_x.y-"))).alias("f"))


_NAMES = "concat(regexp_extract(url, '://([^/?#:]+)', 1), substr('xxxxxxxxxxxxxxxxxxxxxxxx', 1, CAST(page_id % 24 AS INT)))"


@query(f"SELECT page_id, CASE WHEN regexp_full_match(lower({_NAMES}), '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,20}}') THEN lower({_NAMES}) END AS host, regexp_full_match(md5(url), '[0-9a-f]{{32}}') AS is_md5 FROM pages")
def validate_columns(spark, d):
    pages = _t(spark, d, "pages")
    return pages.select("page_id", entities.fqdn(F.expr(_NAMES)).alias("host"), entities.digest("md5")(F.md5(F.col("url").cast("binary"))).isNotNull().alias("is_md5"))


@query()
def validate_fingerprint(spark, d):
    return _t(spark, d, "pages").select("page_id", entities.validate(F.col("url"), "url").alias("v")).select("page_id", "v.value", "v.hash", "v.error")


@query(f"SELECT doc_id, len({TOKENS}) AS n FROM documents")
def token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


_PHONES = "concat('+', CAST(c_custkey % 3 AS {s}), '5', CASE WHEN c_custkey % 5 = 0 THEN '.' WHEN c_custkey % 5 = 1 THEN ' (20) ' ELSE ' ' END, CAST(100 + c_custkey % 900 AS {s}), CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '' END, '45')"
_MIMES = "concat('Text/', substr('plainxml', 1, CAST(1 + c_custkey % 8 AS INT)), CASE WHEN c_custkey % 11 = 0 THEN '+x' WHEN c_custkey % 11 = 1 THEN '.' ELSE '' END)"


# which values are valid is said here by how they are made, not by the patterns
@query(
    f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN {_PHONES.format(s='VARCHAR')} END AS phone, "
    f"CASE WHEN c_custkey % 11 = 0 OR (c_custkey % 11 > 1 AND c_custkey % 8 >= 2) THEN lower({_MIMES}) END AS mime, "
    "substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 21, 12) AS uuid, "
    "CASE WHEN c_custkey % 4 = 0 THEN '/a/' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 4 = 1 THEN 'http://host/A?b' END AS url FROM customer"
)
def validate_forms(spark, d):
    figures = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    plain = entities.uuid(figures)
    forms = F.when(F.col("c_custkey") % 4 == 0, figures).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("URN:uuid:"), plain)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("{"), F.upper(plain), F.lit("}"))).otherwise(plain)
    urls = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("/a/"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 4 == 1, F.lit("HTTP://Host/A?b")).when(F.col("c_custkey") % 4 == 2, F.lit("no scheme")).otherwise(F.lit(""))
    made = _t(spark, d, "customer").select("c_custkey", F.expr(_PHONES.format(s="STRING")).alias("p"), F.expr(_MIMES).alias("m"), forms.alias("i"), urls.alias("u"))
    return made.select("c_custkey", entities.phone(F.col("p")).alias("phone"), entities.mime(F.col("m")).alias("mime"), entities.uuid(F.col("i")).alias("uuid"), entities.url(F.col("u")).alias("url"))


# ---- writes and tables ---------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 10000000, 'ADDED' FROM customer WHERE c_custkey <= 5")
def keyed_writes(spark, d):
    current = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changed = current.filter("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NEW"))
    added = current.filter("c_custkey <= 5").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment"))
    kept = tables.delete(tables.upsert(current, changed, "c_custkey"), current.filter("c_custkey % 7 = 0"), "c_custkey")
    return tables.create(kept, added, "c_custkey")[0]


_BATCH = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'ONCE' WHEN c_custkey % 5 = 1 THEN 'LAST' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 5 <> 2"


@query(_BATCH)
def mixed_batch(spark, d):
    """Updates, refused creates, an index after a delete, and deletes."""
    current = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    item = lambda rest, action, seq, segment, nation: current.filter(f"c_custkey % 5 = {rest}").select("c_custkey", F.lit(segment).cast("string").alias("c_mktsegment"), nation.alias("c_nationkey"), F.lit(action).alias("action"), F.lit(seq).alias("seq"))
    own, null = F.col("c_nationkey"), F.lit(None).cast("long")
    parts = [item(0, "update", 1, "ONCE", null), item(1, "delete", 1, None, null), item(1, "index", 2, "FIRST", own), item(1, "update", 3, "LAST", null), item(2, "delete", 4, None, null), item(3, "create", 5, "NO", own)]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    return tables.bulk(current, items, "c_custkey")[0]


@query("SELECT r_name AS name, 'region' AS _index FROM region UNION ALL SELECT n_name, 'nation' FROM nation")
def multi_table(spark, d):
    found = {"region": _t(spark, d, "region").select(F.col("r_name").alias("name")), "nation": _t(spark, d, "nation").select(F.col("n_name").alias("name"))}
    return tables.read_tables(found, ["reg*", "nation"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def update_by_query(spark, d):
    return tables.update_by_query(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), P.term("o_orderstatus", "F"), {"o_totalprice": F.lit(0.0)}).drop("o_orderstatus")


# ---- SQL -----------------------------------------------------------------------------


def _sql(name: str, used: tuple[str, ...], statement: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in used:
            _t(spark, d, t).createOrReplaceTempView(t)
        return tables.sql_rows(spark, statement)

    run.__name__ = name
    query(statement)(run)


_sql("sql_join", ("customer", "orders", "nation"), "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("sql_window", ("orders",), "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n FROM orders")
_sql("sql_rollup", ("lineitem",), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_setops", ("customer", "supplier"), "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier UNION ALL SELECT s_nationkey FROM supplier WHERE s_suppkey < 5")
_sql("sql_semi_anti", ("customer", "orders"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
