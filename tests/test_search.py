"""Hit counts of small tables of documents."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.operators import aggregations as A
from sievelake.operators import predicates as P
from sievelake.operators.search import Search, visible


# Small tables of documents and the hits that searches must give on them.


@pytest.fixture(scope="module")
def indicators(spark):
    rows = [("1", "ip", "active", 8, "threat", ["public"]), ("2", "domain", "active", 5, "indicator", ["public"]), ("3", "ip", "inactive", 3, "indicator", ["public"]), ("4", "url", "active", 9, "threat", ["private"]), ("5", "domain", "active", 2, "benign", ["public"])]
    return spark.createDataFrame(rows, "_id string, type string, status string, severity int, category string, visibleBy array<string>").cache()


def found(search):
    return {int(r["_id"]) for r in search.matches().collect()}


def test_boolean_logic(indicators):
    s = Search(indicators)
    active = P.term("status", "active")
    assert found(s.filter(active)) == {1, 2, 4, 5}
    assert found(s.should(P.term("type", "ip"), P.term("type", "domain")).minimum_should_match(1)) == {1, 2, 3, 5}
    assert found(s.filter(active, P.any_of(P.term("type", "ip"), P.term("type", "domain")))) == {1, 2, 5}
    deep = P.any_of(P.all_of(P.term("category", "threat"), P.between("severity", gte=5)), P.all_of(P.term("category", "indicator"), P.term("type", "ip")))
    assert len(found(s.must(deep))) == 3
    assert len(found(s.filter(active).must_not(P.term("type", "url")))) == 3
    assert len(found(s.filter(active).visible_to(["public"]))) == 3
    assert len(found(s.must(P.terms("category", ["threat", "benign"])))) == 3
    assert len(found(s.must(P.wildcard("type", "dom*")))) == 2
    assert len(found(s.filter(P.exists("severity")))) == 5
    assert len(found(s.must(P.prefix("type", "dom")))) == 2
    assert len(found(s.must(P.range_("severity", "gt", 5)))) == 2
    assert len(found(s.filter(P.ids(["1", "3", "5"])))) == 3
    assert len(found(s.must_not(P.ids(["1", "2"])))) == 3
    assert len(found(s.where("status = 'active' AND category = 'threat'"))) == 2
    assert len(found(s.must(P.regexp("type", "(ip|url)")))) == 3


def test_missing_values_are_not_matches(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "_id string, x string")
    assert found(Search(df).must_not(P.term("x", "a"))) == {2}
    assert found(Search(df).should(P.term("x", "a"), P.none_of(P.exists("x"))).minimum_should_match(1)) == {1, 2}


@settings(max_examples=40, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "c"]), lambda t: st.tuples(st.sampled_from(["all", "any", "none"]), st.lists(t, min_size=1, max_size=3)), max_leaves=6))
def test_random_trees(spark, tree):
    values = [None, True, False]
    rows = [(str(9 * i + 3 * j + k), a, b, c) for i, a in enumerate(values) for j, b in enumerate(values) for k, c in enumerate(values)]

    def column(t):
        return F.col(t) if isinstance(t, str) else {"all": P.all_of, "any": P.any_of, "none": P.none_of}[t[0]](*map(column, t[1]))

    def plain(t, row):
        if isinstance(t, str):
            return bool(row[t])
        parts = [plain(x, row) for x in t[1]]
        return {"all": all(parts), "any": any(parts), "none": not any(parts)}[t[0]]

    df = spark.createDataFrame(rows, "_id string, a boolean, b boolean, c boolean")
    want = {int(i) for i, a, b, c in rows if plain(tree, {"a": a, "b": b, "c": c})}
    assert found(Search(df).filter(column(tree))) == want


def test_addresses(spark):
    rows = [("1", "192.168.1.10", "8.8.8.8"), ("2", "192.168.1.20", "1.1.1.1"), ("3", "10.0.0.5", "192.168.1.10"), ("4", "172.16.0.100", "8.8.4.4"), ("5", "203.0.113.50", "127.0.0.1"), ("6", "2001:db8::1", None), ("7", "no", "1.2.3.999")]
    s = Search(spark.createDataFrame(rows, "_id string, s string, d string"))
    private = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]
    assert found(s.must(P.cidr("s", "192.168.0.0/16"))) == {1, 2}
    assert found(s.must(P.cidr("s", "10.0.0.0/8"))) == {3}
    assert found(s.must(P.cidrs("s", private))) == {1, 2, 3, 4}
    assert found(s.must_not(P.cidr("d", "127.0.0.0/8"))) == {1, 2, 3, 4, 6, 7}
    assert found(s.must(P.cidrs("s", private), P.cidr("d", "8.0.0.0/8"))) == {1, 4}
    assert found(s.should(P.cidr("s", "192.168.0.0/16"), P.cidr("d", "192.168.0.0/16"))) == {1, 2, 3}
    assert found(s.must(P.cidr("s", "2001:db8::/32"))) == {6}
    out = A.ip_range(s.source, "s", [{"mask": n} for n in private]).collect()
    assert {r["key"]: r["doc_count"] for r in out} == {"10.0.0.0/8": 1, "172.16.0.0/12": 1, "192.168.0.0/16": 2}


def test_stored_ranges(spark):
    rows = [("1", "192.168.0.0", "192.168.255.255"), ("2", "10.0.0.0", "10.0.0.255"), ("3", "172.16.0.0", "172.31.255.255"), ("4", "10.10.0.0", "10.10.255.255"), ("5", "192.168.50.0", "192.168.50.255")]
    s = Search(spark.createDataFrame(rows, "_id string, low string, high string"))
    assert found(s.must(P.ip_range_contains("low", "high", "192.168.1.50"))) == {1}
    assert found(s.must(P.ip_range_contains("low", "high", "10.0.0.100"))) == {2}
    assert found(s.must(P.ip_range_intersects("low", "high", "10.0.0.0", "10.255.255.255"))) == {2, 4}
    assert found(s.must(P.ip_range_within("low", "high", "192.168.0.0", "192.168.255.255"))) == {1, 5}
    assert found(s.must(P.ip_range_intersects("low", "high", "192.168.49.0", "192.168.51.255"))) == {1, 5}


def test_vectors(spark):
    rows = [("1", [1.0, 0.0, 0.0], "electronics", ["public"]), ("2", [0.0, 1.0, 0.0], "electronics", ["public"]), ("3", [0.0, 0.0, 1.0], "clothing", ["public"]), ("4", [0.9, 0.1, 0.0], "electronics", ["public"]), ("5", [0.1, 0.9, 0.0], "clothing", ["private"])]
    s = Search(spark.createDataFrame(rows, "_id string, embedding array<float>, category string, visibleBy array<string>"))
    hits = s.knn("embedding", [1, 0, 0], 3).hits().collect()
    assert [r["_id"] for r in hits] == ["1", "4", "5"] and hits[0]["_score"] == 1.0
    assert {r["category"] for r in s.knn("embedding", [0, 1, 0], 3, filter=P.term("category", "electronics")).hits().collect()} == {"electronics"}
    assert found(s.visible_to(["public"]).knn("embedding", [0.1, 0.9, 0], 5)) == {1, 2, 3, 4}


@pytest.mark.parametrize("groups, n", [(["public"], 2), (["admin"], 2), (["public", "admin"], 3), (["private"], 1), (["public", "private"], 3), (["nonexistent"], 0), (["public", "nonexistent"], 2), ([], 0)])
def test_visibility(spark, groups, n):
    rows = [("1", ["public"]), ("2", ["admin"]), ("3", ["public", "admin"]), ("4", ["private"]), ("5", ["guest"])]
    assert visible(spark.createDataFrame(rows, "_id string, visibleBy array<string>"), groups).count() == n


def test_sales(spark):
    rows = [("electronics", "acme", 100, "2024-01-15"), ("electronics", "acme", 200, "2024-01-16"), ("electronics", "beta", 150, "2024-02-01"), ("clothing", "acme", 50, "2024-02-15"), ("clothing", "gamma", 75, "2024-03-01")]
    sales = spark.createDataFrame(rows, "category string, brand string, price int, day string").withColumn("day", F.col("day").cast("timestamp_ntz"))
    one = sales.agg(*[c.alias(n) for n, c in A.extended_stats("price").items()]).first()
    assert (one["sum"], one["avg"], one["min"], one["max"], one["sum_of_squares"], one["variance"]) == (575, 115, 50, 200, 80625, 2900)
    assert abs(one["upper"] - 222.703296) < 1e-5
    assert sales.agg(A.cardinality("brand", exact=True)).first()[0] == 3
    assert [(r["key"], r["doc_count"]) for r in A.terms(sales, "category").collect()] == [("electronics", 3), ("clothing", 2)]
    assert {r["key"]: r["doc_count"] for r in A.histogram(sales, "price", 50).collect()} == {50: 2, 100: 1, 150: 1, 200: 1}
    ranges = A.range_buckets(sales, "price", [{"to": 100}, {"from": 100, "to": 200}, {"from": 200}]).collect()
    assert sorted(r["doc_count"] for r in ranges) == [1, 2, 2]
    months = A.derivative(A.cumulative_sum(A.date_histogram(sales, "day", "month"), "doc_count"), "doc_count").orderBy("key").collect()
    assert [(r["doc_count"], r["cumulative_sum"], r["derivative"]) for r in months] == [(2, 2, None), (2, 4, 0), (1, 5, -1)]


def test_paging(spark):
    s = Search(spark.createDataFrame([(str(i), i % 3 if i else None) for i in range(9)], "_id string, x int")).sort("x", "desc").size(4)
    first = [(r["x"], r["_id"]) for r in s.hits().collect()]
    assert first == [(2, "2"), (2, "5"), (2, "8"), (1, "1")]
    assert [r["_id"] for r in s.search_after(1, "1").hits().collect()] == ["4", "7", "3", "6"]
    assert [r["_id"] for r in s.search_after(0, "3").hits().collect()] == ["6", "0"]
    assert s.total() == 9
