import zlib

from pyspark.sql import functions as F

from sievelake.llm import sharding


def check(out, n, shards):
    rows = out.collect()
    assert len(rows) == n
    by = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    order = [r["doc_id"] if r["doc_id"] is not None else -1 for s in sorted(by) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert order == sorted(order)
    return {s: sum(r["size"] for r in part) for s, part in by.items()}


def test_shards_are_near_equal(spark):
    docs = spark.range(5000).selectExpr("id * 3 as doc_id", "repeat('é', cast(id % 97 as int)) as text")
    sizes = check(sharding.histogram_shards(docs, shards=7), 5000, 7)
    mean = sum(sizes.values()) / 7
    assert all(abs(s - mean) < 0.01 * mean + 400 for s in sizes.values()) and len(sizes) == 7


def test_one_key_may_hold_most_rows(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id, 5) as doc_id", "'same text' as text")
    sizes = check(sharding.histogram_shards(docs, shards=5), 3000, 5)
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values())


def test_cells_follow_the_bytes(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id % 90 as int)) as text")
    keyed = docs.selectExpr("struct(doc_id as a, 0L as b, 0L as c) as key", "cast(length(text) + 8 as long) as size").cache()
    for most in (4_000, 20_000):
        cuts, starts, below = sharding.find_cuts(keyed, 3, 16, 0.01, 4, most)
        edges = [s[0] for s in starts] + [20_000]
        sizes = [sum(i % 90 + 8 for i in range(a, b)) for a, b in zip(edges, edges[1:])]
        assert max(sizes) <= 2 * most + 100 and len(starts) <= 8 * 1_050_000 / most
        assert below == [s[0] for s in starts] and set(cuts) <= set(starts)
    check(sharding.histogram_shards(docs, shards=3, cell_bytes=5_000), 20_000, 3)


def test_repeated_rows_over_a_shuffled_input(spark):
    """Repeated rows are numbered once, though each reading of the input deals them
    out anew."""
    rows = [(i % 40, f"text {i % 40}", "abc"[i % 3]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for shuffled in (docs, docs.repartition(5, F.rand()), docs.orderBy(F.rand())):
        out = sharding.histogram_shards(shuffled, shards=4)
        check(out, 2000, 4)
        again = sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in out.collect())
        assert again == sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in out.collect())


def test_odd_rows(documents, clashing, empty, rows):
    check(sharding.histogram_shards(documents, shards=24), len(rows), 24)
    check(sharding.histogram_shards(clashing, shards=3), len(rows), 3)
    assert sharding.histogram_shards(empty).count() == 0


def test_query(spark, sf):
    got = sharding.op3_histogram_shards(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got) and len(got) == len(texts)
