"""The inverted file against exact search."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators import ivf, knn
from sievelake.operators.search import Search

DIM = 16


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, DIM)) * 3
    rows = [(i, [float(v) for v in middles[rng.integers(40)] + rng.normal(size=DIM)], i % 50, f"n{i}") for i in range(4000)]
    rows += [(5000, None, 0, "null"), (5001, [1.0], 0, "short"), (5002, [float("nan")] * DIM, 0, "nan"), (5003, [None] * DIM, 0, "nulls"), (5004, [0.0] * DIM, 0, "zero")]
    return spark.createDataFrame(rows, "id long, v array<double>, label long, name string").repartition(4).cache()


@pytest.fixture(scope="module", params=["l2", "cosinesimil", "innerproduct"])
def index(vectors, tmp_path_factory, request):
    return ivf.VectorIndex.build(vectors, "id", "v", str(tmp_path_factory.mktemp("ivf") / "i"), clusters=32, space=request.param)


def queries(vectors):
    return [[x + 0.1 for x in r["v"]] for r in vectors.filter("id < 4000 AND id % 200 = 0").collect()]


def ids(df):
    return [r["id"] for r in df.collect()]


def good(vectors):
    return vectors.filter("id < 4000 OR id = 5004")  # a zero vector has no cosine, but a distance


def test_every_row_is_indexed(vectors, index, spark):
    stored = spark.read.parquet(f"{index.path}/rows")
    assert sorted(ids(stored)) == sorted(ids(vectors))
    assert sorted(ids(stored.filter(F.col("__cluster") == ivf.NONE))) == [5000, 5001, 5002, 5003]


def test_recall_and_exactness(vectors, index):
    asked, found, total = queries(vectors)[:8], 0, 0
    for q in asked:
        want = ids(knn.nearest(good(vectors), "id", "v", q, 10, index.space))
        found += len(set(ids(index.search(q, 10, nprobe=8))) & set(want))
        total += len(want)
    assert found / total >= 0.9
    q = asked[0]
    exact = knn.nearest(good(vectors), "id", "v", q, 10, index.space).collect()
    assert index.search(q, 10, nprobe=32, oversample=0).collect() == exact
    assert ids(index.search(q, 10, nprobe=99, oversample=20)) == [r["id"] for r in exact]


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.executedPlan().collectLeaves() if "AdaptiveSparkPlan" in plan.nodeName() else plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_files_read_follow_nprobe(vectors, index):
    q = queries(vectors)[1]
    read = [files_read(index.search(q, 5, nprobe=n, oversample=0)) for n in (1, 4, 16)]
    whole = files_read(index.search(q, 5, nprobe=32, oversample=0))
    assert read[0] < read[1] < read[2] < whole and read[0] <= whole / 8


def test_filters_widen(vectors, index):
    q = queries(vectors)[2]
    want = ids(knn.nearest(good(vectors).filter("label = 7"), "id", "v", q, 50, index.space))
    got = ids(index.search(q, 50, nprobe=1, filter=F.col("label") == 7, oversample=100))
    assert len(got) == 50 and len(set(got) & set(want)) >= 45
    assert len(ids(index.search(q, 50, nprobe=1, filter=F.col("label") == 7, widen=False))) < 50


def test_as_a_source_and_bounds(vectors, index):
    q = queries(vectors)[3]
    source = index.probe(q, 32)
    assert source.columns == vectors.columns
    hits = Search(source, "id").must(F.col("label") < 25).knn("v", q, 7, index.space).hits()
    assert ids(hits) == ids(knn.nearest(good(vectors).filter("label < 25"), "id", "v", q, 7, index.space))
    best = index.search(q, 3).first()["_score"]
    assert index.search(q, 3, min_score=best + 1).count() == 0


def test_nothing_to_index(spark, tmp_path):
    with pytest.raises(ValueError):
        ivf.VectorIndex.build(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        ivf.VectorIndex.build(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), "id", "v", str(tmp_path / "y"), space="other")
