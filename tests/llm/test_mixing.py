import re
from collections import defaultdict

from pyspark.sql import functions as F

from sievelake.llm import mixing


def targets_by_filling(sizes, weights=(1, 2, 3), most=3):
    """Share, cut at the limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(w[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / share for s in order}
        over = {s for s in order if s not in capped and target[s] >= most * sizes[s] and sizes[s] * most <= target[s]}
        if not over:
            return target
        capped |= over
        if len(capped) == len(order):
            return {s: float(most * sizes[s]) for s in order}


def check(docs, rows, **options):
    got = mixing.systematic_mix(docs, **options).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    target = targets_by_filling(dict(sizes))
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1.5 * largest[s] + 1
    return got


def test_odd_rows(documents, clashing, rows):
    first = check(documents, rows)
    again = check(clashing, rows)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, first), key=str) == sorted(map(key, again), key=str)


def test_even_source(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), "a" if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r["doc_id"], r["size"], r["copies"])
    # the cells grow in number with the table and change nothing
    assert sorted(map(key, check(docs, rows))) == sorted(map(key, check(docs, rows, cell_rows=10)))
    assert [mixing.cell_digits(n, 200_000) for n in (0, 10**6, 10**8, 10**11)] == [1, 1, 3, 5]


def test_empty_and_wordless(spark, empty):
    assert mixing.systematic_mix(empty).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.systematic_mix(docs).collect()] == [0, 0]


def test_repeated_rows(documents):
    mixed = mixing.systematic_mix(documents)
    assert mixing.repeat_rows(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
