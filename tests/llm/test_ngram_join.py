import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import components, ngram_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return sorted(((d, len(sets[i]), smallest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **given):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, **given).collect()), key=str)


def test_odd_rows(documents, clashing, rows):
    want = brute([(i, t) for i, t, _ in rows])
    assert got(documents) == want
    assert got(clashing) == want


def test_borderline_links(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(140):
        t = [rng.choice(words) for _ in range(rng.randint(4, 40))] if i % 5 == 0 or not rows else rng.choice(rows)[1].split()
        if i % 5:
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t))
                t = t[:at] + [rng.choice(words)] * rng.randint(0, 2) + t[at + 1 :]
        rows.append((i, " ".join(t)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)


def test_shared_passage_and_large_group(spark):
    rng = random.Random(9)
    prose = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passage, base = prose(60), prose(80)
    rows = [(i, " ".join(prose(20) + passage + prose(8))) for i in range(120)]
    for i in range(150):
        t = list(base)
        t[rng.randrange(80)] = "edit"
        rows.append((500 + i, " ".join(t)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), brute(rows)
    assert got(df) == want
    assert got(df, most_members=8) == want  # long lists in pieces


def test_sets_are_read_once_a_class(spark):
    rng = random.Random(10)
    base = [f"v{rng.randrange(5000)}" for _ in range(80)]
    near = base[:70] + ["edit"] + base[71:]
    rows = [(i, " ".join(base if i % 2 else near)) for i in range(600)] + [(1, " ".join(base))] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    fps = [ngram_join.fingerprint(ngram_join.common.shingle_sets(ngram_join.pa.array([" ".join(t)]), 5)[0]) for t in (near, base)]
    ends = spark.createDataFrame(list(zip(fps, (0, 1))), "fp long, doc_id long")
    assert ngram_join.whole_sets(docs, ends, 1, 100_000).count() == 2  # with a table that every id passes
    assert got(docs) == brute(rows)


def test_meetings(spark):
    """Any two members of different labels meet; those of a large label do not."""
    rng = random.Random(12)
    members = [(k, i, 0 if i < 40 else 1 if i < 60 else rng.randrange(2, 30)) for k in (1, 2) for i in range(60 + 40 * (k - 1))]
    out = ngram_join.meetings(spark.createDataFrame(members, "key long, fp long, label long").withColumn("label", ngram_join.F.col("label")), 16).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r["piece"], []).append((r["fp"], r["label"]))
    met = {(a[0], b[0]) for p in pieces.values() for a in p for b in p if a[1] != b[1]}
    for k, i, x in members:
        for q, j, y in members:
            assert k != q or x == y or (i, j) in met
    assert all(len(p) == len(set(p)) for p in pieces.values()) and max(map(len, pieces.values())) <= 40


def test_empty(empty):
    assert got(empty) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=2, max_size=40))
def test_bound_loses_no_pair(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    points, sizes = [ngram_join.point(a) for a in arrays], np.array([len(a) for a in arrays])
    found = {tuple(sorted(p)) for p in ngram_join.surviving_pairs(points, sizes, lambda p: False)}
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                assert (j, i) in found
                assert ngram_join.linked(arrays[i], arrays[j])


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(301)) and out[1002] == 1000


def test_keep_first(documents, rows):
    kept = ngram_join.keep_first(documents).collect()
    want = {i for i, _, c in ((d, n, c) for d, n, c in brute([(i, t) for i, t, _ in rows])) if i == c}
    ids = [r["doc_id"] for r in kept]
    assert {6, 4, 1, 2, 3} <= set(ids) and 7 not in ids and 8 not in ids and ids.count(6) == 1
    assert want - {None} <= set(ids)


def test_components_grow(spark):
    first = components.connected_components(spark.createDataFrame([(5, 6), (8, 9)], "a long, b long"))
    out = components.joined_components(first, spark.createDataFrame([(9, 5), (1, 6), (20, 21)], "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {1: 1, 5: 1, 6: 1, 8: 1, 9: 1, 20: 20, 21: 20}
