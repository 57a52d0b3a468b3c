import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sievelake.llm import common, resampling
from sievelake.llm.resampling import Resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, least=1, most=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = WORD.findall((text or "").translate(small))
        runs = [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in runs]

    here = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in here for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000.0 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in {*s, *t}}
    out = []
    for (i, _), (n, f) in zip(rows, here):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, n >= least_words])
    order = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(order[: percent * len(order) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def run(docs, target, **how):
    found = resampling.resample(docs.select("doc_id", "text"), target, Resampling(**how))
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def target(spark):
    return ["one TWO ß three", None, "", "line one", "x y x y 1.2.3.4"]


@pytest.mark.parametrize("how", [{}, {"most": 3, "percent": 60, "least_words": 5}, {"least": 2, "most": 2, "buckets": 7, "percent": 100, "least_words": 0}])
def test_brute_force(spark, documents, rows, target, how):
    far = spark.createDataFrame([(t,) for t in target], "text string")
    assert run(documents, far, **how) == brute([(i, t) for i, t, _ in rows], target, **how)


def test_empty_tables(spark, documents, empty, rows):
    far = spark.createDataFrame([], "text string")
    assert run(documents, far, percent=50) == brute([(i, t) for i, t, _ in rows], [], percent=50)
    assert run(empty, far) == []


def test_repeated_rows_and_ties(spark):
    rows = [(5, "w " * 30)] * 40 + [(6, "w " * 30)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    far = spark.createDataFrame([("w v",)], "text string")
    assert run(docs, far, percent=50) == brute(rows, ["w v"], percent=50)


def test_other_columns_are_held(spark, clashing, target):
    far = spark.createDataFrame([(t,) for t in target], "text string")
    held = common.held_apart(clashing, ("doc_id", "text"))
    found = resampling.resample(held, far)
    assert found.count() == clashing.count()
    assert found.select(f"{common.REST}.*").columns == [c for c in clashing.columns if c not in ("doc_id", "text")]


def test_bounds():
    with pytest.raises(ValueError):
        Resampling(least=2, most=1)
    with pytest.raises(ValueError):
        Resampling(buckets=1 << 21)


def test_no_python_in_the_plan(spark, documents, target):
    far = spark.createDataFrame([("one two",)], "text string")
    plan = resampling.resample(documents.select("doc_id", "text"), far)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
