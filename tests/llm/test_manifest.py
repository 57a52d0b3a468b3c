import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sievelake.llm import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """The contract by plain lists: (doc_id, source, lang, n_chars, text) rows."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = {}
    for i, s, g, n, t in rows:
        seen = n + 1 if None not in (n, i) and zlib.crc32(str(i).encode()) % 7 == 0 else n
        leaves.setdefault(g, []).append((i, digest("".join(map(value, (i, s, g, n, t)))), digest("".join(map(value, (i, s, g, seen, t))))))

    def levels(h):
        out = [h]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
        return out

    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        leaves[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels([x[1] for x in leaves[g]]) for g in groups}
    top = levels([trees[g][-1][0] for g in groups])
    out = []
    for j, g in enumerate(groups):
        for p, (i, leaf, h) in enumerate(leaves[g]):
            beside = []
            for tree, q in ((trees[g], p), (top, j)):
                for level in tree[:-1]:
                    other = level[q ^ 1] if q ^ 1 < len(level) else ""
                    beside.append(other)
                    h = digest(h + other if q % 2 == 0 else other + h)
                    q //= 2
            out.append((i, leaf, trees[g][-1][0], top[-1][0], digest("".join(beside)), h, h == top[-1][0]))
    return sorted(out, key=str)


def run(docs):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = manifest.manifest(docs, n_chars=changed)
    path = F.col("path")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(path), 256), manifest.fold(F.col("seen_leaf"), path), manifest.fold(F.col("seen_leaf"), path) == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_odd_rows(spark, documents, clashing):
    want = brute(plain(documents))
    assert run(documents) == want
    assert run(clashing) == want  # other columns play no part


@pytest.mark.parametrize("levels", [2, 10])
def test_sizes_around_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rng = random.Random(levels)
    rows = []
    for g, n in ((None, 1), ("a", 2), ("b", 3), ("é", 17), ("z", 1), ("Z", 40), ("", 8)):
        rows += [(rng.randrange(60), rng.choice(["s", None]), g, rng.choice([None, 5]), rng.choice(["", None, "tëxt 😀"])) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert run(docs) == brute(rows)


def test_more_than_one_block(spark):
    docs = spark.range(2600).selectExpr("id AS doc_id", "'s' AS source", "if(id < 2590, 'en', null) AS lang", "id % 9 AS n_chars", "cast(id AS string) AS text")
    assert run(docs) == brute(plain(docs))


def test_one_row_many_times(spark):
    docs = spark.range(0, 1500, 1, 4).selectExpr("7L AS doc_id", "'s' AS source", "'en' AS lang", "1L AS n_chars", "'same' AS text")
    assert run(docs) == brute(plain(docs))


def test_empty_and_one(spark, empty):
    assert run(empty) == []
    one = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert run(one) == brute(plain(one))
    found = manifest.manifest(one).first()
    assert found["path"] == [] and found["leaf"] == found["subroot"] == found["root"]


def test_paths_are_preimages(documents):
    for r in manifest.manifest(documents).collect():
        h = r["leaf"]
        for p in r["path"]:
            assert p["preimage"][64 * p["slot"] : 64 * p["slot"] + 64] == h
            h = digest(p["preimage"])
        assert h == r["root"]
