import random
import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import repetition


def brute(text, least=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)

    def covered(size):
        seen = Counter(tuple(w[i : i + size]) for i in range(n - size + 1))
        return len({j for i in range(n - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)})

    low, high = least - 1, n  # the longest repeat is at least ``low``, or there is none
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if len({tuple(w[i : i + mid]) for i in range(n - mid + 1)}) <= n - mid else (low, mid)
    longest = low if low >= least else 0
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found = n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), covered(8), covered(least), longest
    failed = n < 20 or 100 * found[4] > 30 * n
    return *found, failed, not failed and found[5] <= 0.3 * n and longest <= 60


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"]


def test_against_brute_force(documents, rows):
    got = repetition.repetition_rules(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[f] for f in FIELDS) == brute(r["text"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[6] and kept[7] and not kept[10] and not kept[1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n#"), max_size=120), min_size=1, max_size=5), st.integers(2, 9))
def test_blocks_of_texts(texts, least):
    got = repetition.judge(pa.array(texts), least, 0.3, 60).to_pylist()
    assert [tuple(r[f] for f in FIELDS) for r in got] == [brute(t, least) for t in texts]


def test_method_alone_rejects(spark, sf):
    """Texts that pass the base rule and are rejected for their short repeats."""
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    stutter = [w for w in prose(8) for _ in range(7)]  # no window of eight words comes twice
    phrases = prose(60)
    for i in range(0, 56, 14):
        phrases[i : i + 5] = ["see", "our", "best", "price", str(i)]
    rows = [(1, " ".join(stutter)), (2, " ".join(prose(60))), (3, " ".join(phrases)), (4, " ".join(phrases[:15] * 1 + ["see", "our", "best", "price"] * 3 + prose(8)))]
    got = {r["doc_id"]: r for r in repetition.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["base_failed"] and not got[1]["kept"] and got[1]["covered_words"] == 56
    assert got[2]["kept"] and got[3]["kept"] and got[3]["covered_words"] == 16
    out = repetition.op2_suffix_repetition(spark, sf.replace("sf0.001", "sf0.1"))
    assert out.filter("not base_failed and not kept").count() >= 10


def test_long_repeats_are_rejected(spark):
    words = [f"w{i}" for i in range(800)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:70])), (3, " ".join(words[:30] + words[:30]))]
    got = {r["doc_id"]: r["kept"] for r in repetition.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_empty_and_clashing(empty, clashing, rows):
    assert repetition.repetition_rules(empty).count() == 0
    out = repetition.repetition_rules(clashing)
    assert out.count() == len(rows) and len(set(out.columns)) == len(out.columns)
