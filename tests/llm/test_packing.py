import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievelake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[n] for n in lengths]
    ends = packing.optimal_boundaries(np.array(lengths), np.array(counts), buckets)
    assert len(ends) <= buckets and ends[-1] == lengths[-1]
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], k))
    assert padding(lengths, counts, ends) == best


def check(out, n, budget=65_536):
    assert len(out) == n
    batches = {}
    for r in out:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), rows in batches.items():
        assert len(rows) * rows[0]["bucket_len"] <= max(budget, rows[0]["bucket_len"])
        assert sorted(r["row_in_batch"] for r in rows) == list(range(len(rows)))
        # every batch but the last of its bucket is full
        assert (bucket, batch + 1) not in batches or len(rows) == max(1, budget // max(1, rows[0]["bucket_len"]))
        assert batch == 0 or (bucket, batch - 1) in batches
    if out:
        lengths, counts = np.unique([r["n_tokens"] for r in out], return_counts=True)
        ends = packing.optimal_boundaries(lengths, counts, len({r["bucket_len"] for r in out}))
        assert sum(r["padding"] for r in out) == padding(lengths.tolist(), counts.tolist(), ends)


def test_batches_hold_the_tokenizers_ids(spark, documents, rows, tmp_path):
    """Each document's ids, read back under the mask, and the padding beside it."""
    out = packing.pack(documents, str(tmp_path / "p"), PATH, pad_id=7, buckets=4, budget=500).collect()
    check(out, len(rows), 500)
    want = [(i, e.ids) for (i, _, _), e in zip(rows, Tokenizer.from_file(PATH).encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False))]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out), key=str) == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want), key=str)
    for r in spark.read.parquet(str(tmp_path / "p/batches")).collect():
        table = np.frombuffer(r["ids"], "<u4").reshape(r["n_rows"], r["bucket_len"])
        mask = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=table.size).reshape(table.shape).astype(bool)
        assert (table[~mask] == 7).all() and len(r["doc_id"]) == len(table) == len(r["lang"])
        assert (mask[:, 1:] <= mask[:, :-1]).all()


def test_clashing(spark, clashing, rows, tmp_path):
    out = packing.pack(clashing, str(tmp_path / "p"), PATH)
    assert len(set(out.columns)) == len(out.columns)
    check(out.collect(), len(rows))


def test_coarse_histogram(spark):
    sized = spark.range(500).selectExpr("id as doc_id", "id as n_tokens")
    out = packing.place(sized, buckets=5, most_lengths=20, budget=1000, cell_rows=10).collect()
    assert len(out) == 500 and all(r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in out)
    assert len({(r["bucket"], r["batch"], r["row_in_batch"]) for r in out}) == 500


def test_empty(empty, tmp_path):
    check(packing.pack(empty, str(tmp_path / "p"), PATH).collect(), 0)


def test_one_long_document_leaves_the_short_ones_exact(spark):
    sized = spark.range(300).selectExpr("id as doc_id", "case when id = 0 then 10000000 else 1 + id % 200 end as n_tokens")
    out = packing.place(sized, buckets=16).collect()
    lengths, counts = np.unique([r["n_tokens"] for r in out], return_counts=True)
    ends = packing.optimal_boundaries(lengths, counts, 16)
    assert sum(r["padding"] for r in out) == padding(lengths.tolist(), counts.tolist(), ends)
    assert len({r["bucket_len"] for r in out}) == 16


def test_many_lengths_are_rounded_in_proportion(spark):
    sized = spark.range(1, 5001).selectExpr("id as n_tokens")
    lengths, counts, kept = packing.length_histogram(sized, 400)
    assert len(lengths) <= 400 and counts.sum() == 5000 and lengths[-1] >= 5000
    assert lengths[: 1 << kept].tolist() == list(range(1, (1 << kept) + 1))
    assert (np.diff(lengths) <= np.maximum(1, lengths[1:] / (1 << kept - 1))).all()


def test_python_gets_small_batches(spark, tmp_path, monkeypatch):
    """However many batches of ids a partition holds, Arrow batches stay small."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["nbytes"])

    monkeypatch.setattr(packing, "read_batches", lambda spark, path: spark.read.parquet(path).select("ids").coalesce(1).mapInArrow(sizes, "nbytes long"))
    docs = spark.range(0, 9000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 100) as text")
    found = [r["nbytes"] for r in packing.pack(docs, str(tmp_path / "p"), PATH).collect()]
    assert sum(found) >= 9000 * 200 * 4 and max(found) < 5_000_000
