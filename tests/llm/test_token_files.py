import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievelake.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_files_give_back_every_id(spark, documents, rows, tmp_path):
    token_files.write(documents, str(tmp_path / "f"), PATH, end_id=2, shard_ids=2000)
    got = sorted(token_files.read_documents(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for i in encoded([t or "" for _, t, _ in rows]))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_empty_table(spark, empty, tmp_path):
    token_files.write(empty, str(tmp_path / "f"), PATH, end_id=2)
    assert token_files.read_documents(spark, str(tmp_path / "f")).count() == 0


def test_clashing_columns(spark, clashing, rows, tmp_path):
    token_files.write(clashing, str(tmp_path / "f"), PATH, end_id=2)
    assert token_files.read_documents(spark, str(tmp_path / "f")).count() == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.data())
def test_grammar_round_trip(ids, data):
    ids = np.array(ids, np.uint32)
    grammar = token_files.Grammar(*token_files.compress(ids, least=2))
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert grammar.decode(0, len(ids)).tolist() == ids.tolist()
    assert grammar.decode(a, b).tolist() == ids[a:b].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB'é,.;!?<|>1 \n\tſİ́ß…😀日"), max_size=30), min_size=1, max_size=6))
def test_words_encode_like_texts(texts):
    import pyarrow as pa

    ids, sizes = token_files.encoder_for(PATH).encode(pa.array(texts))
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == encoded(texts)


PIECES = [*"aB'é,.;!?<|>1 \n\tſİ\u0301ß…😀日", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "Words"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=6))
def test_special_strings_encode_like_texts(texts):
    import pyarrow as pa

    ids, sizes = token_files.encoder_for(PATH).encode(pa.array(texts))
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == encoded(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=600), st.integers(2, 9))
def test_no_frequent_pair_is_left(ids, least):
    rules, lengths, sequence = token_files.compress(np.array(ids, np.uint32), least)
    pairs = list(zip(sequence.tolist(), sequence[1:].tolist()))
    assert max((pairs.count(p) for p in set(pairs)), default=0) < least
    assert len(lengths) == len(rules) == len({tuple(r) for r in rules.tolist()})


def test_repeats_shrink_to_their_grammar():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 40_000, 300)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 40_000, 20)]) for _ in range(400)]).astype(np.uint32)
    rules, _, sequence = token_files.compress(ids)
    assert len(sequence) <= 400 * 22 and 299 <= len(rules) <= 400


def test_ranked_pairs():
    rng = np.random.default_rng(1)
    for n, most in ((1, 5), (1000, 40), (70_000, 1 << 40)):
        pairs = rng.integers(0, most, n)
        pairs[0] = most - 1
        order, distinct, counts = token_files.ranked_pairs(pairs)
        want = np.unique(pairs, return_counts=True)
        assert (distinct == want[0]).all() and (counts == want[1]).all()
        assert (order == np.argsort(pairs, kind="stable")).all()
