"""Quality rules from repeated substrings, found with a suffix array.

For each document the suffix array over its words is built by prefix doubling
(suffixes that a prefix already tells apart leave the race at once), the longest
common prefixes of neighbours come from the ranks of every doubling level, and
their intervals are the maximal repeated substrings.  The union of the repeated
spans of ``min_repeat`` words or more gives the covered fraction; the verdict
limits it and the longest repeat.  Repeats of three words or more are counted,
so that texts of short phrases or single words said over and over are rejected,
which the base rule with its windows of eight words does not see.

A whole block of documents is sorted at a time, with the document as part of
each word's rank, so that repeats never cross documents.  A very long text is a
block of its own and is worked through whole.

Defined results: a null or blank text has no words and fails the base rule; rows
of a table are judged one by one, so ties and repeated rows are alike; an empty
table gives an empty result.  Input columns named like an output column are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed by the contract: characters that count as symbols, words in a window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of smaller keys, number of equal keys) for each key."""
    _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - counts)[place].astype(np.int64), counts[place]


class SuffixArray:
    """The suffixes of a block that repeat ``least`` words (a power of two), in
    order, and the longest common prefix of each with the one before.

    The rank of a suffix is the number of suffixes before its group.  Up to
    ``least`` words all suffixes are ranked; from there only groups of two or
    more go on.  A suffix that ends inside the prefix is alone in its group.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, least: int):
        n = len(codes)
        owner = np.repeat(np.arange(len(counts)), counts)
        end = np.repeat(np.cumsum(counts), counts)
        rank, often = _starts(owner * np.int64(int(codes.max()) + 1 if n else 1) + codes)
        levels, step = [rank], 1
        place = np.arange(n)

        def next_key(at):
            ahead = at + step
            inside = ahead < end[at]
            return rank[at] * np.int64(n + 1) + np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)

        while step < least:
            rank, often = _starts(next_key(place))
            levels.append(rank)
            step *= 2
        live = place[often > 1]
        repeated = live
        while len(live):
            key = next_key(live)
            order = np.argsort(key)
            live, key = live[order], key[order]
            old = rank[live]
            at = np.arange(len(live))
            new_group = np.concatenate([[True], old[1:] != old[:-1]])
            new_part = np.concatenate([[True], key[1:] != key[:-1]])
            part = np.cumsum(new_part) - 1
            refined = old + at[new_part][part] - at[new_group][np.cumsum(new_group) - 1]
            rank = rank.copy()
            rank[live] = refined
            live = live[np.bincount(part)[part] > 1]
            levels.append(rank)
            step *= 2
        self.places = repeated[np.argsort(rank[repeated])]
        a, b = self.places[:-1].copy(), self.places[1:].copy()
        self.lcp = np.zeros(len(self.places), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            level = levels[j]
            hit = (a < n) & (b < n)
            hit &= level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]
            self.lcp[1:] += hit.astype(np.int64) << j
            a, b = a + (hit.astype(np.int64) << j), b + (hit.astype(np.int64) << j)

    def spans(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of every occurrence of the maximal repeats of ``least``
        words or more: a suffix repeats as far as its better neighbour."""
        if not len(self.places):
            return self.places, self.places
        length = np.maximum(self.lcp, np.concatenate([self.lcp[1:], [0]]))
        enough = length >= least
        return self.places[enough], length[enough]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places some span covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def judge(texts: pa.Array, min_repeat: int, most_covered: float, longest: int) -> pa.RecordBatch:
    """The output columns for a block of texts."""
    n = len(texts)
    codes, counts, distinct = common.words_of(texts)
    # code points of the words: distinct words are measured once
    chars = pc.utf8_length(distinct.cast(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), counts)
    word_chars = np.bincount(owner, weights=chars[codes] if len(codes) else None, minlength=n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    if len(distinct):
        table = distinct.cast(pa.binary())
        sizes = pc.binary_length(table).to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(table.to_pylist()), np.uint8)
        per = np.add.reduceat(symbol[raw].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        n_symbols = np.bincount(owner, weights=per[codes], minlength=n).astype(np.int64)
    else:
        n_symbols = np.zeros(n, np.int64)
    # lines with a word that are equal to an earlier one of the text
    split = pc.split_pattern(texts, "\n")
    per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    lines = split.flatten()
    worded = pc.match_substring_regex(lines, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), per_text)[worded]
    line_code = lines.filter(pa.array(worded)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.bincount(line_owner, minlength=n)
    different = np.unique(line_owner * np.int64(len(lines) + 1) + line_code)
    n_dup_lines = n_lines - np.bincount(different // (len(lines) + 1), minlength=n)

    suffixes = SuffixArray(codes, counts, 2)
    windows, _ = suffixes.spans(WINDOW)
    hit = covered(windows, np.full(len(windows), WINDOW), len(codes))
    n_repeat_words = np.bincount(owner[hit], minlength=n)
    starts, lengths = suffixes.spans(min_repeat)
    inside = covered(starts, lengths, len(codes))
    covered_words = np.bincount(owner[inside], minlength=n)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, owner[starts], lengths)

    base_failed = (counts < 20) | (100 * n_repeat_words > 30 * counts)
    kept = ~base_failed & (covered_words <= most_covered * counts) & (best <= longest)
    numbers = [counts, word_chars, n_symbols, n_dup_lines, n_repeat_words]
    columns = [pa.array(x.astype(np.int64)) for x in numbers] + [pa.array(base_failed)]
    columns += [pa.array(covered_words.astype(np.int64)), pa.array(best), pa.array(kept)]
    return pa.record_batch(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])


def repetition_rules(docs: DataFrame, min_repeat: int = 3, most_covered: float = 0.3, longest: int = 60, block_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` with the columns of ``COLUMNS``.

    ``kept`` is false if the base rule fails, if repeats of ``min_repeat`` words
    (2 or more) cover over ``most_covered`` of the words, or if one
    has over ``longest`` words.
    """
    added = T._parse_datatype_string(COLUMNS)
    docs = docs.drop(*added.fieldNames())
    schema = T.StructType([*docs.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_one(batch.column(batch.schema.get_field_index("text")))
            for a, b in common.slices_by_bytes(texts, block_bytes):
                found = judge(texts.slice(a, b - a), min_repeat, most_covered, longest)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *found.columns], names=[*part.schema.names, *found.schema.names])

    return docs.mapInArrow(run, schema)


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition_rules(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")
