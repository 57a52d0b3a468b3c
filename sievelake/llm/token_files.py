"""Token-id files compressed with Re-Pair grammars.

Documents are put in ascending doc_id order and encoded; the ids of runs of
documents form shards.  In each shard frequent neighbouring ids are replaced by
nonterminals, round after round, until no pair of neighbours is frequent; a shard keeps its rules, the expansion length
of each nonterminal and the remaining sequence, so that any range of ids is
decoded by a binary search over summed expansion lengths.

File format: a Parquet folder with a row per shard (``SHARD``).  Pairs and
symbols are little-endian: ``rules`` holds two unsigned 32-bit symbols each,
``expansions`` an unsigned 32-bit length each, ``sequence`` 24-bit symbols.
Symbols below ``FIRST_RULE`` are ids; symbol ``FIRST_RULE + i`` is rule ``i``.
``part`` and ``seq`` order the shards.

Defined results: a null text is an empty one (its only id is the end id); rows
with equal doc_id are ordered by a digest of their text and kept each; null
doc_ids come first; an empty table gives an empty file and result; further
columns of the input are left out.
"""

from __future__ import annotations

import re
import string
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FIRST_RULE = 1 << 16
SHARD = "part int, seq int, n_docs int, n_ids long, doc_ids binary, doc_null binary, doc_lengths binary, rules binary, expansions binary, sequence binary"
_NAMES = [c.split()[0] for c in SHARD.split(", ")]


class WordEncoder:
    """Encodes texts with a tokenizer whose tokens never span white space.

    Each distinct stem goes through the tokenizer once: a word in lower case and
    without closing punctuation, which such a tokenizer treats apart.  Words with
    combining marks or a special token's string are taken as they are, since marks
    may compose with letters.
    The table of stems is emptied beyond ``most``.
    """

    CLOSING = "".join(c for c in string.punctuation if c != "'")
    CHUNK = 500

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        # strings that are one token each wherever they stand, if they are written so:
        # words with them in any case are left alone
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = f"(?i){special}" if special else ""
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.word_end[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.n = self.n_ids = 0

    def _tokenize(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the words in another order, their ids, number of ids per word).

        Words of letters alone are encoded a chunk at a time, parted by blanks:
        each ends at a token that ends a word."""
        plain = [w for w in words if w.isalpha()]
        single = [w for w in words if not w.isalpha()]
        chunks = [plain[i : i + self.CHUNK] for i in range(0, len(plain), self.CHUNK)]
        order, ids, sizes = [], [], []
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            part = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.word_end[part]) + 1
            if len(cuts) != len(chunk):  # a letter fell apart under normalisation
                single += chunk
                continue
            order += chunk
            ids.append(part)
            sizes.append(np.diff(cuts, prepend=0))
        for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        return order + single, np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        words, ids, sizes = self._tokenize(words)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.ends[self.n : self.n + len(words)] = self.n_ids + np.cumsum(sizes)
        self.place.update(zip(words, range(self.n, self.n + len(words))))
        self.n, self.n_ids = self.n + len(words), self.n_ids + len(ids)

    def _slices(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in the table of ids for each of ``words``."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            unseen = [distinct[i] for i in missing]
            self._learn(unseen)
            at[missing] = np.fromiter(map(self.place.get, unseen), np.int64, len(unseen))
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        start = np.where(at > 0, self.ends[at - 1], 0)
        return start, self.ends[at] - start

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text)."""
        codes, counts, words = common.words_of(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.n + len(words) > self.most:
            self.clear()
        marked = pc.match_substring_regex(words, r"\p{M}") if not pc.all(pc.string_is_ascii(words)).as_py() else pa.scalar(False)
        whole = pc.match_substring_regex(words, self.whole) if self.whole else pa.scalar(False)
        lower = pc.if_else(pc.or_(marked, whole), words, pc.ascii_lower(words))
        stem = pc.ascii_rtrim(lower, self.CLOSING)
        closed = pc.not_equal(pc.binary_length(stem), pc.binary_length(lower))
        parted = pc.and_(pc.and_(closed, pc.match_substring_regex(stem, "[a-z]$")), pc.invert(whole))
        stem = pc.if_else(parted, stem, lower)
        s0, n0 = self._slices(stem)
        s1, n1 = np.zeros_like(s0), np.zeros_like(n0)
        where = parted.to_numpy(zero_copy_only=False)
        if where.any():
            tail = pc.replace_substring_regex(lower.filter(parted), rf"^.*?([{re.escape(self.CLOSING)}]*)$", r"\1")
            s1[where], n1[where] = self._slices(tail)
        # ids of each distinct word, one after the other, then of each word of the texts
        both = self.ids[common.ragged(np.stack([s0, s1], 1).ravel(), np.stack([n0, n1], 1).ravel())]
        size = n0 + n1
        start = np.cumsum(size) - size
        lengths = size[codes]
        ids = both[common.ragged(start[codes], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder for each Python worker, which keeps its tables between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def ranked_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of ``pairs`` in ascending order, the distinct ones, their counts).

    A pair has 40 bits; with its place in the other 24 numbers alone are sorted,
    which is faster than sorting places by them.
    """
    if len(pairs) <= 1 << 24:
        both = pairs.astype(np.uint64) << np.uint64(24) | np.arange(len(pairs), dtype=np.uint64)
        both.sort()
        order, ranked = (both & np.uint64((1 << 24) - 1)).view(np.int64), (both >> np.uint64(24)).view(np.int64)
    else:
        order = np.argsort(pairs, kind="stable")
        ranked = pairs[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order, ranked[start], np.diff(np.append(start, len(ranked)))


def compress(ids: np.ndarray, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, sequence) of a Re-Pair grammar for ``ids``.

    Rounds go on until no pair of neighbours occurs ``least`` times (a rule pays
    for its bytes from there).  A round replaces the pairs that occur at least a
    quarter as often as the most frequent one, from left to right where
    occurrences overlap.

    Counts of old pairs only fall, so a pair once found rare stays rare: a round
    counts the pairs with a symbol of the round before and those that were
    frequent then, not the whole sequence.
    """
    sequence = ids.astype(np.int32)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    n_rules = 0
    live = np.ones(len(sequence), bool)
    live[-1:] = False  # the last has no neighbour
    while len(at := np.flatnonzero(live)):
        order, distinct, counts = ranked_pairs(sequence[at].astype(np.int64) << 20 | sequence[at + 1])
        most = int(counts.max())
        if most < least:
            break
        live[at[order[np.repeat(counts < least, counts)]]] = False
        often = counts >= max(least, most // 4)
        which = np.full(len(at), -1)
        which[order[np.repeat(often, counts)]] = np.repeat(np.flatnonzero(often), counts[often])
        hit = which >= 0
        where, rule = at[hit], which[hit]
        # in a run of overlapping occurrences every second one, from the first
        run = np.concatenate([[True], np.diff(where) != 1])
        odd = (where - where[run][np.cumsum(run) - 1]) % 2 == 1
        where, rule = where[~odd], rule[~odd]
        taken = np.zeros(len(distinct), bool)
        taken[rule] = True
        used, rule = np.flatnonzero(taken), (np.cumsum(taken) - 1)[rule]
        if n_rules + len(used) > (1 << 20) - FIRST_RULE:
            break
        made = distinct[used]
        pair = np.stack([made >> 20, made & 0xFFFFF], 1)
        size = np.ones(FIRST_RULE + n_rules, np.int64)
        size[FIRST_RULE:] = lengths
        lengths = np.concatenate([lengths, size[pair[:, 0]] + size[pair[:, 1]]])
        rules.append(pair)
        sequence[where] = FIRST_RULE + n_rules + rule
        keep = np.ones(len(sequence), bool)
        keep[where + 1] = False
        kept = np.flatnonzero(keep)
        sequence, live = sequence[kept], live[kept]
        fresh = where - np.arange(len(where))  # as many went before each
        live[fresh] = True
        live[fresh[fresh > 0] - 1] = True
        live[-1] = False
        n_rules += len(used)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), lengths, sequence.astype(np.int64)


class Grammar:
    """Decodes ranges of ids of one compressed shard."""

    def __init__(self, rules: np.ndarray, expansions: np.ndarray, sequence: np.ndarray):
        self.sequence = sequence
        size = np.ones(FIRST_RULE + len(rules), np.int64)
        size[FIRST_RULE:] = expansions
        self.size = size
        self.ends = np.cumsum(size[sequence]) if len(sequence) else np.zeros(0, np.int64)
        # ids, then the expansions of all rules; the rules of a round only use
        # earlier rounds, so each round is written at once
        self.start = FIRST_RULE + np.concatenate([[0], np.cumsum(expansions)])
        self.table = np.zeros(int(self.start[-1]), np.uint32)
        self.table[:FIRST_RULE] = np.arange(FIRST_RULE)
        last, low = rules.max(1) - FIRST_RULE if len(rules) else np.zeros(0, np.int64), 0
        while low < len(rules):
            later = np.flatnonzero(last[low:] >= low)
            high = low + int(later[0]) if len(later) else len(rules)
            symbols = rules[low:high].ravel()
            self.table[self.start[low] : self.start[high]] = self.table[common.ragged(self._places(symbols), size[symbols])]
            low = high

    def _places(self, symbols: np.ndarray) -> np.ndarray:
        """Where the expansion of each symbol starts in the table."""
        return np.where(symbols < FIRST_RULE, symbols, self.start[np.maximum(symbols - FIRST_RULE, 0)])

    def decode(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` up to, not including, ``last`` of the shard."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.ends, first, side="right"))
        b = int(np.searchsorted(self.ends, last, side="left")) + 1
        symbols = self.sequence[a:b]
        base = int(self.ends[a] - self.size[symbols[0]])
        ids = self.table[common.ragged(self._places(symbols), self.size[symbols])]
        return ids[first - base : last - base]


def _three_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = 1 << 18, block_bytes: int = 8_000_000) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = encoder_for(tokenizer), TaskContext.get().partitionId(), 0
        held_ids, held_docs, held_sizes, n = [], [], [], 0

        def flush():
            nonlocal seq, n
            ids, sizes, doc_ids = np.concatenate(held_ids), np.concatenate(held_sizes), pa.concat_arrays(held_docs)
            rules, expansions, sequence = compress(ids)
            null = doc_ids.is_null().to_numpy(zero_copy_only=False)
            blobs = [
                doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                np.packbits(null).tobytes(),
                sizes.astype("<u4").tobytes(),
                rules.astype("<u4").tobytes(),
                expansions.astype("<u4").tobytes(),
                _three_bytes(sequence),
            ]
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(sizes)], pa.int32()), pa.array([len(ids)])]
            seq, n = seq + 1, 0
            held_ids.clear(), held_docs.clear(), held_sizes.clear()
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([b], pa.binary()) for b in blobs]], names=_NAMES)

        for batch in batches:
            texts, doc_ids = common.as_one(batch.column(1)), batch.column(0)
            for a, b in common.slices_by_bytes(texts, block_bytes):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                # the end id after each document
                ends = np.cumsum(sizes)
                ids, sizes = np.insert(ids, ends, end_id), sizes + 1
                ends = np.cumsum(sizes)
                low = 0
                while low < len(sizes):
                    done = int(ends[low - 1]) if low else 0
                    high = max(low + 1, int(np.searchsorted(ends, done + shard_ids - n, side="right")))
                    held_ids.append(ids[done : int(ends[high - 1])])
                    held_sizes.append(sizes[low:high])
                    held_docs.append(doc_ids.slice(a + low, high - low))
                    n += int(ends[high - 1]) - done
                    low = high
                    if n >= shard_ids or low < len(sizes):
                        yield flush()
        if n:
            yield flush()

    rows.mapInArrow(run, SHARD).write.mode("overwrite").option("compression", "zstd").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): the number of ids in all shards before each one.

    Shards are summed within their part, then parts; a part is what one task
    wrote, so no window holds more rows than tasks or a task's shards.
    """
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return sizes.join(parts, F.col("part") == F.col("__part")).select("part", "seq", (F.col("part_base") + F.col("in_part")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file."""
    shards = spark.read.parquet(path)
    schema = "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                n = row["n_docs"]
                raw = np.frombuffer(row["sequence"], np.uint8).reshape(-1, 3).astype(np.int64)
                grammar = Grammar(
                    np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2),
                    np.frombuffer(row["expansions"], "<u4").astype(np.int64),
                    raw[:, 0] | (raw[:, 1] << 8) | (raw[:, 2] << 16),
                )
                sizes = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                ids = grammar.decode(0, row["n_ids"]).astype("<u4")
                crc = [zlib.crc32(ids[a : a + s]) for a, s in zip(starts.tolist(), sizes.tolist())]
                null = np.unpackbits(np.frombuffer(row["doc_null"], np.uint8))[:n].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"], np.int32)),
                        pa.array(np.full(n, row["seq"], np.int32)),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    found = shards.mapInArrow(run, schema)
    return found.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op1_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{common.shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(common.read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path)
