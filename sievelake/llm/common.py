"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: The column that holds a table's other columns while an operator works.
REST = "__rest"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (``local[...]``, as in tests)
    gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sievelake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    """``key`` of the session is ``value`` meanwhile, for queries that also run meanwhile."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame, release: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    ``release``: the files that were shuffled for it are removed at once, not when the
    driver happens to collect its garbage.
    """
    shared_folder(df.sparkSession)
    if release:
        with setting(df.sparkSession, _CLEANUP, "true"):
            return df.select("*").checkpoint(eager=True)  # planned anew, under the setting
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: str = "4m"):
    """Python gets Arrow batches of about ``most`` bytes, or one wider row.  A batch is held
    several times over by the executor and by its worker, which keep that memory."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def held_apart(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``docs`` with the columns ``keep`` and one struct of all others, so that no
    name of theirs meets those that an operator gives."""
    rest = [c for c in docs.columns if c not in keep]
    return docs.select(*keep, (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)).alias(REST))


def put_back(found: DataFrame, docs: DataFrame, keep: Sequence[str], **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, after ``held_apart``; ``changed`` replaces
    some of those that were held."""
    columns = []
    for c in docs.columns:
        columns.append(changed[c].alias(c) if c in changed else F.col(c) if c in keep else F.col(REST)[c].alias(c))
    return found.select(*columns)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_one(column) -> pa.Array:
    """An Arrow column of a batch as one array with 32-bit offsets and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all ``texts``: (codes, count per text, distinct words).

    ``codes`` holds for every word, in order, its place in the distinct words.
    """
    split = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    owner = np.repeat(np.arange(len(texts)), lengths)
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py():  # blanks at either end leave empty strings
        owner = owner[full.to_numpy(zero_copy_only=False)]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, np.bincount(owner, minlength=len(texts)).astype(np.int64), coded.dictionary


def slices_by_bytes(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text is alone."""
    if not len(texts):
        return []
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    edges = np.flatnonzero(np.diff(sizes // most)) + 1
    edges = [0, *edges.tolist(), len(texts)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every slice, one slice after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    kind = np.int32 if total + int(np.abs(starts).max()) < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat(shift.astype(kind), lengths)


def rank_in_cells(df: DataFrame, group: list[str], cell: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with the 1-based rank of each row in its group, as a long column.

    Rows of a group are ranked by ``cell``, then ``order``.  A group is never
    gathered: rows are dealt out by (group, cell), ranked there, and shifted by
    the number of rows in the group's earlier cells, which one small aggregate
    gives.  Choose cells so that none holds a large share of the rows.
    """
    from pyspark.sql import Window

    keys = [*group, *cell]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cell_rows"))
    before = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.coalesce(F.sum("__cell_rows").over(before), F.lit(0)).alias("__cell_base"))
    ranked = df.withColumn("__cell_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__c_{k}"))
        same = one if same is None else same & one
    joined = ranked.join(counts, same, "left")
    return joined.withColumn(out, (F.col("__cell_base") + F.col("__cell_rank")).cast("long")).drop("__cell_rank", "__cell_base", *[f"__c_{k}" for k in keys])


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct ``size``-word shingles.

    A-Z are lower-cased; a text of fewer words has one shingle of them all, a
    text without words none.
    """
    codes, counts, words = words_of(pc.ascii_lower(texts))
    if not len(codes):
        return [np.zeros(0, np.uint64)] * len(texts)
    h = word_hashes(words)[codes]
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        rolled += h[i : i + len(rolled)] * _ODD[i]
    rolled = hash_mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            part = np.sort(rolled[at : at + n - size + 1])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            out.append(part)
        elif n:
            with np.errstate(over="ignore"):
                out.append(hash_mix(np.array([(h[at : at + n] * _ODD[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64) ^ _ODD[7]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    pa.default_memory_pool().release_unused()  # else a worker keeps the most it ever needed
    return out
