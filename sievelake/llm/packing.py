"""Packing into optimal length buckets.

Texts are encoded once, in one scan; their ids are kept in a table in the shared
folder, from which only the lengths are read for the next two steps.  The
histogram of lengths over all documents is gathered, dynamic programming picks
the bucket boundaries that pad least, and batches of a fixed token budget form
inside each bucket: a bucket of padded length L takes ``budget // L`` documents a
batch.  Each batch is written as one matrix of ids with its padding and mask.

Only the histogram reaches the driver.  With at most ``most_lengths`` distinct
lengths it is exact, and so are the boundaries, however long a document is.  With
more, lengths are rounded up in proportion to themselves, to the most leading bits
that leave at most ``most_lengths`` steps: short ones stay exact.

File format: a Parquet folder with a row per batch (``BATCH``).  ``ids`` holds
n_rows * bucket_len little-endian unsigned 32-bit numbers, row after row, filled
up with the padding id; ``mask`` a bit for each of them, 1 where it is an id of
the text.

Defined results: a null text has length 0 and is put in the first bucket; a
document longer than the budget fills batches of its own; equal lengths are
ordered by a digest of the row; repeated rows are packed each; a very long text is
one row of one batch, held whole; an empty table gives an empty result.  Input
columns named like an output column are replaced.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .mixing import salt
from .token_files import encoder_for

BATCH = "bucket int, batch long, bucket_len long, n_rows int, ids binary, mask binary"
PLACED = "n_tokens long, bucket int, bucket_len long, batch long, row_in_batch long, padding long, ids_crc32 long"
#: Whether a row's batch is of its cell alone.
WHOLE = "in__cell"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Compressed bytes of a row group of batches, which a reader holds unpacked.
_GROUP = 8 << 20


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding.

    ``lengths`` ascend.  A bucket over places i+1..j costs the padding of all its
    documents to ``lengths[j]``.  The cost has the quadrangle inequality, so each
    layer is filled by divide and conquer, a level of the recursion at a time.
    """
    n = len(lengths)
    if n == 0:
        return []
    lengths = lengths.astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])

    def cost(i, j):  # a bucket of places i..j-1
        return (total[j] - total[i]) * lengths[j - 1] - (tokens[j] - tokens[i])

    best = cost(np.zeros(n, np.int64), np.arange(1, n + 1))
    best = np.concatenate([[0.0], best])
    choices = []
    for _ in range(1, min(buckets, n)):
        new, choice = best.copy(), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(first, min(mid - 1, last) + 1)
            values = best[i] + cost(i, np.full(len(i), mid))
            at = int(np.argmin(values))
            new[mid], choice[mid] = values[at], i[at]
            todo += [(low, mid - 1, first, int(i[at])), (mid + 1, high, int(i[at]), last)]
        choices.append(choice)
        best = new
    ends, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        ends.append(j)
        j = int(choice[j])
    if j > 0:
        ends.append(j)
    return sorted({int(lengths[e - 1]) for e in ends})


def length_histogram(sized: DataFrame, most_lengths: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(lengths, counts, leading bits kept): at most ``most_lengths`` rows come back,
    of exact lengths (None) if there are no more distinct ones."""
    exact = common.checkpoint(sized.groupBy("n_tokens").count())
    kept = None
    if exact.count() > most_lengths:
        # a step for each pattern of the leading bits
        n = F.col("n_tokens")
        width = F.length(F.bin(n))
        steps = lambda bits: F.pow(F.lit(2.0), F.greatest(width - bits, F.lit(0))).cast("long")
        rounded = lambda bits: F.ceil(n / steps(bits)).cast("long") * steps(bits)
        bits = list(range(1, 17))
        sizes = exact.agg(*[F.countDistinct(rounded(F.lit(b))).alias(str(b)) for b in bits]).first()
        kept = max((b for b in bits if sizes[str(b)] <= most_lengths), default=1)
        exact = exact.groupBy(rounded(F.lit(kept)).alias("n_tokens")).agg(F.sum("count").alias("count"))
    rows = exact.orderBy("n_tokens").collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), kept


def place(sized: DataFrame, buckets: int = 16, budget: int = 65_536, most_lengths: int = 65_536, cell_rows: int = 50_000) -> DataFrame:
    """``sized`` (doc_id, n_tokens and more) with bucket, bucket_len, batch,
    row_in_batch, padding and ``WHOLE``; ``batch`` counts from 0 within the bucket.

    A bucket is cut into cells of about ``cell_rows`` rows, which grow in number
    with the table.  A cell's rows, in order, fill batches of the cell's own
    (``WHOLE``); what is left over, less than a batch a cell, fills batches behind
    those, with what other cells leave.  Only counts of cells are needed for
    that, so the rows with all they carry are dealt out once.
    """
    lengths, counts, _ = length_histogram(sized.select("n_tokens"), most_lengths)
    ends = optimal_boundaries(lengths, counts, buckets) or [0]
    digits = 1
    while 16**digits * cell_rows < counts.sum() and digits < 8:
        digits += 1
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(i)) for i, e in enumerate(ends)])
    length = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    # ties end with a digest, so that rows dealt out anew after a lost executor stand the same
    digest = F.xxhash64(*[F.col(f"`{f.name}`") for f in sized.schema.fields if not isinstance(f.dataType, T.MapType)])
    keyed = sized.withColumn("bucket", bucket).withColumn("__cell", salt(F.col("doc_id"), digits))
    each = F.greatest(F.floor(F.lit(budget) / F.greatest(length, F.lit(1))), F.lit(1)).cast("long")
    cells = keyed.groupBy("bucket", "__cell").agg(F.count(F.lit(1)).alias("__n")).withColumn("bucket_len", length).withColumn("__each", each)
    cells = cells.withColumn("__full", F.floor(F.col("__n") / F.col("__each")).cast("long"))
    every = Window.partitionBy("bucket")
    before = every.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("__n") - F.col("__full") * F.col("__each")
    cells = cells.select("bucket", "__cell", "bucket_len", "__each", "__full", F.coalesce(F.sum("__full").over(before), F.lit(0)).alias("__own"), F.sum("__full").over(every).alias("__all"), F.coalesce(F.sum(rest).over(before), F.lit(0)).alias("__rest"))
    out = keyed.join(cells, ["bucket", "__cell"])
    order = Window.partitionBy("bucket", "__cell").orderBy("n_tokens", "doc_id", digest)
    out = out.withColumn("__at", F.row_number().over(order) - 1)
    whole = F.col("__at") < F.col("__full") * F.col("__each")
    left = F.col("__rest") + F.col("__at") - F.col("__full") * F.col("__each")
    rank = F.when(whole, F.col("__own") * F.col("__each") + F.col("__at")).otherwise(F.col("__all") * F.col("__each") + left)
    out = out.withColumn(WHOLE, whole).withColumn("__rank", rank)
    return out.select(
        *sized.columns,
        "bucket",
        "bucket_len",
        F.floor(F.col("__rank") / F.col("__each")).cast("long").alias("batch"),
        F.pmod(F.col("__rank"), F.col("__each")).cast("long").alias("row_in_batch"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        WHOLE,
    )


def id_kind(tokenizer: str) -> str:
    """How ids travel until they are in batches: in two bytes if all fit."""
    return "<u2" if len(encoder_for(tokenizer).word_end) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, block_bytes: int = 2_000_000) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_tokens and ids."""
    docs = docs.select("text", *[c for c in docs.columns if c != "text"])
    schema = T.StructType([*docs.schema.fields[1:], *T._parse_datatype_string("n_tokens long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in batches:
            texts = common.as_one(batch.column(0))
            for a, b in common.slices_by_bytes(texts, block_bytes):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                raw = ids.astype(id_kind(tokenizer))
                blobs = [raw[x:y].tobytes() for x, y in zip(edges, edges[1:])]
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(sizes.astype(np.int64)), pa.array(blobs, pa.binary())], names=[*rest.schema.names[1:], "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()  # once a task: a worker that waits keeps what it once needed

    return docs.mapInArrow(run, schema)


def write_batches(placed: DataFrame, path: str, pad_id: int, kind: str) -> None:
    """Write the rows of ``place``, with their ids of a ``kind``, as ``BATCH`` and an array for
    each further column.

    Batches of a cell form where its rows already are.  The rows left over are
    written beside them as they are, and only these few are dealt out once more.
    """
    spark = placed.sparkSession
    names = ["bucket", "batch", "row_in_batch", "bucket_len", "ids", WHOLE]
    extra = [f for f in placed.schema.fields if f.name not in (*names, "n_tokens", "padding")]
    schema = T.StructType([*T._parse_datatype_string(BATCH).fields, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in extra], T.StructField("__place", T.LongType()), T.StructField(WHOLE, T.BooleanType())])
    # ``place`` has sorted the rows by cell; those of a batch stand together
    rows = placed.select(*names, *[f.name for f in extra])
    made = rows.mapInArrow(_batches(schema, len(extra), pad_id, kind), schema)
    # both kinds have a file open, so that whole batches need no sort by kind
    with common.setting(spark, _WRITERS, 2):
        made.write.partitionBy(WHOLE).option("compression", "zstd").option("parquet.block.size", _GROUP).parquet(path)
    found = spark.read.schema(schema).parquet(path).filter(~F.col(WHOLE))
    left = found.select("bucket", "batch", F.col("__place").alias("row_in_batch"), "bucket_len", "ids", F.lit(True).alias(WHOLE), *[F.col(f"`{f.name}`")[0].alias(f.name) for f in extra])
    left = left.repartition("bucket", "batch").sortWithinPartitions("bucket", "batch", "row_in_batch")
    left.mapInArrow(_batches(schema, len(extra), pad_id, kind), schema).drop(WHOLE).write.mode("append").option("compression", "zstd").option("parquet.block.size", _GROUP).parquet(f"{path}/{WHOLE}=true")
    rest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{WHOLE}=false")
    rest.getFileSystem(spark._jsc.hadoopConfiguration()).delete(rest, True)


def _batches(schema: T.StructType, extra: int, pad_id: int, kind: str):
    """Consecutive rows of a batch as one row; rows that are left over each for itself,
    with their ids as they came and their place."""

    def row(part: pa.Table, ids: bytes, mask: bytes | None, place: int | None, whole: bool) -> pa.RecordBatch:
        n = part.num_rows
        one = [[part.column(0)[0].as_py()], [part.column(1)[0].as_py()], [part.column(3)[0].as_py()], [n], [ids], [mask]]
        columns = [pa.array(x, k) for x, k in zip(one, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(6 + i).combine_chunks()) for i in range(extra)]
        return pa.RecordBatch.from_arrays([*columns, *lists, pa.array([place], pa.int64()), pa.array([whole])], names=schema.fieldNames())

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks()
        width, blobs = part.column(3)[0].as_py(), part.column(4).to_pylist()
        table, mask = np.full((len(blobs), width), pad_id, "<u4"), np.zeros((len(blobs), width), bool)
        for i, blob in enumerate(blobs):
            ids = np.frombuffer(blob, kind)
            table[i, : len(ids)], mask[i, : len(ids)] = ids, True
        return row(part, table.tobytes(), np.packbits(mask).tobytes(), None, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            bucket, number, whole = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            changed = (bucket[1:] != bucket[:-1]) | (number[1:] != number[:-1]) | ~whole[1:] | ~whole[:-1]
            cuts = np.flatnonzero(changed) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b == a:
                    continue
                if parts and (not whole[a] or (bucket[a], number[a]) != current):
                    yield flush(parts)
                    parts = []
                if whole[a]:
                    current = (bucket[a], number[a])
                    parts.append(batch.slice(a, b - a))
                else:
                    part = pa.Table.from_batches([batch.slice(a, 1)])
                    yield row(part, part.column(4)[0].as_py(), None, part.column(2)[0].as_py(), False)
        if parts:
            yield flush(parts)

    return run


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the batches: its further columns and ``PLACED``."""
    stored = spark.read.parquet(path)
    extra = [f for f in stored.schema.fields if f.name not in ("__place", WHOLE, *[c.split()[0] for c in BATCH.split(", ")])]
    schema = T.StructType([*[T.StructField(f.name, f.dataType.elementType) for f in extra], *T._parse_datatype_string(PLACED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, number, width, n, ids, mask = [batch.column(j)[i].as_py() for j in range(6)]
                table = np.frombuffer(ids, "<u4").reshape(n, width)
                held = np.unpackbits(np.frombuffer(mask, np.uint8), count=n * width).reshape(n, width).astype(bool)
                sizes = held.sum(1)
                crc = [zlib.crc32(np.ascontiguousarray(table[r][held[r]])) for r in range(n)]
                same = [pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, width, np.int64)), pa.array(np.full(n, number, np.int64))]
                columns = [pa.array(sizes.astype(np.int64)), *same, pa.array(np.arange(n)), pa.array(width - sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*[batch.column(6 + j)[i].values for j in range(len(extra))], *columns], names=schema.fieldNames())

    return stored.select(*[c.split()[0] for c in BATCH.split(", ")], *[f.name for f in extra]).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, tokenizer: str, pad_id: int = 0, **options) -> DataFrame:
    """Encode ``docs`` (doc_id, text and more), write them as batches below ``path``
    and read them back: the columns of ``docs`` but ``text``, with ``PLACED``.

    ``options`` are those of ``place``.  What is read back is written to ``places``
    there, so that a batch's ids reach Python in small Arrow batches too, whatever
    the session says when the result is asked for.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c.split()[0] for c in PLACED.split(", ")], "ids", "mask", "n_rows")
    with common.small_batches(spark):
        encoded(docs, tokenizer).write.option("compression", "zstd").parquet(f"{path}/ids")
        placed = place(spark.read.parquet(f"{path}/ids"), **options)
        write_batches(placed, f"{path}/batches", pad_id, id_kind(tokenizer))
        places = read_batches(spark, f"{path}/batches")
        places.write.option("compression", "zstd").parquet(f"{path}/places")
    return spark.read.schema(places.schema).parquet(f"{path}/places")


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{common.shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    return pack(common.read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
