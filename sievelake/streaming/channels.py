"""A source of log lines and a sink of notifications, as Python data sources.

``logs`` reads the lines of files that grow in a folder, in batches of a bounded
size; ``topics`` writes messages by topic, each batch once.  Both reach their
files through ``pyarrow.fs``, so a path may name any store that it knows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from .events import LOG

#: Bytes looked through at a time for the end of a line.
STEP = 1 << 16


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))
    return fs, at.rstrip("/")


def _names(fs: pafs.FileSystem, folder: str) -> dict[str, int]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))}


def line_end(f, start: int, wanted: int, size: int) -> int:
    """The end of the last whole line up to ``wanted``; if the first line goes on
    beyond, its end; ``start`` if it has none yet."""
    at = min(wanted, size)
    while at > start:
        low = max(start, at - STEP)
        f.seek(low)
        cut = f.read(at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    at = min(wanted, size)
    while at < size:
        f.seek(at)
        cut = (part := f.read(min(STEP, size - at))).find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(part)
    return start


@dataclass
class Lines(InputPartition):
    """Lines of a file that begin in [first, last); ``start`` is where the batch begins."""

    path: str
    start: int
    first: int
    last: int


class LogReader(DataSourceStreamReader):
    """An offset is ``done``, the last name of which all is read, and the bytes read
    of each file after it; only the newest ``openFiles`` files may still grow."""

    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("maxBytesPerTrigger", 1 << 30))
        self.split = int(options.get("splitBytes", 64 << 20))
        self.open_files = int(options.get("openFiles", 64))
        self.position = options.get("position")
        self.planned: dict | None = None

    def initialOffset(self) -> dict:
        self.planned = {"done": "", "open": {}}
        return self.planned

    def _planned(self) -> dict | None:
        """The end of the last planned batch, which the next begins at.  A query that
        starts again finds it in the ``position`` file."""
        if self.planned is None and self.position:
            fs, at = _store(self.position)
            if fs.get_file_info(at).type == pafs.FileType.File:
                with fs.open_input_stream(at) as f:
                    self.planned = json.loads(f.read())
        return self.planned

    def latestOffset(self) -> dict:
        fs, folder = _store(self.path)
        before = self._planned()
        left = self.most if before is not None else None  # from an unknown start all is taken
        done, held = (before["done"], before["open"]) if before else ("", {})
        names = {n: s for n, s in _names(fs, folder).items() if n > done}
        ends, finished = {}, {}
        for n in sorted(names):
            start, size = held.get(n, 0), names[n]
            wanted = size if left is None else min(size, start + max(0, left))
            with fs.open_input_file(f"{folder}/{n}") as f:
                ends[n] = line_end(f, start, wanted, size) if wanted > start else start
            finished[n] = ends[n] == size
            if left is not None:
                left -= ends[n] - start
        for n in sorted(names)[: max(0, len(names) - self.open_files)]:
            if not finished[n]:
                break
            done = n
        return {"done": done, "open": {n: e for n, e in ends.items() if n > done}, "sizes": {n: ends[n] for n in ends if n <= done}}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.planned = {"done": end["done"], "open": end["open"]}
        if self.position:
            fs, at = _store(self.position)
            fs.create_dir(posixpath.dirname(at), recursive=True)
            with fs.open_output_stream(at + ".new") as f:
                f.write(json.dumps(self.planned).encode())
            fs.move(at + ".new", at)
        out = []
        for n, last in sorted({**end.get("sizes", {}), **end["open"]}.items()):
            first = start["open"].get(n, 0)
            if n > start["done"] and last > first:
                out += [Lines(n, first, a, min(a + self.split, last)) for a in range(first, last, self.split)]
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(self.path)
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string())])
        with fs.open_input_file(f"{folder}/{partition.path}") as f:
            at = partition.first
            if at > partition.start:  # a line that began before belongs to the part before
                f.seek(at - 1)
                at += len(_line(f)) - 1
            f.seek(at)
            places, lines, held = [], [], 0
            while at < partition.last:
                line = _line(f)
                if not line:
                    break
                places.append(at)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)
                held += len(line)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], schema=schema)
                    places, lines, held = [], [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], schema=schema)


def _line(f) -> bytes:
    """One line with its end; the file's place moves behind it."""
    start, parts = f.tell(), []
    while True:
        part = f.read(STEP)
        cut = part.find(b"\n")
        if cut >= 0 or not part:
            parts.append(part[: cut + 1])
            break
        parts.append(part)
    line = b"".join(parts)
    f.seek(start + len(line))
    return line


class TopicWriter(DataSourceStreamWriter):
    """Files of a batch are written aside and named by the batch when it commits."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        fs, root = _store(self.path)
        open_files: dict[str, tuple[str, object]] = {}
        try:
            for row in iterator:
                if row["topic"] not in open_files:
                    fs.create_dir(f"{root}/_new", recursive=True)
                    name = f"{root}/_new/{uuid.uuid4().hex}"
                    open_files[row["topic"]] = (name, fs.open_output_stream(name))
                open_files[row["topic"]][1].write((json.dumps(row.asDict(), default=str, ensure_ascii=False) + "\n").encode())
        finally:
            for _, f in open_files.values():
                f.close()
        return Written([(topic, name) for topic, (name, _) in open_files.items()])

    def commit(self, messages, batchId: int) -> None:
        fs, root = _store(self.path)
        marker = f"{root}/_batches/{batchId:020d}"
        files = [f for m in messages if m is not None for f in m.files]
        if fs.get_file_info(marker).type == pafs.FileType.File:  # committed before
            for _, name in files:
                fs.delete_file(name)
            return
        stale = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        for f in stale:  # of a commit that did not end
            if f.base_name.startswith(f"batch-{batchId:020d}-"):
                fs.delete_file(f.path)
        for i, (topic, name) in enumerate(files):
            fs.create_dir(f"{root}/topic={topic}", recursive=True)
            fs.move(name, f"{root}/topic={topic}/batch-{batchId:020d}-{i:05d}.json")
        fs.create_dir(f"{root}/_batches", recursive=True)
        with fs.open_output_stream(marker) as f:
            f.write(b"")

    def abort(self, messages, batchId: int) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            for _, name in m.files if m is not None else ():
                fs.delete_file(name)


@dataclass
class Written(WriterCommitMessage):
    files: list


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logs"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema):
        return LogReader(self.options)


class TopicSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topics"

    def streamWriter(self, schema, overwrite):
        return TopicWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
    spark.dataSource.register(TopicSink)


def read_logs(spark: SparkSession, path: str, schema: str = LOG, **options) -> DataFrame:
    """A stream of logs, one JSON record a line, with ``file``, ``at``, ``line`` and
    the fields of ``schema``; lines that are no record have ``readable`` false.

    Options: ``maxBytesPerTrigger``, ``splitBytes``, ``openFiles`` and ``position``, a
    file beside the checkpoint that keeps what was planned, without which the first
    batch after a restart takes all there is.
    """
    register(spark)
    lines = spark.readStream.format("logs").options(**{k: str(v) for k, v in options.items()}).load(path)
    # a field more than asked for holds what is no record
    parsed = F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("r", parsed)
    names = spark.createDataFrame([], schema).columns
    return rows.select("file", "at", "line", (F.col("r").isNotNull() & F.col("r._bad").isNull()).alias("readable"), *[F.col(f"r.`{c}`").alias(c) for c in names])


def split_dropped(logs: DataFrame, keep=None, topic: str = "parsing_dropped") -> tuple[DataFrame, DataFrame]:
    """(logs that are readable and meet ``keep``, messages about the others)."""
    good = F.col("readable") if keep is None else F.col("readable") & F.coalesce(keep, F.lit(False))
    why = F.when(~F.col("readable"), F.lit("not a record")).otherwise(F.lit("dropped"))
    message = F.to_json(F.struct(why.alias("error"), *[c for c in logs.columns if c not in ("readable", "line")], F.col("line")))
    return logs.filter(good).drop("readable"), logs.filter(~good).select(F.lit(topic).alias("topic"), message.alias("message"))


def write_topics(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start writing rows with a ``topic`` to a folder for each topic."""
    register(messages.sparkSession)
    return messages.writeStream.format("topics").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_topic(spark: SparkSession, path: str, topic: str, schema: str) -> DataFrame:
    """Messages of a topic, of committed batches alone."""
    fs, root = _store(path)
    batches = {f"batch-{n}-" for n in (f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/_batches", allow_not_found=True)))}
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/topic={topic}", allow_not_found=True)) if f.base_name[:27] in batches]
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)
