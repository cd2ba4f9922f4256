"""A record log in shared files: topic partitions with offsets, read as a stream from either end, written with commits.

``segments/`` holds Parquet files of one topic partition each. A file under ``commits/`` makes segments part of the log: it
gives each its first offset, and the next offset of every partition. What no commit names does not exist, so a task that
fails or runs twice leaves no record behind.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

NAME = "record_log"
PARTITIONS = 6
ROWS_PER_SEGMENT = 100_000
STORED = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC"))])
RECORD = "key binary, value binary, timestamp timestamp, partition int, offset long"


class Log:
    """The files of one log; paths may be URIs."""

    def __init__(self, path: str) -> None:
        self.files, self.base = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")

    def commits(self) -> list[int]:
        """Numbers of the commits, from 1."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/commits", allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json"))

    def commit(self, number: int) -> dict:
        with self.files.open_input_stream(f"{self.base}/commits/{number:012d}.json") as f:
            return json.loads(f.read())

    def end(self) -> dict:
        """The last commit's number and the next offset of each partition."""
        found = self.commits()
        return {"commit": found[-1], "ends": self.commit(found[-1])["ends"]} if found else {"commit": 0, "ends": {}}

    def append(self, writer: str, batch: int, segments: list[tuple[int, int, str]]) -> bool:
        """One commit of segments (partition, rows, file); a batch that this writer has committed is not added again.

        The commit is written beside its place and moved there, so readers see all of it or none."""
        known = self.commits()
        now, ends = len(known) and known[-1], dict(self.commit(known[-1])["ends"]) if known else {}
        done = self.commit(now)["writers"] if known else {}
        if done.get(writer, -1) >= batch:
            return False
        named = []
        for partition, rows, file in segments:
            base = ends.get(str(partition), 0)
            named.append({"partition": partition, "base": base, "rows": rows, "file": file})
            ends[str(partition)] = base + rows
        body = json.dumps({"segments": named, "ends": ends, "writers": {**done, writer: batch}}).encode()
        self.files.create_dir(f"{self.base}/commits", recursive=True)
        beside = f"{self.base}/commits/{now + 1:012d}.{uuid.uuid4().hex}.part"
        with self.files.open_output_stream(beside) as f:
            f.write(body)
        self.files.move(beside, f"{self.base}/commits/{now + 1:012d}.json")
        return True

    def put(self, table: pa.Table) -> str:
        self.files.create_dir(f"{self.base}/segments", recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        pq.write_table(table, f"{self.base}/segments/{name}", filesystem=self.files)
        return name


@dataclass
class Segments(InputPartition):
    """The segments of one topic partition that one task reads: (file, first offset)."""

    partition: int
    files: list[tuple[str, int]]


def segments_between(log: Log, after: int, upto: int) -> list[Segments]:
    own: dict[int, list[tuple[str, int]]] = {}
    for number in range(after + 1, upto + 1):
        for s in log.commit(number)["segments"]:
            own.setdefault(s["partition"], []).append((s["file"], s["base"]))
    return [Segments(p, files) for p, files in sorted(own.items())]


def records(path: str, part: Segments | None) -> Iterator[pa.RecordBatch]:
    """The records of a topic partition's segments; Spark reads a log without any by one task that has none."""
    log = Log(path)
    for name, base in part.files if part else ():
        at = base
        with log.files.open_input_file(f"{log.base}/segments/{name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(10_000):
                n = batch.num_rows
                more = [pa.array([part.partition] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*STORED.names, "partition", "offset"])
                at += n


class LogReader(DataSourceReader):
    """All that is committed when the query is planned."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Segments]:
        log = Log(self.path)
        return segments_between(log, 0, log.end()["commit"])

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition)


class LogStream(DataSourceStreamReader):
    """From the first record (``earliest``) or from what comes after the start (``latest``); an offset is a commit and the
    next offset of each topic partition."""

    def __init__(self, path: str, starting: str) -> None:
        self.path, self.starting = path, starting

    def initialOffset(self) -> dict:
        return Log(self.path).end() if self.starting == "latest" else {"commit": 0, "ends": {}}

    def latestOffset(self) -> dict:
        return Log(self.path).end()

    def partitions(self, start: dict, end: dict) -> list[Segments]:
        return segments_between(Log(self.path), start["commit"], end["commit"])

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    segments: list[tuple[int, int, str]]


class Appender:
    """What batch and stream writers share: rows go to the partition of their key's CRC-32, in segments of limited size."""

    def __init__(self, path: str, partitions: int, writer: str) -> None:
        self.path, self.partitions, self.writer = path, partitions, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        log, held, out = Log(self.path), {}, []

        def flush(partition: int) -> None:
            table = pa.Table.from_batches(held.pop(partition)).cast(STORED)
            out.append((partition, table.num_rows, log.put(table)))

        for batch in iterator:
            batch = batch.select(STORED.names)
            where = [zlib.crc32(k) % self.partitions if k is not None else 0 for k in batch.column("key").to_pylist()]
            for partition in sorted(set(where)):
                held.setdefault(partition, []).append(batch.filter(pa.array([w == partition for w in where])))
                if sum(b.num_rows for b in held[partition]) >= ROWS_PER_SEGMENT:
                    flush(partition)
        for partition in sorted(held):
            flush(partition)
        return Written(out)

    def add(self, messages: list, batch: int) -> None:
        segments = [s for m in messages if m is not None for s in m.segments]
        if segments:
            Log(self.path).append(self.writer, batch, segments)


class LogBatchWriter(DataSourceArrowWriter, Appender):
    __init__ = Appender.__init__
    write = Appender.write

    def commit(self, messages: list) -> None:
        self.add(messages, 0)


class LogStreamWriter(DataSourceStreamArrowWriter, Appender):
    __init__ = Appender.__init__
    write = Appender.write

    def commit(self, messages: list, batchId: int) -> None:
        self.add(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        pass


class RecordLog(DataSource):
    """Options: ``path``; reading ``starting`` (earliest or latest); writing ``partitions`` and ``writer``, which names a
    stream so that a batch it repeats is not added twice."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options["path"], self.options.get("starting", "latest"))

    def writer(self, schema, overwrite: bool) -> LogBatchWriter:
        if overwrite:
            raise ValueError("a record log is only appended to")
        return LogBatchWriter(self.options["path"], int(self.options.get("partitions", PARTITIONS)), f"batch-{uuid.uuid4().hex}")

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self.options["path"], int(self.options.get("partitions", PARTITIONS)), self.options.get("writer", "stream"))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; once is enough. Spark knows a Python format in the session that registered it
    first only, so use that one for all logs of an application."""
    try:
        spark.dataSource.register(RecordLog)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def as_records(df: DataFrame) -> DataFrame:
    stamp = F.col("timestamp") if "timestamp" in df.columns else F.current_timestamp()
    return df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), stamp.cast("timestamp").alias("timestamp"))


def append(df: DataFrame, path: str, partitions: int = PARTITIONS) -> None:
    """Adds ``df(key, value[, timestamp])`` in one commit."""
    register(df.sparkSession)
    as_records(df).write.format(NAME).mode("append").option("path", path).option("partitions", partitions).save()


def read_stream(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    """``key``, ``value``, ``timestamp``, ``partition`` and ``offset`` of the records, from ``earliest`` or ``latest`` on."""
    register(spark)
    return spark.readStream.format(NAME).option("path", path).option("starting", starting).load()


def write_stream(df: DataFrame, path: str, checkpoint: str, writer: str, partitions: int = PARTITIONS, **trigger):
    """Appends a stream, each micro-batch once, also if it is run again after a restart."""
    register(df.sparkSession)
    out = as_records(df).writeStream.format(NAME).option("path", path).option("partitions", partitions).option("writer", writer)
    return out.option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
