"""The partitioned log as a Spark data source that is driven by offsets, in batches and as a stream.

The log is Parquet in folders ``partition=N``, each file sorted by offset (``write_partitioned``). Where a file begins
and ends is in its footer, so the driver reads no records to know how far a partition reaches, and every footer once.
A stream's position is the next offset of each partition. Spark keeps it in the query's checkpoint: a query that was
stopped goes on where it was, and a batch that runs again reads the same offsets.

A partition reaches as far as its offsets follow on each other. The files of one append become visible one by one, and
a later one must not carry the position past an earlier one, so a gap holds a partition until it is filled. A
partition must begin at its starting offset. For a log that does have holes, ``gaps="skip"`` takes what there is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.streaming import StreamingQuery

from chatledger import schemas as S

FORMAT = "chatledger_log"

#: Bytes (before compression) one task reads at most, unless a row group is larger.
SLICE_BYTES = 128 << 20


def write_partitioned(records: DataFrame, path: str) -> None:
    """Append raw records in the layout of the source. A partition spreads over as many files as the sort gives it."""
    ranged = records.select(*S.RECORD.fieldNames()).repartitionByRange("partition", "offset")
    ranged.sortWithinPartitions("partition", "offset").write.mode("append").partitionBy("partition").parquet(path)


@dataclass(frozen=True)
class Group:
    """A row group of a file: its offsets ``[first, end)`` and its size."""

    number: int
    first: int
    end: int
    size: int


@dataclass
class Slice(InputPartition):
    """What one task reads: row groups of a file, and of them the offsets ``[start, end)``."""

    path: str
    partition: int
    groups: list[int]
    start: int
    end: int


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (``hdfs://``, ``s3://``, ``file:/``) or of a local path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class LogFiles:
    """The files of a log by partition, and where each begins and ends."""

    def __init__(self, path: str, gaps: str) -> None:
        if gaps not in ("hold", "skip"):
            raise ValueError(f"gaps must be hold or skip, not {gaps!r}")
        self.path, self.skip = path, gaps == "skip"
        self.known: dict[str, tuple[int, list[Group]]] = {}

    def __getstate__(self) -> dict:
        """Tasks get their slices and need no footers."""
        return self.__dict__ | {"known": {}}

    def look(self) -> dict[int, list[tuple[str, Group]]]:
        """Row groups per partition by first offset; only footers of files not seen before are read."""
        system, root = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = {}
        for info in found:
            folder, _, name = info.path.rpartition("/")
            folder = folder.rpartition("/")[2]
            if info.is_file and name.endswith(".parquet") and name[0] not in "._" and folder.startswith("partition="):
                if folder[10:].isdigit():
                    files[info.path] = int(folder[10:])
        new = [path for path in files if path not in self.known]
        with ThreadPoolExecutor(16) as pool:
            for path, groups in zip(new, pool.map(lambda p: self._footer(system, p), new), strict=True):
                self.known[path] = files[path], groups
        out: dict[int, list[tuple[str, Group]]] = {}
        for path, partition in files.items():
            out.setdefault(partition, []).extend((path, group) for group in self.known[path][1])
        for groups in out.values():
            groups.sort(key=lambda g: (g[1].first, g[1].end, g[0]))
        return out

    @staticmethod
    def _footer(system: fs.FileSystem, path: str) -> list[Group]:
        with system.open_input_file(path) as file:
            footer = pq.ParquetFile(file).metadata
        place, out = footer.schema.names.index("offset"), []
        for i in range(footer.num_row_groups):
            rows = footer.row_group(i)
            seen = rows.column(place).statistics
            if rows.num_rows and (seen is None or not seen.has_min_max or seen.null_count):
                raise ValueError(f"no bounds of offsets in the footer of {path}, or records without an offset")
            if rows.num_rows:
                out.append(Group(i, seen.min, seen.max + 1, rows.total_byte_size))
        return out

    def reach(self, groups: list[tuple[str, Group]], start: int) -> int:
        """How far offsets follow on each other from ``start`` on (or, where gaps are skipped, reach at all)."""
        for _, group in groups:
            if group.first > start and not self.skip:
                break
            start = max(start, group.end)
        return start


class LogReader:
    """What batches and streams share: options, ends of partitions, slices and reading them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files = LogFiles(options["path"], options.get("gaps", "hold"))
        self.starting = {int(k): int(v) for k, v in json.loads(options.get("starting", "{}")).items()}
        ending = options.get("ending")
        self.ending = None if ending is None else {int(k): int(v) for k, v in json.loads(ending).items()}

    def first(self) -> dict[str, int]:
        return {str(p): at for p, at in self.starting.items()}

    def newest(self) -> dict[str, int]:
        out = {}
        for partition, groups in sorted(self.files.look().items()):
            start = self.starting.get(partition, 0)
            if self.ending is None or partition in self.ending:
                if groups[0][1].first > start and not self.files.skip:
                    # Said here, before the stream notes a position that lies behind its own.
                    raise ValueError(f"partition {partition} begins at {groups[0][1].first}, not at {start}: name its "
                                     "starting offset where old files were removed, or run again if files are still to come")
                reach = self.files.reach(groups, start)
                out[str(partition)] = reach if self.ending is None else max(start, min(reach, self.ending[partition]))
        return self.first() | out

    def slices(self, start: dict[str, int], end: dict[str, int]) -> list[Slice]:
        files, out = self.files.look(), []
        for key, until in end.items():
            partition = int(key)
            since = start.get(key, self.starting.get(partition, 0))
            if since >= until:
                continue
            groups = files.get(partition, [])
            if self.files.reach(groups, since) < until:
                raise ValueError(f"partition {partition} of the log no longer holds the offsets {since} to {until}")
            size, last = 0, None
            for path, group in sorted(groups, key=lambda g: (g[0], g[1].number)):
                if group.first >= until or group.end <= since:
                    continue
                if path != last or size + group.size > SLICE_BYTES:
                    out.append(Slice(path=path, partition=partition, groups=[], start=since, end=until))
                    size = 0
                out[-1].groups.append(group.number)
                size, last = size + group.size, path
        return out

    def rows(self, part: Slice) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.files.path)
        with system.open_input_file(part.path) as file:
            columns = ["offset", "key", "headers", "value"]
            for batch in pq.ParquetFile(file).iter_batches(8192, row_groups=part.groups, columns=columns):
                offset = batch.column("offset")
                inside = pc.and_(pc.greater_equal(offset, part.start), pc.less(offset, part.end))
                batch = batch.filter(inside)
                if batch.num_rows:
                    place = pa.array([part.partition] * batch.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [place, *[batch.column(c) for c in columns]], ["partition", *columns])


class LogBatch(LogReader, DataSourceReader):
    """All records from the starting to the ending offsets."""

    def partitions(self) -> list[Slice]:
        return self.slices(self.first(), self.newest())

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if isinstance(partition, Slice) else iter(())


class LogStream(LogReader, DataSourceStreamReader):
    """The log as it grows. A partition that appears later is read from its starting offset, else from 0."""

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return self.first()

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        return self.newest()

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Slice]:
        return self.slices(start, end)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class LogSource(DataSource):
    """The format ``chatledger_log``, with the options of ``scan_partitioned``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return S.RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogBatch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogStream(self.options)


def scan_partitioned(
    spark: SparkSession, path: str, *, stream: bool = False, starting: dict[int, int] | None = None,
    ending: dict[int, int] | None = None, gaps: str = "hold",
) -> DataFrame:
    """Raw records of a partitioned log, as a batch or a stream. Give a stream that goes on no earlier ends than before,
    and name all partitions it has read: where it must step back, it reads records once more later (none is lost;
    ``dedup`` and the refresh tell them by their offsets).

    ``starting`` gives the first offset of partitions that don't begin at 0, ``ending`` one past the last offset of each
    partition; partitions it doesn't name are left out then. A stream with ``ending`` stops getting records there. A
    log without files is empty.
    """
    spark.dataSource.register(LogSource)
    reader = (spark.readStream if stream else spark.read).format(FORMAT).option("gaps", gaps)
    if starting is not None:
        reader = reader.option("starting", json.dumps(starting))
    if ending is not None:
        reader = reader.option("ending", json.dumps(ending))
    return reader.load(path)


def as_offsets(ends: DataFrame) -> dict[int, int]:
    """The snapshot of ``log.end_offsets`` for ``ending``: one row per partition."""
    return {row.partition: row.end_offset for row in ends.select("partition", "end_offset").collect()}


def committed_offsets(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """``partition`` and ``committed`` (the next offset) as of the last batch a query has finished; one row per partition
    it has come to, none before its first batch."""
    progress = query.lastProgress
    position = json.loads(progress.json)["sources"][0]["endOffset"] if progress else None
    position = json.loads(position) if isinstance(position, str) else position or {}
    return spark.createDataFrame([(int(k), v) for k, v in position.items()], "partition int, committed bigint")


def applied_ends(applied: DataFrame) -> DataFrame:
    """``partition`` and ``committed`` from the applied offsets that a refresh stores, also when no query runs."""
    return applied.groupBy("partition").agg(F.max("to_offset").alias("committed"))
