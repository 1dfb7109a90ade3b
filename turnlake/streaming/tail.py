"""Growing log files as a stream of lines.

The file source of Spark sees new files, not bytes appended to old ones.  This
source does: its offset is a map from file to the end of the file's last whole
line.  A micro-batch is, for each file, the bytes between two offsets, cut into
ranges that begin and end at lines.  A task reads one large range or many small
ones, so the number of tasks follows the bytes and cores, not the files.

* Bytes after the last line end are left until the line is complete.
* A file whose end moved back was truncated or replaced: it is read again from
  its top, and its first row says so (``restarts``), so that what was carried
  along the old content can be dropped.
* Which bytes a batch holds follows from its two offsets alone, so a batch that
  is repeated after a failure holds the same lines.

The offset lists every file, so keep the number of files of one query within
some ten thousands; finished logs belong to the batch readers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a task's range at most, of a block read at a time, lines of a batch handed on.
RANGE_BYTES, BLOCK_BYTES, BATCH_LINES = 64 << 20, 1 << 20, 10_000
#: Opening a file counts as so many bytes of a task; line ends of so many files are looked up at once.
FILE_BYTES, LOOKUPS = 256 << 10, 32
SUFFIX = ".jsonl"
SCHEMA = "log_id string, restarts boolean, pos bigint, line string"
_ARROW = pa.schema([("log_id", pa.string()), ("restarts", pa.bool_()), ("pos", pa.int64()), ("line", pa.string())])


def open_folder(path: str):
    """File system and path of a local folder or one named by URI."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def last_line_end(stream, size: int, block: int = BLOCK_BYTES) -> int:
    """Bytes up to and including the last line end of a file, 0 if it has none."""
    end = size
    while end > 0:
        begin = max(0, end - block)
        stream.seek(begin)
        at = stream.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


@dataclass
class LineRange(InputPartition):
    """Lines of a file that begin in ``[first, stop)``; ``begin`` is where the batch starts in it."""

    file: str
    begin: int
    first: int
    stop: int


def ranges(start: dict, end: dict, range_bytes: int = RANGE_BYTES) -> list[LineRange]:
    """The ranges between two offsets; a file that ends before its start is read from the top."""
    found = []
    for file, stop in sorted(end.items()):
        begin = start.get(file, 0)
        if stop < begin:
            begin = 0
        found += [LineRange(file, begin, at, min(at + range_bytes, stop)) for at in range(begin, stop, range_bytes)]
    return found


@dataclass
class RangeBundle(InputPartition):
    """What one task reads: ranges of one file or of many."""

    ranges: list[LineRange]


def bundles(found: list[LineRange], tasks: int, range_bytes: int = RANGE_BYTES) -> list[RangeBundle]:
    """Ranges in order, dealt to about ``tasks`` tasks or to as many more as ``range_bytes`` asks for."""
    cost = [r.stop - r.first + FILE_BYTES for r in found]
    most = min(-(-sum(cost) // max(tasks, 1)), range_bytes + FILE_BYTES)
    out: list[RangeBundle] = []
    held = most
    for part, n in zip(found, cost, strict=True):
        if held + n > most:
            out.append(RangeBundle([]))
            held = 0
        out[-1].ranges.append(part)
        held += n
    return out


def lines_in(stream, part: LineRange, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that begin in the range, without their ends."""
    at = part.first
    if at > part.begin:  # a line that began before belongs to the range before
        at -= 1
        stream.seek(at)
        while True:
            data = stream.read(block)
            if not data:
                return
            cut = data.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(data)
    stream.seek(at)
    rest: list[bytes] = []
    while at < part.stop:
        data = stream.read(block)
        if not data:
            return
        *whole, last = data.split(b"\n")
        for piece in whole:
            line = b"".join([*rest, piece])
            rest = []
            yield at, line
            at += len(line) + 1
            if at >= part.stop:
                return
        rest.append(last)


class TailReader(DataSourceStreamReader):
    """Reads what lies between two offsets; a new query starts at ``ends``."""

    def __init__(self, path: str, suffix: str, range_bytes: int, ends: dict | None, tasks: int = 1) -> None:
        self.path, self.suffix, self.range_bytes, self.ends, self.tasks = path, suffix, range_bytes, ends, tasks
        #: Size and last line end of the files seen before; saves reading those that did not change.
        self.known: dict[str, tuple[int, object, int]] = {}

    def current(self) -> dict:
        from pyarrow import fs

        system, folder = open_folder(self.path)
        infos = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        infos = [i for i in infos if i.type == fs.FileType.File and i.path.endswith(self.suffix)]

        def look(info) -> tuple[str, tuple]:
            file = info.path[len(folder.rstrip("/")) + 1 :]
            before = self.known.get(file)
            if before is None or before[:2] != (info.size, info.mtime_ns):
                with system.open_input_file(info.path) as stream:
                    before = (info.size, info.mtime_ns, last_line_end(stream, info.size))
            return file, before

        with ThreadPoolExecutor(LOOKUPS) as pool:  # these wait for the store, not for each other
            self.known = dict(pool.map(look, infos))
        return {file: end for file, (_, _, end) in self.known.items()}

    def initialOffset(self) -> dict:
        return self.ends or {}

    def latestOffset(self) -> dict:
        return self.current()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return bundles(ranges(start, end, self.range_bytes), self.tasks, self.range_bytes)

    def read(self, partition: RangeBundle) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(partition):
            rows.append(row)
            if len(rows) >= BATCH_LINES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def _rows(self, partition: RangeBundle) -> Iterator[tuple]:
        system, folder = open_folder(self.path)
        for part in partition.ranges:
            restarts = part.first == 0
            try:
                stream = system.open_input_file(f"{folder.rstrip('/')}/{part.file}")
            except FileNotFoundError:  # gone since it was listed
                continue
            with stream:
                for pos, data in lines_in(stream, part):
                    try:
                        line = data.decode().rstrip("\r")
                    except UnicodeDecodeError:
                        continue
                    if not line and not restarts:
                        continue
                    yield part.file, restarts, pos, line
                    restarts = False


class HistoryReader(DataSourceReader):
    """The same lines as a batch: all up to ``ends``."""

    def __init__(self, tail: TailReader) -> None:
        self.tail = tail

    def partitions(self) -> Sequence[InputPartition]:
        return self.tail.partitions({}, self.tail.current() if self.tail.ends is None else self.tail.ends)

    def read(self, partition: RangeBundle | None) -> Iterator[pa.RecordBatch]:
        return self.tail.read(partition) if partition is not None else iter(())


class TailSource(DataSource):
    """Format ``tailed_logs`` with options ``path``, ``suffix``, ``rangeBytes``, ``tasks`` (at least) and ``ends``, an offset as JSON."""

    @classmethod
    def name(cls) -> str:
        return "tailed_logs"

    def schema(self) -> str:
        return SCHEMA

    def _reader(self) -> TailReader:
        o = self.options
        ends = json.loads(o["ends"]) if "ends" in o else None
        return TailReader(o["path"], o.get("suffix", SUFFIX), int(o.get("rangeBytes", RANGE_BYTES)), ends, int(o.get("tasks", 1)))

    def streamReader(self, schema) -> TailReader:
        return self._reader()

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self._reader())


def current_ends(path: str, suffix: str = SUFFIX) -> dict:
    """The end of the last whole line of every file below ``path``: what a history reaches up to."""
    return TailReader(path, suffix, RANGE_BYTES, None).current()


def stream_tailed_lines(
    spark: SparkSession, path: str, suffix: str = SUFFIX, ends: dict | None = None, capture_id: Column | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Lines appended to the files below ``path``: ``capture_id, log_id, chunk_no, pos, line, restarts``.

    ``log_id`` is the file's path below ``path``, ``pos`` the line's first byte.
    With ``ends`` (:func:`current_ends`) a new query starts behind them; a
    restarted one goes on where its checkpoint says.  Lines that are not UTF-8
    are passed over; the line that ``restarts`` may be empty.
    """
    return _lines(spark, spark.readStream, path, suffix, ends, capture_id, range_bytes)


def read_tailed_lines(
    spark: SparkSession, path: str, ends: dict | None = None, suffix: str = SUFFIX, capture_id: Column | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The same lines as a batch, up to ``ends``; by default all there are."""
    return _lines(spark, spark.read, path, suffix, ends, capture_id, range_bytes)


def _lines(spark, reader, path, suffix, ends, capture_id, range_bytes) -> DataFrame:
    spark.dataSource.register(TailSource)
    reader = reader.format("tailed_logs").option("path", path).option("suffix", suffix).option("rangeBytes", range_bytes)
    reader = reader.option("tasks", 2 * spark.sparkContext.defaultParallelism)
    raw = (reader if ends is None else reader.option("ends", json.dumps(ends))).load()
    tenant = capture_id if capture_id is not None else F.lit("local")
    return raw.select(tenant.alias("capture_id"), "log_id", F.lit(0).cast("bigint").alias("chunk_no"), "pos", "line", "restarts")
