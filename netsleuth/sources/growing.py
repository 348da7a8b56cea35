"""Following one growing log file.

Spark's file source reads each file once, so lines that a sensor appends later
are never seen.  This streaming source remembers how far a file was read.  It
hands out byte ranges up to the last whole line, so a long backlog is read by
many tasks and a half-written line waits.  A file is known by its first bytes:
when the sensor starts a new file under the same name, the rest of the old one
is looked for among its rotated siblings and read before the new one.

Executors must see the file under the same path: a shared mount, or a store
that pyarrow opens by its URI.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 1024
RANGE_BYTES = 32 << 20
_STEP = 1 << 16


def _open(path: str):
    from pyarrow import fs
    store, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, p


class LogRange(InputPartition):
    """Lines of ``path`` that start in [start, stop)."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _size(path: str) -> int:
    store, p = _open(path)
    return store.get_file_info(p).size or 0


def _head(path: str, n: int) -> int:
    store, p = _open(path)
    with store.open_input_file(p) as f:
        return zlib.crc32(f.read_at(n, 0))


def _whole_lines(path: str, size: int) -> int:
    """Bytes up to and with the last line end."""
    store, p = _open(path)
    with store.open_input_file(p) as f:
        while size:
            n = min(_STEP, size)
            at = f.read_at(n, size - n).rfind(b"\n")
            if at >= 0:
                return size - n + at + 1
            size -= n
    return 0


class _Follower(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.from_end = options.get("startingposition", "end") == "end"
        self.lossy = options.get("failondataloss", "true").lower() == "false"

    def _offset(self, pos: int, size: int) -> dict:
        n = min(HEAD, size)
        return {"pos": pos, "head": n, "crc": _head(self.path, n) if n else 0}

    def initialOffset(self) -> dict:
        size = _size(self.path)
        return self._offset(_whole_lines(self.path, size) if self.from_end else 0, size)

    def latestOffset(self) -> dict:
        size = _size(self.path)
        return self._offset(_whole_lines(self.path, size), size)

    @staticmethod
    def _same(path: str, mark: dict, size: int) -> bool:
        """Whether ``path`` begins as the file of ``mark`` did."""
        return size >= max(mark["pos"], mark["head"]) and (not mark["head"] or _head(path, mark["head"]) == mark["crc"])

    def _rotated(self, mark: dict) -> list[tuple[str, int, int]]:
        """What is left of the file of ``mark`` under another name, and whole
        files that were rotated after it."""
        from pyarrow import fs
        store, p = _open(self.path)
        folder, name = p.rsplit("/", 1)
        prefix = self.path[:len(self.path) - len(name)]
        near = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name.startswith(name) and f.base_name != name]
        near.sort(key=lambda f: (f.mtime_ns or 0, f.base_name))
        for i, f in enumerate(near):
            if self._same(prefix + f.base_name, mark, f.size):
                return [(prefix + f.base_name, mark["pos"], f.size)] + [(prefix + g.base_name, 0, g.size) for g in near[i + 1:]]
        if mark["pos"] and not self.lossy:
            raise RuntimeError(f"{self.path} was replaced and its old lines behind byte {mark['pos']} cannot be found")
        return []

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        now = self._same(self.path, start, max(end["pos"], end["head"])) and start["pos"] <= end["pos"]
        parts = [(self.path, start["pos"], end["pos"])] if now else [*self._rotated(start), (self.path, 0, end["pos"])]
        return [LogRange(p, a, min(a + RANGE_BYTES, z)) for p, lo, z in parts for a in range(lo, z, RANGE_BYTES)]

    def read(self, partition: LogRange) -> Iterator[tuple]:
        """A line belongs to the range that its first byte lies in; the byte
        before the range tells whether one starts there."""
        store, p = _open(partition.path)
        with store.open_input_file(p) as f:
            size = f.size()
            at, rest = partition.start, b""
            skip = at > 0 and f.read_at(1, at - 1) != b"\n"
            begin = at                                     # where the line in ``rest`` starts
            while at < size:
                data = f.read_at(min(_STEP, size - at), at)
                at += len(data)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    if not skip:
                        if begin >= partition.stop:
                            return
                        yield (line.decode("utf-8", "replace"),)
                    skip = False
                    begin += len(line) + 1
                if begin >= partition.stop and not skip:
                    return
            if rest and not skip and begin < partition.stop:
                yield (rest.decode("utf-8", "replace"),)   # a rotated file's last line

    def commit(self, end: dict) -> None:
        pass


class GrowingLog(DataSource):
    """Format ``growing_log``: options ``path``, ``startingPosition`` ('end' as
    the reference does, or 'start'), ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follower({k.lower(): v for k, v in dict(self.options).items()})


def follow(spark: SparkSession, path: str, start: str = "end", lossy: bool = False) -> DataFrame:
    """Streaming ``(value)`` of the lines of one growing file."""
    spark.dataSource.register(GrowingLog)
    return (spark.readStream.format("growing_log").option("startingPosition", start).option("failOnDataLoss", str(not lossy).lower()).load(path))
