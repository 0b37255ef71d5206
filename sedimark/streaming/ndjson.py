"""A stream of lines from NDJSON files that still grow, read by byte ranges.

An offset is, for each file, the place after its last whole line: what stands behind
it is part of a line that has not been written out, waits, and comes with a later
batch. With the option ``final`` the trailing part counts as a line. A batch is cut
into ranges of about ``chunk_bytes``; a range has the lines that begin in it, read to
their ends, so no line is split and none is read twice. A line's end is the byte
0x0A, which is part of no other UTF-8 character, so cuts may fall anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 1 << 16


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def whole_lines(f, start: int, size: int) -> int:
    """The place after the last newline of ``f`` in [start, size); ``start`` if there is none."""
    end = size
    while end > start:
        begin = max(start, end - BLOCK)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def lines_of_range(f, begin: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [begin, stop); ``end`` is where the last of them ends at the latest."""
    at = begin
    if begin:  # the line that the byte before belongs to is another range's
        f.seek(begin - 1)
        held = f.read(min(BLOCK, end - begin + 1))
        at = begin - 1
        while held and (n := held.find(b"\n")) < 0:
            at += len(held)
            held = f.read(min(BLOCK, end - at))
        if not held:
            return
        at += n + 1
    f.seek(at)
    held, first = bytearray(), at
    while at < end and first < stop:
        part = f.read(min(BLOCK, end - at))
        if not part:
            break
        at += len(part)
        held += part
        while first < stop and (n := held.find(b"\n")) >= 0:
            yield first, bytes(held[:n])
            del held[: n + 1]
            first += n + 1
    if held and first < stop and at >= end:
        yield first, bytes(held)


@dataclass
class _Range(InputPartition):
    file: str
    begin: int
    stop: int
    end: int


class NdjsonBytes(DataSource):
    """The source ``ndjson_bytes`` of rows (file, place, line): ``path`` is a folder; names that begin with . or _ are passed over."""

    @classmethod
    def name(cls) -> str:
        return "ndjson_bytes"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        o = self.options
        return _Reader(o["path"], int(o.get("chunk_bytes", 1 << 26)), o.get("final", "false").lower() == "true")


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, chunk: int, final: bool) -> None:
        self.path, self.chunk, self.final = path, chunk, final
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = _store(self.path)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                with store.open_input_file(info.path) as f:
                    size = f.size()
                    self.known[info.base_name] = size if self.final else whole_lines(f, self.known.get(info.base_name, 0), size)
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = [(name, start.get(name, 0), stop) for name, stop in end.items() if stop > start.get(name, 0)]
        return [_Range(name, at, min(at + self.chunk, stop), stop) for name, begin, stop in ranges for at in range(begin, stop, self.chunk)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as f:
            for place, line in lines_of_range(f, partition.begin, partition.stop, partition.end):
                text = line.decode("utf-8", "replace").strip()
                if text:
                    yield partition.file, place, text

    def commit(self, end: dict) -> None:
        pass


def ndjson_lines(spark: SparkSession, path: str, chunk_bytes: int = 1 << 26, final: bool = False) -> DataFrame:
    """A stream of (file, place, line) of the files in ``path``."""
    spark.dataSource.register(NdjsonBytes)
    return spark.readStream.format("ndjson_bytes").option("path", path).option("chunk_bytes", str(chunk_bytes)).option("final", str(final).lower()).load()
