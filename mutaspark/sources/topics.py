"""Topic logs as one streaming source: topics by pattern, new ones found between batches, committed records only, and a place for each partition.

    spark.dataSource.register(TopicLog)
    spark.readStream.format("topic_log").option("path", folder).option("pattern", r"http\\.results\\..*").load()
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from mutaspark.schema import LOG


class Segment(NamedTuple):
    """A file of a partition's records with offsets from `first` to before `end`. stable: the first offset whose transaction is undecided, or the end."""

    file: str
    topic: str
    partition: int
    first: int
    end: int
    stable: int


@dataclass
class Piece(InputPartition):
    """What one task reads: offsets [start, stop) of a segment."""

    segment: Segment
    start: int
    stop: int


class Folder:
    """A log kept as Parquet files under topic=<name>/partition=<number>, in the columns of the log schema but those two. A record's `committed` is null while its transaction is open; its file is replaced when that is decided.

    Opened by Arrow, so on a file system that Arrow knows: a mounted one, HDFS or an object store.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], re.compile(options.get("pattern", ".*"))
        self.known: dict[tuple[str, int, int], Segment] = {}

    def files(self) -> pf.FileSystem:
        return pf.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def segments(self) -> list[Segment]:
        """All segments of matching topics. Only footers of files that weren't known, or have changed, are read; the undecided record column only where a footer counts nulls in it."""
        files, root = self.files()
        listed = files.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True))
        now = {}
        for info in listed:
            names = dict(x.split("=", 1) for x in posixpath.relpath(info.path, root).split("/")[:-1] if "=" in x)
            if info.type != pf.FileType.File or not info.path.endswith(".parquet") or not self.pattern.fullmatch(names.get("topic", "")) or posixpath.basename(info.path)[0] in "._":
                continue
            key = (info.path, info.size, info.mtime_ns)
            now[key] = self.known.get(key) or self._segment(files, info.path, names["topic"], int(names["partition"]))
        self.known = now
        return sorted((s for s in now.values() if s.end > s.first), key=lambda s: (s.topic, s.partition, s.first))

    def _segment(self, files: pf.FileSystem, file: str, topic: str, partition: int) -> Segment:
        with files.open_input_file(file) as raw:
            whole = pq.ParquetFile(raw)
            meta, names = whole.metadata, [whole.metadata.schema.column(i).path for i in range(whole.metadata.num_columns)]
            of = lambda i, name: meta.row_group(i).column(names.index(name)).statistics
            stats = [(of(i, "offset"), of(i, "committed")) for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
            first = min((s.min for s, _ in stats), default=0)
            end = max((s.max for s, _ in stats), default=-1) + 1
            stable = end
            if any(c is None or c.null_count for _, c in stats):
                t = whole.read(["offset", "committed"])
                stable = pc.min(t["offset"].filter(pc.is_null(t["committed"]))).as_py()
                stable = end if stable is None else stable
        return Segment(file, topic, partition, first, end, stable)

    def ends(self) -> dict[str, int]:
        """For each partition the offset before which all is decided. Later files of a partition hold later offsets; gaps between them are no records."""
        out, closed = {}, set()
        for s in self.segments():
            if (key := f"{s.topic}/{s.partition}") not in closed:
                out[key] = max(s.stable, out.get(key, 0))
                if s.stable < s.end:
                    closed.add(key)
        return out

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        found = []
        for s in self.segments():
            key = f"{s.topic}/{s.partition}"
            low, high = max(s.first, start.get(key, 0)), min(s.end, end.get(key, 0))
            if low < high:
                found.append(Piece(s, low, high))
        return found

    def records(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        files, _ = self.files()
        shape = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC")), ("headers", pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))), ("committed", pa.bool_())])
        with files.open_input_file(piece.segment.file) as raw:
            for batch in pq.ParquetFile(raw).iter_batches(4096, columns=[f.name for f in shape if f.name not in ("topic", "partition")]):
                inside = pc.and_(pc.and_(pc.greater_equal(batch["offset"], piece.start), pc.less(batch["offset"], piece.stop)), pc.fill_null(batch["committed"], False))
                rows = batch.filter(inside)
                own = {"topic": pa.array([piece.segment.topic] * rows.num_rows, pa.string()), "partition": pa.array([piece.segment.partition] * rows.num_rows, pa.int32())}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else rows[f.name].cast(f.type) for f in shape], schema=shape)


class Stream(DataSourceStreamReader):
    """A place is a dict of topic/partition to the next offset. A topic that appears between batches starts at its first record.

    A batch takes all that is decided. The option `records` bounds it, about, over all partitions together: for triggers
    that go on. A run over what there is (availableNow) asks a source in Python for one end only, so there the bound is
    what one run reads, and the next goes on from there.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.most = Folder(options), int(options["records"]) if "records" in options else None
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The stable ends; or, if `records` is set, as far towards them as it allows, every partition by an equal share."""
        ends = self.folder.ends()
        behind = {k: e - self.at.get(k, 0) for k, e in ends.items() if e > self.at.get(k, 0)}
        share = max(behind.values(), default=0) if self.most is None else max(1, self.most // max(1, len(behind)))
        self.at = {**self.at, **{k: self.at.get(k, 0) + min(n, share) for k, n in behind.items()}}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at = {**end, **{k: max(v, end.get(k, 0)) for k, v in self.at.items()}}  # after a restart, go on from here
        return self.folder.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.records(partition)

    def commit(self, end: dict) -> None:
        pass


class Batch(DataSourceReader):
    """All decided records of matching topics."""

    def __init__(self, options: dict[str, str]):
        self.folder = Folder(options)

    def partitions(self) -> list[Piece]:
        return self.folder.pieces({}, self.folder.ends())

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.records(partition)


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> StructType:
        return LOG

    def streamReader(self, schema: StructType) -> Stream:
        return Stream(dict(self.options))

    def reader(self, schema: StructType) -> Batch:
        return Batch(dict(self.options))
