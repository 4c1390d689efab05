"""A message bus as a data source: a stream writer that commits batches, and a reader, of a
table or a stream, with offsets.

A folder holds `segments/<id>.arrow` and `commits/<n>.json`, which names the segments of
one batch of one writer. A batch that a writer commits again changes nothing, so a
restarted writer repeats nothing; an offset is a number of commits, so a restarted
reader goes on where it was. The folder must be one that Arrow's file systems reach
(local or mounted, HDFS, an object store).

    spark.dataSource.register(Bus)
    df.writeStream.format("lodestar_bus").option("path", folder).option("writer", "w1")...
    spark.readStream.format("lodestar_bus").schema(...).option("path", folder).load()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "msg_id string, sender string, recipient string, type string, payload string, sent double, ttl int"


class Folder:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def commits(self, after: int = 0) -> list[dict]:
        """Commits in order, without the first `after`."""
        files, root = self._open()
        names = sorted(f.path for f in files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True)) if f.path.endswith(".json"))
        return [json.loads(files.open_input_stream(n).readall()) for n in names[after:]]

    def count(self) -> int:
        files, root = self._open()
        return sum(f.path.endswith(".json") for f in files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True)))

    def segment(self, batches: Iterator[pa.RecordBatch]) -> str | None:
        """Writes one segment; its name, or None without rows."""
        files, root = self._open()
        files.create_dir(f"{root}/segments", recursive=True)
        name, out, writer = f"{uuid.uuid4().hex}.arrow", None, None
        for batch in batches:
            if writer is None:
                out = files.open_output_stream(f"{root}/segments/{name}")
                writer = pa.ipc.new_stream(out, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return None
        writer.close()
        out.close()
        return name

    def commit(self, writer: str, batch: int | str, segments: list[str]) -> bool:
        """Whether this commit is new; one writer commits at a time."""
        files, root = self._open()
        files.create_dir(f"{root}/commits", recursive=True)
        done = self.commits()
        if any(c["writer"] == writer and c["batch"] == batch for c in done):
            return False
        to = f"{root}/commits/{len(done) + 1:012d}"
        with files.open_output_stream(f"{to}.tmp") as out:
            out.write(json.dumps({"writer": writer, "batch": batch, "segments": segments}).encode())
        files.move(f"{to}.tmp", f"{to}.json")
        return True

    def read(self, segment: str) -> Iterator[pa.RecordBatch]:
        files, root = self._open()
        with files.open_input_stream(f"{root}/segments/{segment}") as source:
            yield from pa.ipc.open_stream(source)


@dataclass
class Segment(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Segment]:
        return [Segment(s) for c in self.folder.commits() for s in c["segments"]] or [Segment("")]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition.name) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": self.folder.count()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        commits = self.folder.commits(start["commits"])[: end["commits"] - start["commits"]]
        return [Segment(s) for c in commits for s in c["segments"]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition.name)

    def commit(self, end: dict) -> None:
        pass  # segments stay, so that others may read from the start


@dataclass
class Written(WriterCommitMessage):
    segment: str | None


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: Folder, writer: str):
        self.folder, self.writer = folder, writer

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return Written(self.folder.segment(batches))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.folder.commit(self.writer, batchId, [m.segment for m in messages if m and m.segment])

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        pass  # segments that no commit names are never read


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: Folder, writer: str, batch: str):
        self.folder, self.writer, self.batch = folder, writer, batch

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return Written(self.folder.segment(batches))

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.commit(self.writer, self.batch, [m.segment for m in messages if m and m.segment])

    def abort(self, messages: list[Written | None]) -> None:
        pass


class Bus(DataSource):
    """Options: path; writer (a name; default: main); batch (of a plain write, default: a new one)."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_bus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(Folder(self.options["path"]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(Folder(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(Folder(self.options["path"]), self.options.get("writer", "main"), self.options.get("batch") or uuid.uuid4().hex)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(Folder(self.options["path"]), self.options.get("writer", "main"))
