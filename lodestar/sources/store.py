"""Tables that jobs write in the shared folder and read again.

`written` cuts a plan: what several branches read is computed once and survives lost
executors. `Versioned` is a table whose versions are lists of files: a commit writes
its files first and then creates the next version's manifest, which only one writer can
(the file must not exist yet), so readers see whole versions and a lost race is seen.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Lost(Exception):
    """Another writer made the version that this one was to make."""


class Versioned:
    """A table in a folder: `data/<part>` holds files, `versions/<n>.json` what version n
    consists of. Version 0 is empty. A batch that the table already holds is not
    written again, so a batch may be repeated; a writer that loses a race works its
    rows out anew on what the winner left."""

    def __init__(self, spark: SparkSession, folder: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.folder, self.partition_by = spark, folder.rstrip("/"), partition_by

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        files, at = self._files(), self._path("versions")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "parts": [], "batches": []}
        (text,) = self.spark.read.text(f"{self.folder}/versions/{version}.json", wholetext=True).collect()
        return json.loads(text.value)

    def commit(self, expected: int, schema: str, parts: list[str], batches: list[str]) -> int:
        """Makes the version after `expected`, or raises Lost if there is one already."""
        told = json.dumps({"version": expected + 1, "schema": schema, "parts": parts, "batches": batches})
        try:
            out = self._files().create(self._path(f"versions/{expected + 1}.json"), False)
        except Exception as e:
            if "already exists" in str(e):
                raise Lost(f"version {expected + 1} of {self.folder} was made by another") from e
            raise
        out.write(bytearray(told.encode()))
        out.close()
        return expected + 1

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the last, if none is named); None before the first."""
        return self._rows(self.manifest(version))

    def _rows(self, m: dict) -> DataFrame | None:
        if m["schema"] is None:
            return None
        if not m["parts"]:
            return self.spark.createDataFrame([], m["schema"])
        paths = [f"{self.folder}/data/{p}" for p in m["parts"]]
        reader = self.spark.read.option("basePath", f"{self.folder}/data").schema(m["schema"] + ", stored_part string")
        return reader.parquet(*paths).drop("stored_part")

    def write(self, batch: str, make, replace: bool = False, tries: int = 5) -> int:
        """Adds make(rows so far, or None) as a batch; with `replace` they become the table."""
        for _ in range(tries):
            m = self.manifest()
            if batch in m["batches"]:
                return m["version"]
            rows, part = make(self._rows(m)), f"stored_part={uuid.uuid4().hex}"
            writer = rows.write.partitionBy(*self.partition_by) if self.partition_by else rows.write
            writer.parquet(f"{self.folder}/data/{part}")
            schema = m["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            try:
                return self.commit(m["version"], schema, [part] if replace else [*m["parts"], part], [*m["batches"], batch])
            except Lost:
                self._files().delete(self._path(f"data/{part}"), True)
        raise Lost(f"{batch} lost {tries} races for {self.folder}")

    def append(self, batch: str, rows: DataFrame) -> int:
        return self.write(batch, lambda _: rows)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the parts that none of the last `keep` versions holds; their names."""
        last = self.version()
        held = {p for v in range(max(1, last - keep + 1), last + 1) for p in self.manifest(v)["parts"]}
        files, at = self._files(), self._path("data")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        gone = [n for n in names if n not in held]
        for n in gone:
            files.delete(self._path(f"data/{n}"), True)
        return gone


def latest(rows: DataFrame | None, like: DataFrame) -> DataFrame:
    """rows, or none of like's columns before the first version."""
    return rows if rows is not None else like.limit(0)
