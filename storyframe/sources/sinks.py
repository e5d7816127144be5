"""Files that appear together or not at all: a data source that writes whole files, or archives of pages, in versions.

A write makes a folder of its own below the target.  Tasks write numbered files to flat folders of their attempts; the
commit moves what successful tasks wrote to its name in the version's folder and then names the version in the file
``CURRENT``, which readers ask first.  So a reader sees the old files or all the new ones; a failed write is deleted and
leaves the old ones as they are.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

POINTER = "CURRENT"


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and the names of its files, the first of which is file 0."""

    folder: str
    names: list[str]


class _Versions(DataSourceWriter):
    def __init__(self, base: str, archives: bool, columns: list[str]):
        self.base, self.archives, self.version = base.rstrip("/"), archives, f"v-{uuid.uuid4().hex}"
        self.places = [columns.index(c) for c in ("path", "name", "content")]

    def _open(self):
        system, base = fs.FileSystem.from_uri(self.base)
        return system, base, f"{base}/{self.version}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, _, version = self._open()
        folder = f"{version}/.attempt-{TaskContext.get().taskAttemptId()}"
        done, now, out, archive = {}, None, None, None
        system.create_dir(folder, recursive=True)

        def close():
            if archive:
                archive.close()
            if out:
                out.close()

        try:
            for row in rows:
                path, name, content = (row[k] for k in self.places)
                if path != now:
                    close()
                    now = path
                    if now in done:
                        raise ValueError(f"rows of {now} don't follow each other: use write_files")
                    out = system.open_output_stream(f"{folder}/{len(done)}")
                    archive = zipfile.ZipFile(out, "w") if self.archives else None
                    done[now] = True
                if archive:
                    archive.writestr(name, bytes(content))
                else:
                    out.write(bytes(content))
        finally:
            close()
        return Written(folder, list(done))

    def commit(self, messages: list[Written | None]) -> None:
        system, base, version = self._open()
        system.create_dir(version, recursive=True)
        seen: set[str] = set()
        made: set[str] = set()
        for m in filter(None, messages):
            for k, name in enumerate(m.names):
                if name in seen:
                    raise ValueError(f"two tasks wrote {name}: use write_files")
                seen.add(name)
                parent = f"{version}/{name}".rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                system.move(f"{m.folder}/{k}", f"{version}/{name}")
        for info in system.get_file_info(fs.FileSelector(version)):
            if info.type == fs.FileType.Directory and info.base_name.startswith(".attempt-"):
                system.delete_dir(info.path)
        with system.open_output_stream(f"{base}/.{self.version}") as out:
            out.write(self.version.encode())
        system.move(f"{base}/.{self.version}", f"{base}/{POINTER}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _, version = self._open()
        if system.get_file_info(version).type == fs.FileType.Directory:
            system.delete_dir(version)


class WholeFiles(DataSource):
    """Rows (path, part, name, content) as files below a folder; ``kind`` is bytes, or zip with an entry for each row."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "path string, part long, name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("whole_files replaces what is there: use mode overwrite")
        return _Versions(self.options["path"], self.options.get("kind", "bytes") == "zip", schema.names)


def write_files(rows: DataFrame, folder: str, kind: str = "bytes") -> None:
    """Files of rows (path, part, content, for zip also name): a file is its rows in order of part, written by one task.

    All files appear in ``folder`` together; those of an earlier write stay on disk, but are no longer current.
    """
    spark = rows.sparkSession
    spark.dataSource.register(WholeFiles)
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    ready = rows.select("path", F.col("part").cast("long").alias("part"), name.alias("name"), F.col("content").cast("binary").alias("content"))
    ready.repartition("path").sortWithinPartitions("path", "part", "name").write.format("whole_files").option("kind", kind).mode("overwrite").save(folder)


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the files that the last complete write left."""
    return f"{folder.rstrip('/')}/{spark.read.text(f'{folder}/{POINTER}').first()[0]}"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder, relative to it, without hidden ones; tasks list what is below its entries."""
    system, base = fs.FileSystem.from_uri(folder.rstrip("/"))
    top = system.get_file_info(fs.FileSelector(base))
    entries = pa.table({"name": pa.array([i.base_name for i in top], pa.string()), "whole": pa.array([i.type == fs.FileType.Directory for i in top], pa.bool_())})

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder.rstrip("/"))
        for batch in batches:
            for name, whole in zip(batch["name"].to_pylist(), batch["whole"].to_pylist()):
                found = system.get_file_info(fs.FileSelector(f"{base}/{name}", recursive=True)) if whole else []
                paths = [i.path[len(base) + 1 :] for i in found if i.type == fs.FileType.File] if whole else [name]
                paths = [p for p in paths if not any(part[0] in "._" for part in p.split("/"))]
                if paths:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return spark.createDataFrame(entries).repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(below, "path string")


def read_files(paths: DataFrame, folder: str) -> DataFrame:
    """(path, content) of the files of (path), relative to ``folder``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder.rstrip("/"))
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["path", "content"])

        for path in (p for b in batches for p in b["path"].to_pylist()):
            with system.open_input_file(f"{base}/{path}") as file:
                held.append((path, file.read()))
            size += len(held[-1][1])
            if size >= 1 << 22 or len(held) >= 1000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return paths.select("path").repartition(4 * paths.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, "path string, content binary")
