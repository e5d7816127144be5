"""Pages out of archives, a range of pages to a partition: only the ranges that a filter leaves are opened.

An archive (zip or cbz) is a volume; its pages are its entries of the wanted suffixes in order of name, numbered from 1.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".html")


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``last`` of an archive."""

    archive: str
    volume: str
    first: int
    last: int


def _entries(archive: zipfile.ZipFile, suffixes: tuple[str, ...]) -> list[str]:
    return sorted(n for n in archive.namelist() if n.lower().endswith(suffixes))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("pagesperpartition", "64"))  # keys come lower-cased
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))
        self.first, self.last, self.volumes = 1, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the page number and sets of volumes are taken over; the rest is left to Spark."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("page",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if at == ("page",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = f.value - isinstance(f, LessThan)
                self.last = end if self.last is None else min(self.last, end)
            if at == ("volume",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.volumes = wanted if self.volumes is None else self.volumes & wanted
            if not (at == ("page",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or at == ("volume",) and isinstance(f, (EqualTo, In))):
                yield f

    def partitions(self) -> list[Pages]:
        """Ranges of pages of the wanted archives; without an upper bound an archive's directory tells where it ends."""
        system, base = fs.FileSystem.from_uri(self.path)
        out = []
        for info in sorted(system.get_file_info(fs.FileSelector(base)), key=lambda x: x.path):
            volume, _, suffix = info.base_name.rpartition(".")
            if suffix.lower() not in ("zip", "cbz") or self.volumes is not None and volume not in self.volumes:
                continue
            last = self.last
            if last is None or last - self.first >= self.step:
                with system.open_input_file(info.path) as file, zipfile.ZipFile(file) as archive:
                    count = len(_entries(archive, self.suffixes))
                last = count if last is None else min(last, count)
            out += [Pages(info.path, volume, a, min(a + self.step - 1, last)) for a in range(self.first, last + 1, self.step)]
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.archive) as file, zipfile.ZipFile(file) as archive:
            names = _entries(archive, self.suffixes)
            for page in range(partition.first, min(partition.last, len(names)) + 1):
                yield partition.volume, page, names[page - 1], archive.read(names[page - 1])


class PageArchives(DataSource):
    """Options: path (a folder of archives), pagesPerPartition, suffixes (joined by commas)."""

    @classmethod
    def name(cls) -> str:
        return "page_archives"

    def schema(self) -> str:
        return "volume string, page int, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_pages(spark: SparkSession, folder: str, first: int = 1, most: int | None = None, **options: str) -> DataFrame:
    """(volume, page, name, content) of the archives in a folder: from page ``first`` on, ``most`` pages of each.

    Filters of page and volume, these and the caller's, choose the partitions; a range past the end gives nothing.
    """
    if first < 1 or (most is not None and most < 1):
        raise ValueError("page numbers start at 1")
    spark.dataSource.register(PageArchives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pages = spark.read.format("page_archives").options(**options).load(folder).where(f"page >= {int(first)}")
    return pages if most is None else pages.where(f"page <= {int(first) + int(most) - 1}")
